"""Media columns: payloads kept as lossless WebP images, one sample a byte, and read back as pixel arrays.

A payload becomes grey images 64 samples wide, each a file of its own, one after
another where a payload outgrows one image. Grey takes the subtract-green
transform; payloads of 16 values or fewer take a palette; lines that come again
and runs of the padding are copied by back-reference, or the pixel to the left or
above is predicted from, whichever is estimated to be smaller. (Of a grey image
neither cross-colour nor a colour cache can make a smaller file than subtract-green
does, so the encoder does not choose them; the decoder reads them all.) Reading
decodes the files to pixels and checks that they are grey.

Nulls and edges: a null text counts as empty and is 64 zero bytes; equal texts
give equal bytes, whatever their rows; null and repeated doc_ids pass; texts of
any length are stored whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import webp
from ._common import staged

WIDTH = 64
#: Rows of one image; a payload of more takes more files.
ROWS = 8192
#: Shorter lines are not looked for again.
SHORTEST_COPY = 16
#: About what a copy takes, and what a predictor's own image does.
COPY_BITS, PREDICTOR_BITS = 24, 64


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def repeats(data: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that came before, and of the zeros at the end after their first."""
    out, seen, at = [], {}, 0
    body = data.rstrip(b"\0")
    for line in body.split(b"\n"):
        if len(line) >= SHORTEST_COPY:
            if (before := seen.get(line)) is not None:
                for k in range(0, len(line), webp.MOST_COPIED):
                    out.append((at + k, min(webp.MOST_COPIED, len(line) - k), at - before))
            seen[line] = at
        at += len(line) + 1
    zeros = len(data) - len(body) - 1
    for k in range(0, zeros if zeros >= 4 else 0, webp.MOST_COPIED):
        out.append((len(body) + 1 + k, min(webp.MOST_COPIED, zeros - k), 1))
    return out


def estimated_bits(symbols: np.ndarray) -> float:
    """What an ideal code of single symbols takes."""
    counts = np.bincount(symbols, minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(len(symbols) / counts)).sum()) + 8 * len(counts)


def best_predictor(samples: np.ndarray, copies: list[tuple[int, int, int]]) -> int | None:
    """1 (left) or 2 (above) where what is left of that prediction is estimated to be smaller than literals and copies; else None."""
    flat = samples.reshape(-1)
    taken = sum(length for _, length, _ in copies)
    plain = estimated_bits(flat) * (1 - taken / len(flat)) + COPY_BITS * len(copies)
    sizes = {1: estimated_bits(flat - np.concatenate([flat[:1], flat[:-1]]))}
    if len(samples) > 1:
        sizes[2] = estimated_bits((samples[1:] - samples[:-1]).reshape(-1)) + 8 * WIDTH
    mode = min(sizes, key=sizes.get)
    return mode if sizes[mode] + PREDICTOR_BITS < plain else None


def store(payload: bytes) -> bytes:
    """The WebP file or files of a payload, whose length is a multiple of WIDTH."""
    files = []
    for start in range(0, len(payload), WIDTH * ROWS):
        part = payload[start : start + WIDTH * ROWS]
        samples = np.frombuffer(part, np.uint8).reshape(-1, WIDTH)
        pixels = np.repeat(samples[..., None], 4, axis=2)
        pixels[..., 0] = 255
        few = len(set(part)) <= 16
        copies = [] if few else repeats(part)
        mode = None if few else best_predictor(samples, copies)
        files.append(webp.encode(pixels, predictor=mode, palette=few, subtract_green=not few, copies=[] if mode else copies))
    return b"".join(files)


def load(media: bytes) -> np.ndarray:
    """The samples of `store`'s files, of shape (rows, WIDTH)."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        pixels = webp.decode(media[at : at + size])
        if not (pixels[..., 1] == pixels[..., 2]).all() or not (pixels[..., 3] == pixels[..., 2]).all():
            raise webp.WebPError("not a grey image")
        parts.append(pixels[..., 2])
        at += size
    return np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Size, mean, values used and entropy of an image, and 64 bits of which of its 8 x 8 fields are brighter than their mean."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    share = counts[counts > 0] / samples.size
    entropy = float(-(share * np.log2(share)).sum())
    rows = np.linspace(0, len(samples), 9).astype(int)
    sums = np.concatenate([[0], np.cumsum(samples.reshape(len(samples), 8, 8).sum(2, dtype=np.int64).sum(1))])
    columns = samples.sum(0, dtype=np.int64).reshape(8, 8).sum(1)
    fields = np.add.outer(np.diff(sums[rows]) * 8, columns)
    mark = int.from_bytes(np.packbits((fields > fields.mean()).reshape(-1)).tobytes())
    return f"{samples.shape[1]}x{len(samples)} mean={samples.mean():.3f} values={len(share)} entropy={entropy:.4f} mark={mark:016x}"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as its stored images."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            data = [t.encode() if isinstance(t, str) else b"" for t in part["text"]]
            stored = {d: store(padded(d)) for d in dict.fromkeys(data)}
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(d) for d in data], "media": [stored[d] for d in data]})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInPandas(write, "doc_id long, n_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """`media_column`'s rows decoded: with height, width and samples (the bytes of the pixel array, row by row)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            samples = [load(m) for m in part["media"]]
            yield part[["doc_id", "n_bytes"]].assign(height=[len(s) for s in samples], width=WIDTH, samples=[s.tobytes() for s in samples])

    return media.mapInPandas(read, "doc_id long, n_bytes long, height long, width long, samples binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text stored, read back and described; the media column is written to the shared folder in between."""

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen: dict[bytes, tuple] = {}
            for m in part["media"]:
                if m not in seen:
                    samples = load(m)
                    payload = samples.tobytes()
                    seen[m] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples))
            out = pd.DataFrame([seen[m] for m in part["media"]], columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "n_bytes", part["n_bytes"].to_numpy())
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    stored = staged(media_column(docs), "media")
    return stored.mapInPandas(describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
