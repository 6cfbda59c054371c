"""WARC archives: a writer of gzipped records, and a splittable reader.

Each writing task makes one archive (or more, of bounded size) in the shared
folder and reports it in a manifest that Spark commits, so files of lost
attempts are never read. A reading task gets a byte range: it looks for the gzip
magic, takes a candidate for a member only if it inflates to a WARC header (of any
length), owns the records that start inside its range, and reads the last one beyond
it. Nothing is lost in silence: a member that begins as a record and does not decode
ends the job, or is reported as a row of record_type "damaged"; and `checked` holds
the number of records read of each archive against its manifest.

Pages with equal payloads are one response, that of the smallest page_id, and
revisits, which carry the digest and the HTTP head (with its Content-Length) but
no payload. Nulls and edges: a null html is an empty payload; a null url becomes
the record's own URN; a null page_id is written as an empty id, counts after all
others, and revisits like them; rows repeated with the same page_id and payload
are alike, responses if that id is the smallest; payloads of any length are kept
whole; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import scratch_path, staged

MAGIC = b"\x1f\x8b\x08"
URN = "urn:page:"
#: Bytes of a reading task's range, and of an archive before the next is begun.
SPLIT, ARCHIVE = 16 << 20, 1 << 30
#: A candidate is inflated in pieces of so many bytes until its header ends.
HEAD = 1 << 9
OPENING = b"WARC/1."


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str, level: int) -> bytes:
    """One gzip member: a response, or a revisit where `refers_to` names the page it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{page}>",
        f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''') if url is not None else URN + page}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def with_revisits(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with `refers_to`, and `revisit`, whether an equal payload has a smaller page_id."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    repeats = keyed.select("page_id", "digest").join(firsts, "digest").where("page_id is null or page_id != first")
    roles = repeats.select(F.coalesce(F.col("page_id"), F.lit(-1)).alias("id"), F.col("page_id").isNull().alias("no_id"), F.col("digest").alias("same"), "first").distinct()
    on = (F.coalesce(F.col("page_id"), F.lit(-1)) == F.col("id")) & (F.col("page_id").isNull() == F.col("no_id")) & (F.col("digest") == F.col("same"))
    return keyed.join(roles, on, "left").select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write `pages` below `path`; the manifest (file, bytes, records), staged."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        out, name, size, n, made = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, size, n))
                out = None

        for part in parts:
            for page, url, html, refers_to, revisit in part.itertuples(index=False, name=None):
                if out is None:
                    name, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)  # the records are members of their own already
                data = record(
                    "" if pd.isna(page) else str(int(page)), url if isinstance(url, str) else None, html.encode(), ("" if pd.isna(refers_to) else str(int(refers_to))) if revisit else None, date, level
                )
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pd.DataFrame(made, columns=["file", "bytes", "records"])

    return staged(with_revisits(pages).mapInPandas(write, "file string, bytes long, records long"), "warc-manifest")


class Range:
    """The bytes of a file from `start` on, read as they are asked for."""

    def __init__(self, source, size: int, start: int, end: int):
        self.source, self.size, self.start = source, size, start
        source.seek(start)
        self.data = bytearray(source.read(end - start))

    def more(self, n: int = 1 << 18) -> bytes:
        """The next bytes beyond those at hand; empty at the end of the file."""
        got = self.source.read(min(n, self.size - self.start - len(self.data)))
        self.data += got
        return got


class Damaged(ValueError):
    """A record that cannot be read."""


def beginning(data: bytes) -> bytes:
    """What `data` inflates to before it cannot be inflated any further, byte by byte."""
    unpack, out = zlib.decompressobj(31), b""
    try:
        for i in range(len(data)):
            out += unpack.decompress(data[i : i + 1])
    except zlib.error:
        pass
    return out


def opens_record(held: Range, at: int) -> bool:
    """Whether a member at `at` begins with a WARC header. One that breaks off inside it counts: it is damage, not chance."""
    unpack, out, fed = zlib.decompressobj(31), b"", at
    while not unpack.eof and (fed < len(held.data) or held.more()):
        piece = bytes(held.data[fed : fed + HEAD])
        fed += len(piece)
        try:
            out += unpack.decompress(piece)
        except zlib.error:
            return beginning(bytes(held.data[at:fed])).startswith(OPENING)
        if not out.startswith(OPENING[: len(out)]):
            return False
        head, ended, _ = out.partition(b"\r\n\r\n")
        if ended:
            return b"\r\nwarc-type:" in head.lower()
    return out.startswith(OPENING)


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, record) of the members that begin in [start, end) of a file of `size` bytes; None for one that does not decode."""
    held = Range(source, size, start, min(end, size))
    at, limit = 0, end - start
    while True:
        at = held.data.find(MAGIC, at)
        while at < 0:  # the magic may lie across the end
            seen = len(held.data)
            if seen >= limit + len(MAGIC) or not held.more():
                return
            at = held.data.find(MAGIC, max(0, seen - len(MAGIC)))
        if at >= limit:
            return
        if not opens_record(held, at):
            at += 1
            continue
        unpack, out, fed = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                if fed >= len(held.data) and not held.more():
                    raise zlib.error("the member ends early")
                piece = bytes(held.data[fed : fed + (1 << 18)])
                out.append(unpack.decompress(piece))
                fed += len(piece)
        except zlib.error:
            yield start + at, None
            at += 1
            continue
        yield start + at, b"".join(out)
        at = fed - len(unpack.unused_data)


def parse(data: bytes) -> tuple[str, int, str, str, str | None, str | None, bytes | None]:
    """(page, payload bytes, digest, type, refers to, url, payload) of a record; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and digest_of(payload) != digest:
        raise Damaged(f"the payload of {fields['warc-record-id']} is not what its digest says")
    page = fields["warc-record-id"][1:-1].removeprefix(URN)
    refers_to = fields["warc-refers-to"][1:-1].removeprefix(URN) if kind == "revisit" else None
    return page, int(headers(http)["content-length"]), digest, kind, refers_to, unquote(fields["warc-target-uri"]), payload if kind == "response" else None


def read_archives(manifest: DataFrame, path: str, split: int = SPLIT, payloads: bool = False, damaged: str = "raise") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload], file, offset) of the archives in `manifest`.

    A record that does not decode, or whose payload its digest contradicts, ends the job, or with `damaged` = "report"
    is a row of record_type "damaged" that has only its file and offset.
    """
    if damaged not in ("raise", "report"):
        raise ValueError("damaged must be raise or report")
    spark = manifest.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start")).repartition(wide, "file", "start")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else []), "file", "offset"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if payloads else "") + ", file string, offset long"

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def row(data: bytes | None) -> tuple:
        if data is None:
            raise Damaged("the member does not decode")
        page, n, digest, kind, refers_to, url, payload = parse(data)
        return (number(page), n, digest, kind, number(refers_to), url, payload)[: len(columns) - 2]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(path)
        for part in parts:
            for file, size, start in part.itertuples(index=False, name=None):
                with fs.open_input_file(file) as source:
                    rows, held = [], 0
                    for offset, data in records_in(source, size, start, start + split):
                        try:
                            own = row(data)
                        except (Damaged, KeyError, ValueError) as fault:  # a header without what a record must have, too
                            if damaged == "raise":
                                raise Damaged(f"{file} at {offset}: {fault}") from fault
                            own = (None, None, None, "damaged", *[None] * (len(columns) - 6))
                        rows.append((*own, file, offset))
                        held += len(data or b"")
                        if held > 32 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return splits.mapInPandas(read, schema)


def checked(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """`found`, which `read_archives` gave of `manifest` and which is written already: an error unless every archive has
    as many records as the manifest says."""
    counts = found.groupBy(F.col("file").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    short = manifest.join(counts, F.col("file") == F.col("of"), "left").where(F.coalesce("n", F.lit(0)) != F.col("records"))
    if (one := short.select("file", "records", F.coalesce("n", F.lit(0)).alias("n")).first()) is not None:
        raise Damaged(f"{one['file']} has {one['n']} of {one['records']} records")
    return found


def round_trip(pages: DataFrame, level: int = 6, split: int = SPLIT) -> DataFrame:
    """`pages` written as archives and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, path, level=level)
    return checked(manifest, staged(read_archives(manifest, path, split), "warc-found")).drop("file", "offset")
