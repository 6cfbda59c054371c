"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of a text that are hashed at once; a word that goes beyond is taken whole.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Flags of the bytes that separate words.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True
_EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_BASE))


_BYTES = seeds(256, 1000)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of the base and of its inverse, modulo 2**64; kept for the usual lengths."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        both = [np.cumprod(np.array([1] + [b] * (size - 1), np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        if size > 2 * CHUNK:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def lowered(text: str) -> np.ndarray:
    """The bytes of `text`, A-Z lowered."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


def runs(data: np.ndarray, gaps: np.ndarray = GAPS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of bytes that are not `gaps`, a flag for each byte."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~gaps[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes; they are in order, and may overlap."""
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(data), CHUNK):
        i, j = np.searchsorted(starts, (k, k + CHUNK))
        if i < j:
            part = data[k : int(ends[i:j].max())]
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
            out[i:j] = mix((sums[ends[i:j] - k] - sums[starts[i:j] - k]) * down[starts[i:j] - k])
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word `[^\\x20\\x09-\\x0D]+` of `text`, A-Z lowered."""
    if not text:
        return _EMPTY
    data = lowered(text)
    return run_hashes(data, *runs(data))


_PLACES = seeds(64, 5000) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; of the whole sequence where there are fewer, of nothing where there are none."""
    n = len(words)
    if not n:
        return _EMPTY
    if n < size:
        return mix((words * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = words[: n - size + 1] * _PLACES[0]
    for k in range(1, size):
        total += words[k : n - size + 1 + k] * _PLACES[k]
    return mix(total)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of `text`, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), size))


def sequence_key(words: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a sequence of words."""
    up, _ = powers(len(words) + 1)
    spread = mix(words ^ np.uint64(0x5851F42D4C957F2D))
    keys = [mix(np.array([(w * up[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64)).astype(np.int64) for w in (words, spread)]
    return int(keys[0][0]), int(keys[1][0])
