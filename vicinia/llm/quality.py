"""Quality of texts by Bradley-Terry ranking of pairs: a linear score learned from preferences, and a threshold by quantile.

A labelled pair says which of two texts is preferred. The chance that text a is
preferred to b is taken as sigmoid(w . (f(a) - f(b))), f being features of a whole
text, and w is fitted by logistic loss on the differences, with a ridge. Features
tell how a text is written, not by whom: trigrams of kinds of bytes (lower, upper,
digit, each mark) and of the bytes themselves, hashed, and shares such as of capitals,
marks, distinct words and repeated lines.

Preferences come from a bounded sample of labelled rows, SAMPLE of each class at
most, the first by the hash of their ids, and of those as many as SAMPLE_BYTES hold:
each better text meets PAIRS worse ones at least, and the other way round. The
threshold is one of the quantiles of the scores of all documents, in steps of
1 / LEVELS and beside the best of those in steps of 1 / LEVELS of what lies there:
the level that leaves the fewest of all labelled rows that may be learned from on the
wrong side; of several as good, the middle of the widest stretch. The score that is
given out is sigmoid(slope * (raw - threshold)), so 0.5 is at the threshold.

Nulls and edges: a null text is an empty one, and every text has a score; texts are
read whole, in bounded pieces; rows with a null doc_id are scored and not learned
from; of rows with one doc_id one text is learned from, the first in order, and of
labels that contradict each other the lower; repeated rows score alike; where one
class has no labels there are no preferences, every score is 0.5 and every text is
kept; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, staged
from .shingles import CHUNK, mix, run_hashes, runs, shingle_hashes
from .toxicity import taught

#: Places of hashed trigrams of kinds and of bytes.
KINDS, BYTES = 1 << 10, 1 << 11
#: Bounds of the training sample: rows of each class, and bytes of their texts; partners of a text.
SAMPLE, SAMPLE_BYTES, PAIRS = 1500, 24 << 20, 8
#: Quantiles of all documents' scores that a threshold is chosen from.
LEVELS = 1000
#: Weights of the ridge, and rounds of the fit.
RIDGE, ROUNDS = 3e-3, 400


def _kinds() -> np.ndarray:
    """The kind of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 beyond ASCII, 6 control, each mark one of its own."""
    out = np.full(256, 6, np.int64)
    out[0x80:], out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A] = 5, 0, 1, 2
    out[[0x20, 0x09, 0x0B, 0x0C]], out[[0x0A, 0x0D]] = 3, 4
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    out[marks] = np.arange(len(marks)) + 7
    return out


KIND = _kinds()
N_KINDS = int(KIND.max()) + 1
#: Where the shares begin, and their names, one a place.
SHARES = ("length", "upper", "digits", "marks", "beyond", "blanks", "line_ends", "word_length", "word_spread", "distinct_words", "top_word", "distinct_runs", "marked_words", "capital_words", "distinct_lines", "line_length", "one_letter_words", "distinct_trigrams")
WIDTH = KINDS + BYTES + len(SHARES)


def _trigrams(codes: np.ndarray, base: int, places: int) -> np.ndarray:
    """How often each place is met by the hashed trigrams of `codes`."""
    if len(codes) < 3:
        return np.zeros(places)
    grams = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    return np.bincount((mix(grams.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % places, minlength=places).astype(float)


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def features(text: str | None) -> np.ndarray:
    """The features of a whole text; those of an empty one are 0."""
    out = np.zeros(WIDTH)
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    lowered = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    for start in range(0, len(data), CHUNK):  # pieces share two bytes, so no trigram is lost
        piece = slice(start, start + CHUNK + 2)
        out[:KINDS] += _trigrams(KIND[data[piece]], N_KINDS, KINDS)
        out[KINDS : KINDS + BYTES] += _trigrams(lowered[piece].astype(np.int64), 256, BYTES)
    met = np.count_nonzero(out[KINDS : KINDS + BYTES])
    for part in (slice(0, KINDS), slice(KINDS, KINDS + BYTES)):
        out[part] = np.sqrt(out[part] / max(out[part].sum(), 1))
    counts = np.bincount(KIND[data], minlength=N_KINDS)
    n = len(data)
    starts, ends = runs(data)
    words, lengths = run_hashes(lowered, starts, ends), ends - starts
    at_end = KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    line_starts, line_ends = runs(data, np.isin(np.arange(256), (0x0A, 0x0D)))
    lines = run_hashes(data, line_starts, line_ends)
    word_runs = shingle_hashes(words, 4)
    upper = np.concatenate([[0], np.cumsum(KIND[data] == 1)])
    capitals = upper[ends] - upper[starts] if len(ends) else np.zeros(0)
    top = np.unique(words, return_counts=True)[1].max() if len(words) else 0
    out[KINDS + BYTES :] = (
        np.log1p(n), _share(counts[1], counts[0] + counts[1]), _share(counts[2], n), _share(counts[7:].sum(), n), _share(counts[5], n), _share(counts[3], n), _share(counts[4], n),
        np.log1p(lengths.mean()) if len(words) else 0, np.log1p(lengths.std()) if len(words) else 0, _share(len(np.unique(words)), len(words)), _share(top, len(words)),
        _share(len(np.unique(word_runs)), len(word_runs)), _share((at_end >= 7).sum(), len(words)), _share(((capitals > 1) & (2 * capitals > lengths)).sum(), len(words)),
        _share(len(np.unique(lines)), len(lines)), np.log1p((line_ends - line_starts).mean()) if len(lines) else 0, _share((lengths == 1).sum(), len(words)), _share(met, min(n, BYTES)),
    )
    return out


@dataclass
class Ranking:
    """A raw score is (f - mean) / spread . weights; `slope` and `threshold` make it a score between 0 and 1."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    threshold: float = 0.0

    def raw(self, texts: list[str | None]) -> np.ndarray:
        ready, base = self.weights / self.spread, float((self.mean / self.spread) @ self.weights)
        return np.array([float(features(t) @ ready) - base for t in texts])


def preference_pairs(better: int, worse: int, partners: int = PAIRS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(place among the better, place among the worse) of pairs: every text of either kind is in `partners` of them at least."""
    rng, size = np.random.default_rng(seed), max(better, worse)
    left, right = (np.concatenate([np.resize(rng.permutation(n), size) for _ in range(partners)]) for n in (better, worse))
    return left, right


def fit_pairs(x: np.ndarray, preferred: np.ndarray, other: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """The weights that make the rows `preferred` of `x` score above the rows `other`: mean logistic loss on the differences of
    their features and a ridge, by accelerated gradient steps of a size that is found on the way."""
    w = at = np.zeros(x.shape[1])
    step, t = 1.0, 1.0

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        score = x @ v
        gap = score[preferred] - score[other]
        return float(np.logaddexp(0, -gap).mean() + ridge / 2 * v @ v), gap

    for _ in range(rounds):
        value, gap = loss(at)
        pull = -1 / (1 + np.exp(np.clip(gap, -500, 500))) / len(gap)
        each = np.bincount(preferred, pull, len(x)) - np.bincount(other, pull, len(x))
        slope = x.T @ each + ridge * at
        while step > 1e-9 and loss(at - step * slope)[0] > value - step / 2 * slope @ slope:
            step /= 2
        following = at - step * slope
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, w = following + (before - 1) / t * (following - w), following
        step *= 1.2
        if np.abs(slope).max() < 1e-7:
            break
    return w


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 0) -> Ranking | None:
    """A ranking from features and labels (1 better, 0 worse); None if one class has no rows."""
    better, worse = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(better) or not len(worse):
        return None
    mean, spread = x.mean(0), x.std(0)
    dense = np.arange(WIDTH) < KINDS + BYTES
    # Hashed places keep their sizes among each other, so that rare ones do not outweigh the rest.
    for part in (slice(0, KINDS), slice(KINDS, KINDS + BYTES)):
        spread[part] = max(float(np.sqrt((spread[part] ** 2).sum())) / 4, 1e-6)
    spread[~dense] = np.maximum(spread[~dense], 1e-3) * 2
    left, right = preference_pairs(len(better), len(worse), seed=seed)
    z = (x - mean) / spread
    return Ranking(mean, spread, fit_pairs(z, better[left], worse[right]))


def _known(labels: DataFrame) -> DataFrame:
    """(own, quality): a label of 0 or 1 for each id that may be learned from."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(F.coalesce(taught(), F.lit(False)))
    return told.groupBy(F.col("doc_id").alias("own")).agg(F.min("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 0) -> Ranking | None:
    """A ranking, without its threshold, from the labelled rows of `docs` that may be learned from; bounded as the module says."""
    spark, known, rank = docs.sparkSession, _known(labels), F.xxhash64(F.lit(seed), "own")
    picked = [r for c in (0, 1) for r in enumerate(known.where(F.col("quality") == c).orderBy(rank, "own").limit(sample).collect())]  # 2 * sample rows at most
    if not picked:
        return None
    picks = spark.createDataFrame([(r["own"], r["quality"], place) for place, r in picked], "own long, quality int, place int")
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picks), F.col("doc_id") == F.col("own"))
    rows = staged(met.groupBy("own", "quality", "place").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "quality-sample")
    wanted, size = [], 0
    for r in sorted(rows.select("own", "place", F.octet_length("text").alias("bytes")).collect(), key=lambda r: (r["place"], r["own"])):
        if size + r["bytes"] <= sample_bytes:
            size += r["bytes"]
            wanted.append(r["own"])
    if not wanted:
        return None
    chosen = spark.createDataFrame([(i,) for i in wanted], "of long")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype("<f4").tobytes() for t in texts], dtype=object)

    found = rows.join(F.broadcast(chosen), F.col("own") == F.col("of")).select("own", "quality", packed("text").alias("packed")).toPandas().sort_values("own")
    x = np.frombuffer(b"".join(found["packed"]), "<f4").reshape(len(found), WIDTH).astype(float)
    return fit(x, found["quality"].to_numpy(), seed)


def raw_scores(docs: DataFrame, ranking: Ranking, name: str) -> DataFrame:
    """`docs` with the raw score of each whole text as column `name`."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranking)  # three vectors of WIDTH

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shipped.value.raw([t if isinstance(t, str) else None for t in part]), dtype=float)

    return docs.withColumn(name, score(F.col("text").cast("string")))


def levels_of(scored: DataFrame, raw: str, levels: int = LEVELS) -> list[float]:
    """The quantiles of all raw scores, falling apart by 1 / levels of the rows, to a tenth of that; without repeats."""
    found = scored.agg(F.percentile_approx(raw, [i / levels for i in range(levels + 1)], 10 * levels).alias("q")).first()["q"]
    return sorted(set(found or []))


def parted(scored: DataFrame, known: DataFrame, grid: list[float], doc_id: str, raw: str) -> tuple[int, float]:
    """(place in `grid`, slope): the quantile that parts the labelled rows of `scored` best, and how steep scores rise there.

    All labelled rows count; they are counted by the quantile that their score has reached, so the driver gets two counts a
    quantile.
    """
    edges = np.array(grid)

    @F.pandas_udf("int")
    def reached(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), "right"), dtype="int32")

    met = scored.select(F.col(doc_id).alias("own_id"), F.col(raw).alias("raw")).join(known, F.col("own_id") == F.col("own"))
    told = met.groupBy(reached("raw").alias("at"), "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total")).collect()
    n, total = np.zeros((2, len(grid) + 1)), np.zeros(2)
    for r in told:
        n[r["quality"], r["at"]] += r["n"]
        total[r["quality"]] += r["total"]
    if not n.sum(1).all():
        return 0, 1.0
    below = n.cumsum(1)[:, : len(grid)]  # of each class, the rows below each quantile
    right = below[0] - below[1]
    best = np.flatnonzero(right == right.max())
    stretches = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(stretches, key=lambda s: edges[s[-1]] - edges[s[0]])
    means = total / n.sum(1)
    return int(widest[(len(widest) - 1) // 2]), 4 / max(float(means[1] - means[0]), 1e-6)


def threshold_of(scored: DataFrame, known: DataFrame, doc_id: str, raw: str) -> tuple[float, float]:
    """(threshold, slope): the best quantile of all rows, then the best of the finer ones beside it."""
    if not (grid := levels_of(scored, raw)):
        return 0.0, 1.0
    at, _ = parted(scored, known, grid, doc_id, raw)
    beside = F.col(raw).between(grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)])
    grid = sorted({*grid, *levels_of(scored.where(beside), raw)})
    at, slope = parted(scored, known, grid, doc_id, raw)
    return grid[at], slope


def scores(docs: DataFrame, labels: DataFrame, name: str = "score", carried: Sequence[str] | None = None) -> DataFrame:
    """`docs`, or those of its columns that are to be carried, with the score of each whole text as column `name`: 0 to 1, 0.5 at the threshold."""
    columns = list(docs.columns if carried is None else carried)
    if (ranking := train(docs, labels)) is None:
        return docs.select(*columns, F.lit(0.5).alias(name))
    raw, own = fresh(docs, "raw"), fresh(docs, "own_id")
    found = raw_scores(docs, ranking, raw).select(*columns, raw, F.col("doc_id").cast("long").alias(own))
    scored = staged(found, "quality-scores")  # texts are read once, and scores are there for the quantiles and for the result
    threshold, slope = threshold_of(scored, _known(labels), own, raw)
    rise = F.greatest(F.least(F.lit(slope) * (F.col(raw) - F.lit(threshold)), F.lit(40.0)), F.lit(-40.0))
    return scored.select(*columns, (1 / (1 + F.exp(-rise))).alias(name))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, by a ranking that learns from the labels that it may."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = scores(ids, labels, carried=["doc_id"])
    held_out = F.coalesce(~taught(), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def above_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with their columns."""
    name = fresh(docs, "score")
    return scores(docs, labels, name).where(F.col(name) >= threshold).drop(name)
