"""Mixing sources to target weights.

Sizes are summed per source, targets are water-filled under a cap, and every
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction of the rate. That copy is one draw a document; so that
what a source takes comes near its target, the source chooses the seed of its draws
among a few, the one whose sum over all its documents comes nearest, which all seeds
are summed for in one pass. A draw is a function of the document's id and text, and,
where rows repeat both within a source, of a row's number among those.

Nulls and edges: a null text has size 0; a null source is a source of its own
and comes last; rows without an id are told by their texts; rows that repeat id,
source and text are numbered, so that each is drawn on its own, and their copies
together repeat exactly (which of them gets one, should they differ in other
columns, follows their order in the table); an empty table gives an empty result;
other columns pass through `mixed_documents` untouched and are ignored by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, fresh, hot_keys, spread_join, staged, text_or_empty

#: One sha256 gives eight draws of 32 bits.
DRAWS = 8
#: Sources that are shipped to every task as a table; more of them are joined by a shuffle.
FEW = 10_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: `share` of all sizes split by `weights`, which
    repeat over the sources in code point order, no target above `cap` times its source's size.

    The windows below run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("place", F.row_number().over(named)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.lit(cap) * (F.sum("source_size").over(filled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))) / F.sum("weight").over(
        filled.rowsBetween(0, Window.unboundedFollowing)
    )
    levels = weighed.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"), F.struct("place_in_fill", "level"))
    least = F.min(free).over(Window.partitionBy())["level"]
    return (
        levels.withColumn("place_in_fill", F.row_number().over(filled))
        .withColumn("water", least)
        .select("source", "source_size", F.coalesce(F.least(F.lit(cap) * F.col("source_size"), F.col("water") * F.col("weight")), F.lit(cap) * F.col("source_size")).alias("target"))
    )


def _digest(seed: str, words: Column | str, tie: Column | str) -> Column:
    """32 bytes in hex that a row's draws are taken from; `words` is the hash of its text."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", F.lit(seed), number, F.col(tie).cast("string") if isinstance(tie, str) else tie, F.col(words) if isinstance(words, str) else words), 256)


def _text_hash() -> Column:
    return F.sha2(text_or_empty(), 256)


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, words, k1, k2) of each row, staged; k1 and k2 stand for id, source and text together."""
    told = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("source"), F.col("words")), F.col("doc_id").isNull(), F.col("source").isNull()
    sized = docs.select("doc_id", "source", word_count().alias("size"), _text_hash().alias("words"), *more)
    return staged(sized.withColumns({"k1": F.xxhash64(*told), "k2": F.xxhash64(F.lit(7), *told)}), "mix-sizes")


def _repeats(sized: DataFrame) -> DataFrame:
    """(r1, r2, n): the keys that several rows have, staged."""
    return staged(sized.groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "mix-repeats")


def _ties(sized: DataFrame, repeats: DataFrame) -> DataFrame:
    """(at, tie): numbers from 0 of the rows (k1, k2, place) whose key repeats.

    A row's number is its number among those of its partition, after those of the partitions before, so that no task
    has to hold more of a key than a partition has.
    """
    part = F.shiftright("place", 33)
    rows = spread_join(sized.select("k1", "k2", "place", part.alias("part")), repeats.select("r1", "r2"), ["k1", "k2"], ["r1", "r2"], "place", hot_keys(repeats)).select("k1", "k2", "part", "place")
    rows = staged(rows, "mix-repeated")
    earlier = Window.partitionBy("k1", "k2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("k1", "k2", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("part").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("k1", "k2", "part").orderBy("place")) - 1)
    met = own.join(before, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")) & (F.col("part") == F.col("of")))
    return met.select(F.col("place").alias("at"), (F.col("before") + F.col("own")).alias("tie"))


def _copies(draw: Column | int, digest: Column | str = "digest", whole: str = "whole", bound: str = "bound") -> Column:
    """floor(rate), and one more where the draw is under the bound, both as eight hex digits."""
    start = F.lit(1) + F.lit(8) * draw
    return F.col(whole) + (F.substring(digest, start, 8) < F.col(bound)).cast("long")


def _by_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """`rows` with their source's columns; `sources` is shipped whole where there are few."""
    own = fresh(rows, "named")
    named = sources.withColumnRenamed("source", own)
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col(own)), "left").drop(own)


def _rates(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, bound, draw) of each source of `sized` rows, staged; whether they are FEW at most."""
    rated = (
        targets(sized, weights, share, cap)
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("rate"))
        .withColumn("bound", F.lpad(F.lower(F.hex(F.floor((F.col("rate") - F.col("whole")) * float(2**32)).cast("long"))), 8, "0"))
        .drop("rate")
    )
    rated = staged(rated, "mix-rates")
    few = rated.count() <= FEW
    joined = _by_source(sized, rated, few)
    sums = joined.groupBy("source").agg(F.first("target").alias("aim"), *[F.sum(F.col("size") * _copies(i)).alias(f"sum{i}") for i in range(DRAWS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"sum{i}") - F.col("aim")), F.lit(i).alias("draw")) for i in range(DRAWS)]))["draw"]
    return staged(_by_source(rated, sums.select("source", best.alias("draw")), few), "mix-draws"), few


def _drawable(docs: DataFrame, seed: str, at: str = "place") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """`docs`, the sizes of its rows with their digests, and where keys repeat the rows' numbers: `docs` then has the column `at`."""
    sized = _sized(docs)
    repeats = _repeats(sized)
    if repeats.isEmpty():
        return docs, sized.withColumn("digest", _digest(seed, "words", F.lit("0"))), None
    docs = staged(docs.withColumn(at, F.monotonically_increasing_id()), "mix-rows")
    sized = _sized(docs.select("doc_id", "source", "text", F.col(at).alias("place")), "place")
    ties = staged(_ties(sized, repeats), "mix-ties")
    sized = sized.join(ties, F.col("place") == F.col("at"), "left").withColumn("digest", _digest(seed, "words", F.coalesce("tie", F.lit(0)).cast("string")))
    return docs, staged(sized.select("doc_id", "source", "size", "digest"), "mix-drawable"), ties


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Per row of `docs`: doc_id, source, size, source_size, target, copies, taken (words the mix takes)."""
    _, sized, _ = _drawable(docs.select("doc_id", "source", "text"), seed)
    drawn = _by_source(sized, *_rates(sized, weights, share, cap)).withColumn("copies", _copies(F.col("draw")))
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of `docs` as often as `mix` says, with its `copy` number from 1."""
    columns = [c for c in docs.columns if c.lower() != "copy"]
    place, rate, met, tied, copies = (fresh(docs, name) for name in ("place", "rate", "met", "tied", "copies"))
    docs, sized, ties = _drawable(docs, seed, place)
    rates, few = _rates(sized, weights, share, cap)
    drawn = _by_source(docs, rates.select("source", F.struct("whole", "bound", "draw").alias(rate)), few)
    tie = F.lit("0")
    if ties is not None:
        drawn = drawn.join(ties.select(F.col("at").alias(met), F.col("tie").alias(tied)), F.col(place) == F.col(met), "left")
        tie = F.coalesce(tied, F.lit(0)).cast("string")
    taken = _copies(F.col(f"{rate}.draw"), _digest(seed, _text_hash(), tie), f"{rate}.whole", f"{rate}.bound")
    drawn = drawn.withColumn(copies, taken).where(F.col(copies) > 0)
    return drawn.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias("copy"))
