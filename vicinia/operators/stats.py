"""Column statistics, boxes, histograms and quantiles of wide tables; every one is a few partial and final aggregations.

Exact quantiles and medians close in on their places by histograms, until few rows
are left between the bounds, and only those are put in order: no buffer, of a task
or of the driver, grows with the rows. Nulls are left out everywhere. In an order,
-infinity comes before all numbers, infinity behind them, and NaN behind that; such
rows are counted and set aside, so only numbers are searched for, and every round
tells some of them apart. Histograms leave them out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_BINS, DEFAULT_TOLERANCE
from ..skew import hot_keys, spread_join
from ..staging import release, scope, staged

#: Rows of a group that are put in order by one task, bins of a closing histogram, and groups whose bounds are shipped whole.
FEW, CLOSING_BINS, SHIPPED = 1 << 14, 256, 10_000


def mean_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dim, column, mean, std, n): one row a column, the standard deviation that of a sample."""
    one = df.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.lit(c).alias("column"), F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std"), F.col(f"n_{i}").alias("n")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def bounding_box(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """lo_<column> and hi_<column>, for each group of `by` or for all."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))])


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The equi-width bin of `x`, from 0; `high` itself is in the last one, and a box without width has the first only."""
    width = (high - low) / bins
    return F.when(width > 0, F.least(F.floor((x - low) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0).cast("int")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def closing_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """As `bin_of` where low < high, so that `low` and `high` never share a bin: where their distance or its part has no
    number of its own, there are two halves."""
    width = (high - low) / bins
    middle = low / 2 + high / 2
    halves = (x > F.when(middle < high, middle).otherwise(low)).cast("int")
    split = bin_of(x, low, high, bins)
    return F.when((width > 0) & finite(width) & (low + width > low), split).otherwise(halves)


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """(bin, low, high, n) of the bins between a column's extremes that have rows; nulls and what is not finite are left out."""
    df = df.where(finite(F.col(column).cast("double")))
    box = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    counted = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x")).crossJoin(F.broadcast(box))  # one row
    counted = counted.groupBy(bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def cdf_at(df: DataFrame, column: str, x: float) -> DataFrame:
    """(x, n_below, n, share): rows at or below `x`."""
    below = F.sum((F.col(column) <= x).cast("long"))
    return df.where(F.col(column).isNotNull()).agg(F.coalesce(below, F.lit(0)).alias("n_below"), F.count(F.lit(1)).alias("n")).select(F.lit(float(x)).alias("x"), "n_below", "n", (F.col("n_below") / F.when(F.col("n") > 0, F.col("n"))).alias("share"))


def quantile_search(df: DataFrame, column: str, share: float, bins: int = DEFAULT_BINS, tolerance: float = DEFAULT_TOLERANCE, most: int = 60) -> tuple[float, float] | None:
    """(x, share of rows at or below it) with that share within `tolerance` of `share`, by histograms that close in.

    Each round bins the rows of the bin that the share falls into and takes the edge beyond which it lies; one
    aggregation a round, of `bins` counts. Where rows of one value alone make the tolerance unreachable, that value
    is the answer. None without rows.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    low, high, inside, below, above, n = rows.agg(*_order_counts()).first()
    if not n:
        return None
    if below and (below / n >= share - tolerance or not inside):
        return float("-inf"), below / n
    if (below + inside) / n < share - tolerance or not inside:
        return (float("inf"), (below + inside + above) / n) if above and (below + inside + above) / n >= share - tolerance else (float("nan"), 1.0)
    rows = rows.where(finite(F.col("x")))  # `below` rows lie before `low`
    first, set_aside = (low, high), below
    for _ in range(most):
        if low == high:
            break
        inside = rows.where((F.col("x") >= low) & (F.col("x") <= high)) if (low, high) != first else rows
        cut = closing_bin(F.col("x"), F.lit(low), F.lit(high), bins)
        found = {r["bin"]: r for r in inside.groupBy(cut.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}  # `bins` rows at most
        seen = below
        for b in sorted(found):
            if abs((seen + found[b]["n"]) / n - share) <= tolerance:
                return found[b]["hi"], (seen + found[b]["n"]) / n
            if (seen + found[b]["n"]) / n > share:
                break
            seen += found[b]["n"]
        if (found[b]["lo"], found[b]["hi"]) == (low, high) and len(found) == 1:
            break
        below, low, high = seen, found[b]["lo"], found[b]["hi"]
    return high, (set_aside + rows.where(F.col("x") <= high).count()) / n


def _order_counts() -> list[Column]:
    """low and high of the numbers x, how many there are, how many -infinities and infinities, and how many rows with NaN."""
    x, own = F.col("x"), finite(F.col("x"))
    return [F.min(F.when(own, x)).alias("low"), F.max(F.when(own, x)).alias("high"), F.count_if(own).alias("left"), F.count_if(x == float("-inf")).alias("below"), F.count_if(x == float("inf")).alias("above"), F.count("x").alias("n")]


def _at(place: Column, found: Column) -> Column:
    """The element at a place in order: `found` where it is a number."""
    endless = [F.lit(float(v)) for v in ("-inf", "inf", "nan")]
    return F.when(place < F.col("below"), endless[0]).when(place < F.col("below") + F.col("left"), found).when(place < F.col("below") + F.col("left") + F.col("above"), endless[1]).otherwise(endless[2])


def _among_numbers(places: DataFrame) -> DataFrame:
    """Of `places` those at numbers, counted among these."""
    return places.where((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("left"))).withColumn("place", F.col("place") - F.col("below"))


def histogram_quantile(df: DataFrame, column: str, share: float, bins: int = DEFAULT_BINS) -> DataFrame:
    """(bin, x): the first bin at whose end at least `share` of the rows lie, and the place in it that the share falls on,
    as if its rows were spread evenly. The window runs over `bins` rows at most."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = histogram(df, column, bins).withColumn("seen", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    first = counted.where(F.col("seen") / F.col("total") >= share).orderBy("bin").limit(1)
    before = (F.col("seen") - F.col("n")) / F.col("total")
    inside = (F.lit(float(share)) - before) / (F.col("seen") / F.col("total") - before)
    return first.select("bin", (F.col("low") + inside * (F.col("high") - F.col("low"))).alias("x"))


def _meet_bounds(rows: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """`rows` (by..., x) with the bounds (by..., tag, low, high, place) of their group, those between them only."""
    renamed = bounds.select(*[F.col(c).alias(f"of_{c}") for c in by], "tag", "low", "high", "place")
    inside = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    if bounds.count() <= SHIPPED:
        met = rows.join(F.broadcast(renamed), [*same, inside])
    else:  # a row a group and tag, so a key's rows meet one or a few
        told = F.xxhash64(*by) if by else F.lit(0).cast("long")
        keyed = rows.withColumn("key", told)
        hot = hot_keys(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        other = renamed.withColumn("other", F.xxhash64(*[f"of_{c}" for c in by]) if by else F.lit(0).cast("long"))
        met = spread_join(keyed, other, ["key"], ["other"], "x", hot).where(F.expr("true") if not same else same[0]).where(inside)
        for condition in same[1:]:
            met = met.where(condition)
    return met.select(*by, "tag", "x", "low", "high", "place")


def at_places(rows: DataFrame, places: DataFrame, by: Sequence[str] = (), bins: int = CLOSING_BINS) -> DataFrame:
    """(by..., tag, x): the element of `rows` (by..., x: double) at each of `places` (by..., tag, low, high, place, left) in order.

    A place counts from 0 among the `left` rows between `low` and `high`, all of them numbers. A round counts the rows of each bin between
    the bounds, and goes on with the one that the place falls into, whose extremes are the new bounds.
    """
    bounds = staged(places.select(*by, "tag", "low", "high", "place", "left"), "bounds")
    while bounds.where((F.col("low") < F.col("high")) & (F.col("left") > FEW)).limit(1).count():
        closed = bounds.where((F.col("low") == F.col("high")) | (F.col("left") <= FEW))
        cut = closing_bin(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin")
        met = _meet_bounds(rows, bounds.where((F.col("low") < F.col("high")) & (F.col("left") > FEW)), by)
        counted = met.groupBy(*by, "tag", "place", cut).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        seen = F.sum("n").over(Window.partitionBy(*by, "tag").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        own = counted.withColumn("seen", seen).where((F.col("seen") > F.col("place")) & (F.col("seen") - F.col("n") <= F.col("place")))
        closer = own.select(*by, "tag", "low", "high", (F.col("place") - F.col("seen") + F.col("n")).alias("place"), F.col("n").alias("left"))
        following = staged(closed.unionByName(closer), "bounds")
        release(bounds)
        bounds = following
    alike = bounds.where("low = high").select(*by, "tag", F.col("low").alias("x"))
    ordered = Window.partitionBy(*by, "tag").orderBy("x")
    rest = _meet_bounds(rows, bounds.where("low < high"), by).withColumn("at", F.row_number().over(ordered) - 1)
    return alike.unionByName(rest.where("at = place").select(*by, "tag", "x"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, x) of the interpolated quantiles; x is null without rows. Between two infinities, or beside NaN, x is what
    interpolation gives."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    with scope(df.sparkSession) as own:
        whole = staged(rows.agg(*_order_counts()), "whole")
        asked = whole.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("position", F.col("share") * (F.col("n") - 1))
        both = (("lower", F.floor("position").cast("long")), ("upper", F.ceil("position").cast("long")))
        sides = [asked.where("n > 0").withColumns({"tag": F.struct("share", F.lit(name).alias("side")), "place": place}) for name, place in both]
        found = at_places(rows.where(finite(F.col("x"))), _among_numbers(sides[0].unionByName(sides[1])))
        values = found.groupBy(F.col("tag.share").alias("of")).agg(*[F.max(F.when(F.col("tag.side") == name, F.col("x"))).alias(name) for name, _ in both])
        met = asked.join(F.broadcast(values), F.col("share") == F.col("of"), "left")  # a row a share
        lower, upper = (_at(place, F.col(name)) for name, place in both)
        inside = F.col("position") - F.floor("position")
        x = F.when(F.col("n") > 0, F.when((inside == 0) | (lower == upper), lower).otherwise((1 - inside) * lower + inside * upper))
        return own.keep(staged(met.select("share", x.alias("x")), "quantiles"))


def upper_median(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., median, n): the element at place n // 2 of each group in order: of an even number, the upper of the middle two."""
    rows = df.select(*by, F.col(column).cast("double").alias("x"))
    with scope(df.sparkSession) as own:
        groups = staged(rows.groupBy(*by).agg(*_order_counts()).withColumn("place", F.floor(F.col("n") / 2).cast("long")), "groups")
        found = at_places(rows.where(finite(F.col("x"))), _among_numbers(groups.where("n > 0")).withColumn("tag", F.lit(0)), by).select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("x").alias("found"))
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by] or F.lit(True)
        met = groups.join(found, same, "left").withColumn("median", F.when(F.col("n") > 0, _at(F.col("place"), F.col("found"))))
        return own.keep(staged(met.select(*by, "median", "n"), "medians"))
