"""Clusters of density peaks: borders between peaks, merges of peaks that do not stand out, cores and halo; extensions, by published rules.

`densities` and `peaks` are those of `operators.density`; ids must not repeat. With
k = kstar, a point's logarithm of density has the error sqrt((4k + 2) / (k (k - 1))),
which is infinite for k = 1. A density that is infinite has no error. Nothing here is
held by the driver or grows in one task with a cluster: what is tied to a cluster of
very many points, or to a peak with very many borders, is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import hot_keys, spread_join
from ..staging import release, scope, staged
from .cells import global_numbers
from .density import density_peaks, kstar_density, pointer_ends, two_nn_dimension


def with_error(densities: DataFrame) -> DataFrame:
    """(id, kstar, log_rho, err) of `densities` (query_id, kstar, density)."""
    k = F.col("kstar")
    err = F.when(F.col("density") == float("inf"), 0.0).when(k > 1, F.sqrt((4 * k + 2) / F.greatest(k * (k - 1), F.lit(1)))).otherwise(float("inf"))
    return densities.select(F.col("query_id").alias("id"), "kstar", F.log("density").alias("log_rho"), err.alias("err"))


def borders(neighbours: DataFrame, densities: DataFrame, peaks: DataFrame) -> DataFrame:
    """(a, b, saddle, log_rho, err): the border of each two peaks a < b that have one, and its saddle.

    A point borders on another peak by its first neighbour of that peak, if that is among its kstar neighbours, and if the
    point is in turn that neighbour's first one of the point's own peak. The saddle is the border point, of either
    peak, whose log_rho - err is the largest, the one with the least id among equals. Points without a density
    have no peak and border on nothing.
    """
    with scope(neighbours.sparkSession) as kept:
        own = with_error(densities).join(peaks.select(F.col("query_id").alias("p"), F.col("peak").alias("own")), F.col("id") == F.col("p")).drop("p")
        named = peaks.select(F.col("query_id").alias("j"), F.col("peak").alias("other"))
        listed = own.join(neighbours.select("query_id", "neighbor_id", "rank"), F.col("id") == F.col("query_id"))
        hot = hot_keys(neighbours.groupBy("neighbor_id").agg(F.count(F.lit(1)).alias("n")))
        met = spread_join(listed, named, ["neighbor_id"], ["j"], "id", hot).where("own != other")
        first = staged(met.groupBy("id", "own", "other", "kstar", "log_rho", "err").agg(F.min_by("neighbor_id", "rank").alias("near"), F.min("rank").alias("rank")), "first-of-peaks")
        back = first.select(F.col("id").alias("back_id"), F.col("near").alias("back_near"))
        border = first.where(F.col("rank") <= F.col("kstar") + 1).join(back, (F.col("near") == F.col("back_id")) & (F.col("id") == F.col("back_near")))
        best = F.min_by(F.struct(F.col("id").alias("saddle"), "log_rho", "err"), F.struct(F.col("err") - F.col("log_rho"), "id")).alias("best")
        pairs = border.groupBy(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(best)
        return kept.keep(staged(pairs.select("a", "b", "best.*"), "borders"))


def _margin(z: float) -> Column:
    return z * F.col("err") if z else F.lit(0.0)


def merged_peaks(densities: DataFrame, peaks: DataFrame, saddles: DataFrame, z: float) -> DataFrame:
    """(peak, cluster): the cluster of each peak, named by the peak in it that stands out most.

    A peak's level is log_rho - z * err, a cluster's the highest of its peaks', and it is named by that peak, the least of
    equals. A saddle's ceiling is log_rho + z * err. Saddles are met by falling ceiling (then by a and b); the two
    clusters that one connects by then become one if the lower one's level is below the ceiling, that is if either
    does not stand out from the saddle by z times both errors.

    Rounds instead of one saddle after another give the same: levels only rise, so a saddle that is below both levels
    is done with; and a cluster below the highest ceiling of what is left to it will merge by that saddle, as nothing can
    change the cluster before. All such clusters are joined at once. A cluster that merges into one that is not of
    this kind leaves it with nothing it could merge by, and the others are at least halved, so the rounds are as few as
    the logarithm of the peaks.
    """
    with scope(peaks.sparkSession) as kept:
        tops = peaks.where(F.col("query_id") == F.col("peak")).select("peak")
        levels = staged(with_error(densities).join(tops, F.col("id") == F.col("peak")).select("peak", (F.col("log_rho") - _margin(z)).alias("level")), "peak-levels")
        a, b = (levels.select(F.col("peak").alias(f"of_{side}"), F.col("level").alias(f"level_{side}")) for side in "ab")
        rated = saddles.select("a", "b", (-F.col("log_rho") - _margin(z)).alias("low"), F.col("a").alias("p"), F.col("b").alias("q"))
        for ends, side in ((a, "a"), (b, "b")):
            rated = spread_join(rated, ends, [side], [f"of_{side}"], "p" if side == "b" else "q", hot_keys(saddles.groupBy(side).agg(F.count(F.lit(1)).alias("n")))).drop(f"of_{side}")
        live = F.least("level_a", "level_b") < -F.col("low")
        edges = staged(rated.where(live), "peak-edges")
        at = staged(levels.select("peak", F.col("peak").alias("node")), "peak-nodes")
        while not edges.isEmpty():
            roots = _contracted(edges)
            # Edges go over to the clusters of this round; of several between the same two the first by order stays.
            moved = edges.drop("level_a", "level_b")
            for side, by in (("a", "q"), ("b", "p")):
                to = roots.select(F.col("node").alias("was"), F.col("root").alias(f"root_{side}"), F.col("level").alias(f"level_{side}"))
                moved = spread_join(moved, to, [side], ["was"], by, hot_keys(edges.groupBy(side).agg(F.count(F.lit(1)).alias("n")))).drop("was", side).withColumnRenamed(f"root_{side}", side)
            apart = moved.where((F.col("a") != F.col("b")) & live).select(
                F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("level_a")).otherwise(F.col("level_b")).alias("level_a"), F.when(F.col("a") < F.col("b"), F.col("level_b")).otherwise(F.col("level_a")).alias("level_b"), "low", "p", "q"
            )
            following = staged(apart.groupBy("a", "b", "level_a", "level_b").agg(F.min(F.struct("low", "p", "q")).alias("top")).select("a", "b", "level_a", "level_b", "top.*"), "peak-edges")
            to = roots.select(F.col("node").alias("was"), "root")
            there = spread_join(at, to, ["node"], ["was"], "peak", hot_keys(at.groupBy("node").agg(F.count(F.lit(1)).alias("n"))), "left").select("peak", F.coalesce("root", "node").alias("node"))
            nodes = staged(there, "peak-nodes")
            release(edges, at, roots)
            edges, at = following, nodes
        names = at.join(levels.withColumnRenamed("peak", "own"), F.col("peak") == F.col("own")).groupBy(F.col("node").alias("of")).agg(F.min(F.struct((-F.col("level")).alias("by"), "peak"))["peak"].alias("cluster"))
        hot = hot_keys(at.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
        return kept.keep(staged(spread_join(at, names, ["node"], ["of"], "peak", hot).select("peak", "cluster"), "merged-peaks"))


def _contracted(edges: DataFrame) -> DataFrame:
    """(node, root, level), staged: what each node of `edges` (a, b, level_a, level_b, low, p, q) becomes part of in a round, and the level of that."""
    ways = [edges.select(F.col(x).alias("id"), F.col(f"level_{x}").alias("level"), F.struct("low", "p", "q", F.col(y).alias("to"), F.col(f"level_{y}").alias("to_level")).alias("top")) for x, y in ("ab", "ba")]
    tops = staged(ways[0].union(ways[1]).groupBy("id", "level").agg(F.min("top").alias("top")).select("id", "level", "top.*"), "top-edges")
    sure = tops.where(F.col("level") < -F.col("low"))
    # Two that have the same saddle at the top point to each other; the higher one, the lesser id of equals, stays.
    back = sure.select(F.col("id").alias("other"), F.col("to").alias("its"))
    stays = (F.col("level") > F.col("to_level")) | ((F.col("level") == F.col("to_level")) & (F.col("id") < F.col("to")))
    mutual = sure.join(back, (F.col("to") == F.col("other")) & (F.col("id") == F.col("its")), "left")
    up = mutual.select("id", F.when(F.col("other").isNotNull() & stays, F.col("id")).otherwise(F.col("to")).alias("up"))
    rest = tops.where(~(F.col("level") < -F.col("low"))).select("id", F.col("id").alias("up"))
    ends = pointer_ends(staged(up.union(rest), "peak-pointers"))
    placed = ends.join(tops.select(F.col("id").alias("node"), "level"), F.col("id") == F.col("node")).select("node", F.col("up").alias("root"), "level")
    heights = placed.groupBy(F.col("root").alias("of")).agg(F.max("level").alias("height"))
    hot = hot_keys(ends.groupBy("up").agg(F.count(F.lit(1)).alias("n")))
    out = staged(spread_join(placed, heights, ["root"], ["of"], "node", hot).select("node", "root", F.col("height").alias("level")), "peak-roots")
    release(tops)
    return out


def assignment(densities: DataFrame, peaks: DataFrame, saddles: DataFrame, merged: DataFrame) -> DataFrame:
    """(query_id, cluster, label, halo): the cluster of each point, and whether it is of the cluster's halo.

    A cluster's rim is the largest log_rho of a saddle between one of its peaks and a peak of another cluster; points below
    the rim are halo, all others core, and all are where no such saddle is. Clusters are numbered from 0 by the id of
    the peak that names them; a core point's label is that number n, a halo point's -n - 1.
    """
    with scope(peaks.sparkSession) as kept:
        sided = saddles.select("a", "b", "log_rho")
        for side, by in (("a", "b"), ("b", "a")):
            to = merged.select(F.col("peak").alias("of"), F.col("cluster").alias(f"cluster_{side}"))
            sided = spread_join(sided, to, [side], ["of"], by, hot_keys(saddles.groupBy(side).agg(F.count(F.lit(1)).alias("n")))).drop("of")
        apart = sided.where("cluster_a != cluster_b")
        rims = apart.select(F.explode(F.array("cluster_a", "cluster_b")).alias("rimmed"), "log_rho").groupBy("rimmed").agg(F.max("log_rho").alias("rim"))
        numbers = global_numbers(merged.select(F.lit(0).alias("cell"), F.col("cluster").alias("id")).distinct())
        clusters = numbers.join(rims, F.col("id") == F.col("rimmed"), "left").select("id", "rim", "number")
        hot = hot_keys(merged.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
        told = staged(spread_join(merged, clusters, ["cluster"], ["id"], "peak", hot).select(F.col("peak").alias("of"), "cluster", "rim", "number"), "rims")
        points = peaks.join(with_error(densities).select("id", "log_rho"), F.col("query_id") == F.col("id")).select("query_id", "peak", "log_rho")
        found = spread_join(points, told, ["peak"], ["of"], "query_id", hot_keys(peaks.groupBy("peak").agg(F.count(F.lit(1)).alias("n"))))
        halo = F.coalesce(F.col("log_rho") < F.col("rim"), F.lit(False))
        return kept.keep(staged(found.select("query_id", "cluster", F.when(halo, -F.col("number") - 1).otherwise(F.col("number")).alias("label"), halo.alias("halo")), "assignment"))


def density_clusters(neighbours: DataFrame, points: int, dims: float, z: float) -> DataFrame:
    """`assignment` of all `points` from their `neighbours` alone: densities, peaks, borders and merges one after another.

    Densities are taken in the dimension that the neighbours tell (`two_nn_dimension`), in `dims` where they tell none.
    Points whose lists have fewer than four others have no density and are left out.
    """
    with scope(neighbours.sparkSession) as kept:
        told = two_nn_dimension(neighbours).first()["dimension"]
        dense = staged(kstar_density(neighbours, dims if told is None else told, points), "densities")
        peaks = density_peaks(neighbours, dense)
        saddles = borders(neighbours, dense, peaks)
        return kept.keep(assignment(dense, peaks, saddles, merged_peaks(dense, peaks, saddles, z)))
