"""Estimates from neighbour distances and clusters of density peaks; extensions, by published rules.

All go by query_id, so ids must not repeat. Lists have each point itself first, as
`knn` gives them; with points that coincide, which of them stands first is the order
of their ids, so distances are what counts here and not who is meant by rank 1.
"""

from __future__ import annotations

from math import gamma, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import hot_keys, spread_join
from ..staging import release, scope, staged

#: Fixed value: the published threshold of the likelihood ratio, a chance of 1e-6 for one degree of freedom.
RATIO = 23.92812698


def two_nn_dimension(neighbours: DataFrame) -> DataFrame:
    """(n, dimension): the intrinsic dimension by the ratio of each point's second to its first distance to others.

    The maximum-likelihood form of the published two-neighbour estimate, n over the sum of the ratios' logarithms; points
    that coincide with another one, or whose two distances are equal throughout, tell nothing. `neighbours` has each
    point itself and two others at least, as `knn` with k of 3 or more gives them.
    """
    near = neighbours.where((F.col("rank") > 1) & (F.col("rank") <= 3)).groupBy("query_id").agg(F.min("d2").alias("first"), F.max("d2").alias("second"), F.count(F.lit(1)).alias("others"))
    usable = near.where((F.col("others") == 2) & (F.col("first") > 0))
    logs = F.sum(F.log(F.col("second") / F.col("first")) / 2)  # distances are squared
    return usable.agg(F.count(F.lit(1)).alias("n"), logs.alias("logs")).select("n", (F.col("n") / F.when(F.col("logs") > 0, F.col("logs"))).alias("dimension"))


def kstar_density(neighbours: DataFrame, dims: float, points: int, ratio: float = RATIO, least: int = 3) -> DataFrame:
    """(query_id, kstar, d2, density): how many neighbours of each point lie in an even density, and that density.

    The published rule: for k = least, least + 1, ... the point and its (k + 1)-th neighbour j are compared, each by the
    volume that its k nearest take; twice the logarithm of the likelihood ratio of one density against two is
    L = 2k * log((Vi + Vj)**2 / (4 * Vi * Vj)). The first k with L >= `ratio` ends it, and kstar is that k less one;
    without such a k it is the largest that the lists can compare, their length less two. d2 is the squared distance of
    the kstar-th neighbour, and the density kstar / (points * volume of that ball), in `dims` dimensions. Two volumes
    of 0 compare as equal, 0 and another as unlike; a density of a ball without volume is infinite. Lists of fewer than
    `least` neighbours beside the point tell nothing, and such points are left out.
    """
    lists = neighbours.select("query_id", "neighbor_id", "d2", (F.col("rank") - 1).alias("k"))
    own = lists.select("query_id", "k", F.col("d2").alias("own")).where(F.col("k") >= least)
    following = lists.select(F.col("query_id").alias("of"), (F.col("k") - 1).alias("at"), "neighbor_id")
    pairs = own.join(following, (F.col("query_id") == F.col("of")) & (F.col("k") == F.col("at"))).select("query_id", "k", "own", "neighbor_id")
    # A point can be the (k + 1)-th neighbour of very many; its distances are then repeated for several tasks.
    other = lists.select(F.col("query_id").alias("j"), F.col("k").alias("j_k"), F.col("d2").alias("other")).where(F.col("j_k") >= least)
    hot = hot_keys(pairs.groupBy("neighbor_id", "k").agg(F.count(F.lit(1)).alias("n")))
    met = spread_join(pairs, other, ["neighbor_id", "k"], ["j", "j_k"], "query_id", hot)
    half = F.lit(dims / 4.0) * (F.log("own") - F.log("other"))  # half the logarithm of the volumes' ratio
    told = F.when((F.col("own") > 0) & (F.col("other") > 0), 4 * F.col("k") * F.log(F.cosh(F.least(F.abs(half), F.lit(300.0))))).when(F.col("own") == F.col("other"), 0.0).otherwise(float("inf"))
    ends = met.where(told >= ratio).groupBy(F.col("query_id").alias("of")).agg(F.min("k").alias("first"))
    longest = lists.groupBy(F.col("query_id").alias("p")).agg((F.max("k") - 1).alias("most")).where(F.col("most") >= least)
    kstar = longest.join(ends, F.col("p") == F.col("of"), "left").select("p", F.coalesce(F.col("first") - 1, F.col("most")).cast("int").alias("kstar"))
    at = lists.select(F.col("query_id").alias("q"), F.col("k").alias("q_k"), "d2")
    found = kstar.join(at, (F.col("p") == F.col("q")) & (F.col("kstar") == F.col("q_k")))
    unit = pi ** (dims / 2) / gamma(dims / 2 + 1)
    ball = F.lit(unit * points) * F.pow("d2", F.lit(dims / 2))
    return found.select(F.col("p").alias("query_id"), "kstar", "d2", F.when(ball > 0, F.col("kstar") / F.when(ball > 0, ball)).otherwise(float("inf")).alias("density"))


def nearest_denser(neighbours: DataFrame, densities: DataFrame) -> DataFrame:
    """(id, up): for each point of `densities` (query_id, kstar, density) the first of its kstar neighbours that is denser, or
    as dense with a lesser id; a point without one is a peak, and its own `up`."""
    named = densities.select(F.col("query_id").alias("j"), F.col("density").alias("j_density"))
    own = densities.select(F.col("query_id").alias("id"), "kstar", "density")
    # From 1, but by the order in the list: the point itself need not stand first where points coincide.
    near = neighbours.select("query_id", "neighbor_id", "rank").where("query_id != neighbor_id")
    listed = own.join(near, (F.col("id") == F.col("query_id")) & (F.col("rank") <= F.col("kstar") + 1)).select("id", "density", "neighbor_id", "rank")
    hot = hot_keys(listed.groupBy("neighbor_id").agg(F.count(F.lit(1)).alias("n")))
    met = spread_join(listed, named, ["neighbor_id"], ["j"], "id", hot)
    denser = (F.col("j_density") > F.col("density")) | ((F.col("j_density") == F.col("density")) & (F.col("neighbor_id") < F.col("id")))
    first = met.where(denser).groupBy(F.col("id").alias("of")).agg(F.min_by("neighbor_id", "rank").alias("next"))
    return own.join(first, F.col("id") == F.col("of"), "left").select("id", F.coalesce("next", "id").alias("up"))


def pointer_ends(pointers: DataFrame) -> DataFrame:
    """(id, up): where each path of the staged `pointers` (id, up) ends, at an id that is its own `up`; they are released.

    Pointer doubling: each round every row takes the pointer of what it points to, so paths halve; an end that very
    many have reached is dealt over tasks.
    """
    at = pointers
    with scope(pointers.sparkSession) as kept:
        while True:
            ends = at.select(F.col("id").alias("to"), F.col("up").alias("further"))
            hot = hot_keys(at.groupBy("up").agg(F.count(F.lit(1)).alias("n")))
            moved = spread_join(at, ends, ["up"], ["to"], "id", hot).select("id", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved"))
            following = staged(moved, "pointers")
            done = following.where("moved").isEmpty()
            release(at)
            at = following
            if done:
                return kept.keep(at).drop("moved")


def density_peaks(neighbours: DataFrame, densities: DataFrame) -> DataFrame:
    """(query_id, peak): the peak that each point climbs to, from denser neighbour to denser neighbour."""
    ends = pointer_ends(staged(nearest_denser(neighbours, densities), "pointers"))
    return ends.select(F.col("id").alias("query_id"), F.col("up").alias("peak"))
