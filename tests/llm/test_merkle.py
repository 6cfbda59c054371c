"""The manifest against one made by plain loops."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vicinia.llm import merkle

from .docs import AWKWARD, texts

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return sha(*[field(v) for v in (row[0], row[1], row[2], row[3], row[4])])


def climb(nodes):
    """All levels over `nodes`."""
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([sha(*made[-1][i : i + 16]) for i in range(0, len(made[-1]), 16)])
    return made


def path(made, at):
    out = []
    for level in made[:-1]:
        start = at // 16 * 16
        run = level[start : start + 16]
        out.append((run[: at - start], run[at - start + 1 :]))
        at //= 16
    return out


def expected(rows):
    named = {}
    for row in rows:
        named.setdefault(row[1], []).append(row)
    names = sorted(named, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(named[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = own, climb([leaf(r) for r in own])
    top = climb([trees[n][1][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        own, made = trees[name]
        for at, row in enumerate(own):
            steps = path(made, at) + path(top, place)
            now = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                low = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                now = leaf((*row[:4], low))
            for left, right in steps:
                now = sha(*left, now, *right)
            proof = sha(*[x for left, right in steps for x in (*left, *right)])
            out.append((row[0], leaf(row), made[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def check(spark, rows, slices=3):
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), SCHEMA)
    got = merkle.verified(docs.withColumns({c: F.lit(i) for i, c in enumerate(("tree", "pos", "node", "path", "at", "size"))}), merkle.every_fifth())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected(rows)))


def test_many_sizes(spark):
    """Sources of one leaf, of a run, of one more than a run, and of more than two levels; more than 16 of them."""
    sizes, rows, at = [1, 2, 15, 16, 17, 32, 33, 300, *[1] * 14], [], 0
    for source, size in enumerate(sizes):
        for _ in range(size):
            rows.append(((at * 7919) % 1009 if source % 3 else at, None if source == 2 else f"s{source}é", "en" if at % 3 else None, at if at % 4 else None, f"Text {at} ÉA" if at % 5 else None))
            at += 1
    check(spark, rows, 5)


def test_awkward_rows(spark):
    rows = [(None if i % 4 == 0 else i % 5, [None, "", "b", "a", "-", "0", "1"][i % 7], None, None, t) for i, t in enumerate([*AWKWARD, *texts(30), *AWKWARD])]
    check(spark, [*rows, *rows[:9], *rows[:9]])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(5, "a", "b", 1, "X"), (5, "a", "b", 1, "X")]])
def test_few_rows(spark, rows):
    check(spark, rows, 1)


def test_a_crowd_of_equal_rows_is_ranged_over_tasks(spark):
    """Rows that are alike throughout are many leaves, and no range holds much more than its part of them."""
    leaves = spark.range(4000).select(F.lit("1a").alias("tree"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit(b"x").alias("node"), F.monotonically_increasing_id().alias("deal"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = leaves.repartitionByRange("tree", "doc_id", "node", "deal").groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in ranged.collect()) < 1200
        got = merkle.numbered(leaves, "doc_id", "node", "deal")
        assert sorted(r["pos"] for r in got.collect()) == list(range(4000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
