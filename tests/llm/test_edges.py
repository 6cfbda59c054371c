"""Shared cases that every operator has to stand: empty tables, nulls in any column, repeated rows, columns of clashing names."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vicinia.llm import decontamination, line_dedup, media, minhash, mixing, pii, quality, secret_scan, tokens, toxicity

from .docs import AWKWARD, table, texts

NAMES = ["key", "id", "score", "kept", "node", "h", "h1", "n", "size", "named", "digest", "whole", "bound", "draw", "target", "place", "window", "item", "total", "rules", "found", "batch", "media", "row", "at", "component"]


def clashing(spark, docs, ids=None):
    """Documents whose further columns have the names that operators use inside."""
    df = table(spark, docs, ids, extra=False)
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def per_row(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 1)], "item_id long, text string, row int")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(40)], "doc_id long, toxic int, size int")
    return {
        "toxicity": lambda d: toxicity.toxic_scores(d, labels),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "minhash": lambda d: minhash.near_duplicates(d),
        "media": lambda d: media.media_digests(d),
        "pii": lambda d: pii.find_personal_data(d),
        "mixing": lambda d: mixing.mix(d),
        "tokens": lambda d: tokens.count_tokens(d),
        "secrets": lambda d: secret_scan.find_secrets(d),
        "templates": lambda d: decontamination.decontaminate(d, bench),
    }


@pytest.mark.parametrize("name", ["toxicity", "lines", "minhash", "media", "pii", "mixing", "tokens", "secrets", "templates"])
def test_clashes_nulls_and_repeats(spark, name):
    docs = [*AWKWARD, *texts(6), "same", "same"]
    docs = docs + docs
    ids = [None if i % 4 == 1 else i % (len(docs) // 2) for i in range(len(docs))]
    operator = per_row(spark)[name]
    out = operator(clashing(spark, docs, ids))
    assert out.count() == len(docs)
    plain = operator(table(spark, docs, ids, extra=False))
    shared = [c for c in plain.columns if c in out.columns and c not in NAMES]
    assert sorted(map(str, out.select(shared).collect())) == sorted(map(str, plain.select(shared).collect()))
    assert operator(clashing(spark, [])).count() == 0


def test_filters_keep_columns(spark):
    docs = clashing(spark, [*AWKWARD, *texts(5)])
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (line_dedup.dedup_lines(docs).select(docs.columns), minhash.deduplicated(docs), decontamination.decontaminate(docs, bench), mixing.mixed_documents(docs).select(docs.columns)):
        assert out.columns == docs.columns and out.count() > 0


def inner_names():
    """Every name of a column that stands in the sources of the operators: quoted words that are no columns of documents."""
    here = Path(decontamination.__file__).parent
    found = {m for f in [*here.glob("*.py"), here.parent / "skew.py"] for m in re.findall(r'["\'](_{0,2}[a-z][a-z_0-9]*)["\']', f.read_text())}
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars", "copy"})


@pytest.mark.parametrize("change", [str.lower, lambda n: f"__{n}".upper()])
def test_filters_stand_every_inner_name(spark, change):
    docs = [*AWKWARD, *texts(8), "same", "same", "same", "shouted " * 30]
    docs = [*docs, *docs[:5]]
    plain = table(spark, docs, [None if i % 5 == 2 else i % 9 for i in range(len(docs))], extra=False)
    names = [n for n in dict.fromkeys(change(n) for n in [*inner_names(), "__place", "__rate", "__named", "__at", "__tie", "__copies", "__id", "__score"]) if n.lower() != "copy"]
    odd = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    bench = spark.createDataFrame([(1, docs[13]), (2, "same")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    filters = {
        "toxicity": lambda d: toxicity.without_toxic(d, labels),
        "lines": lambda d: line_dedup.dedup_lines(d, min_docs=3).drop("n_lines", "n_dropped"),
        "near": minhash.deduplicated,
        "templates": lambda d: decontamination.decontaminate(d, bench),
        "mixing": lambda d: mixing.mixed_documents(d).drop("copy"),
        "quality": lambda d: quality.above_quality(d, labels),
    }
    for name, f in filters.items():
        if name == "lines":  # its figures are columns of the result
            odd_now = odd.drop("n_lines", "n_dropped")
        else:
            odd_now = odd
        got, want = f(odd_now), f(plain)
        assert got.columns == odd_now.columns, name
        assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, want.collect())), name
        kept = [c for c in names if c in odd_now.columns]
        assert got.select(*[F.max(F.col(f"`{c}`") != names.index(c)).alias(f"x{i}") for i, c in enumerate(kept)]).first() == tuple([False] * len(kept)), name
