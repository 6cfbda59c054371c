"""Quality ranking: its fit, features and threshold, and its accuracy on texts that were held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.llm import quality

from .docs import AWKWARD, table, texts


def test_features_of_whole_texts():
    assert not quality.features(None).any() and not quality.features("").any()
    shares = dict(zip(quality.SHARES, quality.features("AB cd cd\nAB cd cd\n!x")[-len(quality.SHARES) :]))
    assert shares["upper"] == 4 / 13 and shares["distinct_words"] == 3 / 7 and shares["top_word"] == 4 / 7 and shares["distinct_lines"] == 2 / 3
    assert shares["marks"] == 1 / 20 and shares["capital_words"] == 2 / 7 and shares["one_letter_words"] == 0
    long = " ".join(texts(200)) * 90
    assert len(long) > 2 * quality.CHUNK
    found = quality.features(long + " ÄÖ!! last")
    data = np.frombuffer((long + " ÄÖ!! last").encode(), np.uint8)
    whole = quality._trigrams(quality.KIND[data], quality.N_KINDS, quality.KINDS)
    assert np.allclose(found[: quality.KINDS], np.sqrt(whole / whole.sum()))


def test_fit_pairs_is_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    left, right = rng.integers(0, 60, (2, 300))
    w = quality.fit_pairs(x, left, right, ridge=0.1)

    def loss(v):
        return np.logaddexp(0, -((x[left] - x[right]) @ v)).mean() + 0.05 * v @ v

    for i in range(5):
        for step in (1e-3, -1e-3):
            assert loss(w) <= loss(w + step * np.eye(5)[i])


def test_pairs_cover_all():
    left, right = quality.preference_pairs(10, 37)
    assert len(left) == len(right) == 37 * quality.PAIRS
    assert np.bincount(left, minlength=10).min() >= quality.PAIRS and np.bincount(right, minlength=37).min() == quality.PAIRS


def shouted(text):
    return " ".join(f"{w.upper()}!!" for w in text.split())


def marked(spark, n=400):
    """Documents and labels: every fourth one shouts."""
    docs = [shouted(t) if i % 4 == 0 else t for i, t in enumerate(texts(n, seed=4, words=60))]
    return table(spark, docs), spark.createDataFrame([(i, int(i % 4 != 0), 0, 1) for i in range(0, n, 2)], "doc_id long, quality int, toxic int, raw int")


def test_held_out(spark):
    docs, labels = marked(spark)
    out = quality.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    out = out.toPandas()
    assert len(out) == 400 and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    assert ((out["doc_id"] % 4 != 0) == (out["predicted"] == 1)).mean() > 0.99


def test_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    met = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (met["quality"] == met["predicted"]).mean() > 0.97


def test_only_labels_that_may_be_learned_from_count(spark):
    """Labels of held-out documents can be turned round without any score changing, and other columns are no inputs."""
    docs, labels = marked(spark, 200)
    held = ~quality.taught()
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"source": F.lit("z"), "lang": F.lit("q"), "n_chars": F.lit(0)})
    first, second = (sorted(map(tuple, quality.quality_scores(d, x).collect())) for d, x in ((docs, labels), (other, turned)))
    assert first == second


def test_awkward(spark):
    docs, labels = marked(spark, 120)
    odd = table(spark, [*AWKWARD, *AWKWARD], [None if i % 3 == 0 else 5000 + i % 12 for i in range(2 * len(AWKWARD))])
    named = docs.unionByName(odd).withColumnRenamed("key", "raw").withColumnRenamed("id", "_raw").withColumnRenamed("node", "own_id").withColumnRenamed("kept", "SCORE_")
    out = quality.quality_scores(named, labels)
    assert out.count() == 120 + 2 * len(AWKWARD) and out.where("score is null or isnan(score)").count() == 0
    kept = quality.above_quality(named, labels)
    assert kept.columns == named.columns and kept.where("doc_id < 120").count() == 90
    plain = quality.scores(named, labels, "q")
    assert plain.columns == [*named.columns, "q"] and plain.count() == named.count()


@pytest.mark.parametrize("label", [0, 1, None])
def test_one_class_or_none(spark, label):
    docs, labels = marked(spark, 40)
    told = labels.withColumn("quality", F.lit(label).cast("int"))
    out = quality.quality_scores(docs, told)
    assert {(r["score"], r["predicted"]) for r in out.collect()} == {(0.5, 1)}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    assert quality.quality_scores(docs, labels.where("false")).count() == 40


def test_thresholds_are_quantiles_of_all_rows(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5000)], "own_id2 long, raw double")
    known = spark.createDataFrame([(i, int(i >= 3210)) for i in range(0, 5000, 7)], "own long, quality int")
    threshold, slope = quality.threshold_of(rows, known, "own_id2", "raw")
    assert 3206 < threshold <= 3213 and slope > 0
    assert quality.threshold_of(rows.where("false"), known, "own_id2", "raw") == (0.0, 1.0)
