import threading

import pytest
from pyspark.sql import functions as F

from vicinia import skew, staging


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 0)
    monkeypatch.setattr(skew, "LEAST", 5)
    left = spark.range(200).select(F.col("id"), F.when(F.col("id") < 90, 7).otherwise(F.col("id") % 13).cast("long").alias("k"), F.col("id").cast("string").alias("tasks"))
    right = spark.createDataFrame([(i, f"v{i}") for i in range(9)], "key long, v string")
    hot = skew.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert (7, 20) in hot and skew.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).limit(0)) == []
    for how in ("inner", "left"):
        plain = sorted(map(tuple, left.join(right, F.col("k") == F.col("key"), how).collect()), key=str)
        for some in (hot, []):
            assert sorted(map(tuple, skew.spread_join(left, right, ["k"], ["key"], "id", some, how).collect()), key=str) == plain


def test_staged_tables_go_when_told(spark):
    def there(path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    before = staging.left(spark)
    with staging.scope(spark) as outer:
        a, b, c = (staging.staged(spark.range(n), f"test-{n}") for n in (3, 4, 5))
        paths = [staging._STAGED[x] for x in (a, b, c)]
        staging.release(a, a, spark.range(2))
        assert [there(p) for p in paths] == [False, True, True]
        with staging.scope(spark) as inner:
            d, e = (staging.staged(spark.range(n), f"test-{n}") for n in (6, 7))
            inner.keep(e)
            inner.keep(b)  # not of this block
            paths += [staging._STAGED[x] for x in (d, e)]
        assert [there(p) for p in paths] == [False, True, True, False, True] and e.count() == 7
        outer.keep(c)
    assert [there(p) for p in paths] == [False, False, True, False, False] and c.count() == 5
    assert staging.left(spark) == [*before, paths[2]]
    with pytest.raises(ZeroDivisionError), staging.scope(spark):
        paths.append(staging._STAGED[staging.staged(spark.range(1), "test-1")])
        1 / 0  # noqa: B018
    assert not there(paths[-1])
    staging.clear(spark)
    assert staging.left(spark) == [] and not there(paths[2])


def test_scopes_of_threads_are_their_own(spark):
    """What another thread stages meanwhile is not deleted with a block."""
    made = []
    with staging.scope(spark):
        worker = threading.Thread(target=lambda: made.append(staging.staged(spark.range(9), "test-thread")))
        worker.start()
        worker.join()
    assert made[0].count() == 9
    staging.release(made[0])
