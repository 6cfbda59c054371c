import numpy as np
import pytest

from vicinia.__main__ import main
from vicinia.config import KnnConfig
from vicinia.operators.knn import knn
from vicinia.operators.topk import nested
from vicinia.plans.pipeline import run
from vicinia.sources import read_neighbours, read_points, write_neighbours, write_points
from vicinia.sources.raw import RawReader
from vicinia.streaming.neighbours import stream_knn

from .brute import as_dict, frame, knn as brute, rng, rows


@pytest.mark.parametrize("dtype, kind", [("f32", "<f4"), ("f64", "<f8")])
def test_raw_points(spark, tmp_path, dtype, kind):
    data = rng(1).random((50, 3)).astype(kind)
    (tmp_path / "p").write_bytes(data.tobytes() + b"abc")  # what is left over is ignored
    got = sorted((r["id"], r["coords"]) for r in read_points(spark, f"{tmp_path}/p", 3, dtype).collect())
    assert got == [(i, c) for i, c in enumerate(data.astype(float).tolist())]


def test_ranges_cover_a_file_once(tmp_path):
    data = rng(2).random((100, 2))
    (tmp_path / "p").write_bytes(data.tobytes())
    reader = RawReader({"path": f"{tmp_path}/p", "dims": "2", "range": "112"})
    parts = reader.partitions()
    assert len(parts) == 15
    rows_ = [(i, c) for p in parts for b in reader.read(p) for i, c in zip(b["id"].to_pylist(), b["coords"].to_pylist())]
    assert rows_ == list(enumerate(data.tolist()))
    with pytest.raises(ValueError):
        RawReader({"path": "x", "dims": "0"})


def test_write_and_read(spark, tmp_path):
    pts = rows(rng(3), 60, 2)
    files = write_points(frame(spark, pts), f"{tmp_path}/out")
    back = sorted((r["id"], r["coords"]) for r in read_points(spark, f"file://{tmp_path}/out", 2, files=files).collect())
    assert [c for _, c in back] == [c for _, c in sorted(pts)]
    (tmp_path / "out" / "part-of-a-failed-attempt.f64").write_bytes(bytes(160))
    assert sorted((r["id"], r["coords"]) for r in read_points(spark, f"{tmp_path}/out", 2).collect()) == back
    (tmp_path / "empty").write_bytes(b"")
    assert read_points(spark, f"{tmp_path}/empty", 2).count() == 0


def test_packed_neighbours(spark, tmp_path):
    pts = [(i, c) for i, (_, c) in enumerate(rows(rng(4), 20, 2))]
    files = write_neighbours(nested(knn(frame(spark, pts), 3)), f"{tmp_path}/n")
    data = np.concatenate([np.fromfile(tmp_path / "n" / f, [("value", "<f8"), ("array_idx", "<u8")]) for f in files]).reshape(20, 3)
    want = brute(pts, pts, 3)
    assert {(r["place"], r["rank"]): (r["neighbor_id"], r["d2"]) for r in read_neighbours(spark, f"{tmp_path}/n", 3).collect()} == want
    assert all((data[q, r - 1]["array_idx"], data[q, r - 1]["value"]) == v for (q, r), v in want.items())


def test_whole_run(spark, tmp_path):
    data = rng(5).random((80, 2)).astype("<f4")
    (tmp_path / "p").write_bytes(data.tobytes())
    done = run(spark, f"{tmp_path}/p", KnnConfig(k=4, dims=2, dtype="f32", cell_rows=20), f"{tmp_path}/out")
    pts = list(enumerate(data.astype(float).tolist()))
    assert as_dict(done.neighbours) == brute(pts, pts, 4)
    assert sum(r["n"] for r in done.offsets.collect()) == 80 and done.tree.cells == 4
    assert spark.read.parquet(f"{tmp_path}/out/neighbours").count() == 80
    with pytest.raises(ValueError):
        run(spark, "x", KnnConfig())


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "p").write_bytes(rng(6).random((10, 2)).tobytes())
    main(["-i", f"{tmp_path}/p", "-t", "f64", "-d", "2", "-k", "2", "--policy", "round_robin", "--compute", "f32", "--invalid", "drop", "--block-rows", "4"])
    assert "neighbor_id" in capsys.readouterr().out
    r = rng(9)
    at = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(30, 1, (50, 2))])
    (tmp_path / "q").write_bytes(at.tobytes())
    main(["-i", f"{tmp_path}/q", "-t", "f64", "-d", "2", "-k", "20", "-a", f"{tmp_path}/clusters", "-z", "2.5"])
    found = {r["query_id"]: r for r in spark.read.parquet(f"{tmp_path}/clusters").collect()}
    assert set(found) == set(range(110)) and {found[i]["cluster"] for i in range(60)}.isdisjoint(found[i]["cluster"] for i in range(60, 110))
    assert not any(x["halo"] for x in found.values()) and {x["label"] for x in found.values()} == {0, 1}
    with pytest.raises(ValueError):
        main(["-i", f"{tmp_path}/q", "-t", "f64", "-d", "2", "-k", "4", "-a", f"{tmp_path}/few"])
    with pytest.raises(SystemExit):
        main(["-i", "x"])


def test_stream(spark, tmp_path):
    base, queries = rows(rng(7), 30, 2), rows(rng(8), 10, 2)
    for i in (0, 1):
        frame(spark, queries[5 * i : 5 * i + 5], 1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, coords array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_knn(stream, frame(spark, base), 3, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert as_dict(spark.read.parquet(f"{tmp_path}/out")) == brute(queries, base, 3)


def test_neighbour_files_of_short_lists(spark, tmp_path):
    """Lists shorter than k, and of different lengths, come back as they were; k is told by the folder."""
    from vicinia.sources import read_neighbours, write_neighbours

    schema = "query_id long, neighbors array<struct<value:double,array_idx:long>>"
    lists = [(4, [(0.0, 4), (1.5, 9)]), (1, [(0.0, 1)]), (7, []), (9, [(2.0, 1), (3.0, 2), (4.0, 0)])]
    df = spark.createDataFrame(lists, schema)
    want = {(place, n, d, i + 1) for place, (_, own) in enumerate(sorted(lists)) for i, (d, n) in enumerate(own)}
    for k, path in ((None, f"{tmp_path}/a"), (5, f"{tmp_path}/b")):
        write_neighbours(df, path, k)
        assert {(r["place"], r["neighbor_id"], r["d2"], r["rank"]) for r in read_neighbours(spark, path).collect()} == want
        with pytest.raises(ValueError):
            read_neighbours(spark, path, 4)
    with pytest.raises(ValueError):
        write_neighbours(df, f"{tmp_path}/c", 2)
    write_neighbours(df.where("false"), f"{tmp_path}/d")
    assert read_neighbours(spark, f"{tmp_path}/d").count() == 0
    with pytest.raises(ValueError):
        read_neighbours(spark, f"{tmp_path}/none")


def test_points_outside_of_their_cells_stop_a_run(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from vicinia.plans import pipeline

    pts = spark.range(200).selectExpr("id", "array(cast(id as double), cast(id % 7 as double)) coords")
    write_points(pts, f"{tmp_path}/raw")
    config = KnnConfig(k=3, dims=2, cell_rows=50)
    done = pipeline.run(spark, f"{tmp_path}/raw", config, f"{tmp_path}/out")
    assert [(r["phase"], r["rows"]) for r in done.phases.collect()] == [("points", 200), ("stats", 2), ("cells", 200), ("neighbours", 600), ("offsets", 4)]
    assert spark.read.parquet(f"{tmp_path}/out/phases").count() == 5 and done.neighbours.count() == 600
    right = pipeline.with_cell
    monkeypatch.setattr(pipeline, "with_cell", lambda p, t: right(p, t).withColumn("cell", F.when(F.col("id") == 5, (F.col("cell") + 1) % 4).otherwise(F.col("cell"))))
    with pytest.raises(RuntimeError, match="1 points"):
        pipeline.run(spark, f"{tmp_path}/raw", config)


def test_lost_attempts_leave_nothing(spark, tmp_path):
    """A failing job leaves a folder as it was; of two attempts at a partition only the committed one is there."""
    from pyspark.sql import functions as F
    from vicinia.sources import raw

    pts = spark.range(0, 40, 1, 4).selectExpr("id", "array(double(id), 1.0D) coords")
    write_points(pts, f"{tmp_path}/out")
    before = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()}
    failing = pts.withColumn("coords", F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("coords")))
    with pytest.raises(Exception, match="lost"):
        failing.write.format("rawpoints").mode("append").save(f"{tmp_path}/out")
    with pytest.raises(Exception, match="lost"):
        failing.write.format("rawpoints").mode("append").save(f"{tmp_path}/new")
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == before
    assert not (tmp_path / "new").exists() or not list((tmp_path / "new").iterdir())
    assert read_points(spark, f"{tmp_path}/out", 2).count() == 40

    writer = raw.RawWriter({"path": f"{tmp_path}/twice", "dtype": "f64"})
    raw_context, raw.TaskContext = raw.TaskContext, type("Context", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())})
    try:
        batch = raw.pa.RecordBatch.from_pydict({"id": [0], "coords": [[1.0, 2.0]]})
        first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    finally:
        raw.TaskContext = raw_context
    assert first.file != second.file
    writer.commit([second, None])
    assert sorted(f.name for f in (tmp_path / "twice").iterdir()) == sorted(["_files", second.file])
    assert raw.written_files(f"{tmp_path}/twice") == [second.file]
