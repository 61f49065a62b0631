"""The sink with a manifest: nothing is seen of a failed write; files written by tasks."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import sink

ROW = "id long, name string, image binary"


def some(spark, low, high):
    return spark.range(low, high, 1, 3).selectExpr("id", "IF(id % 2 = 0, concat('n', id), NULL) AS name", "CAST(concat('bytes', id) AS BINARY) AS image")


def test_writes_are_seen_through_the_manifest(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    assert sink.read(spark, at, ROW).count() == 0
    sink.write(some(spark, 0, 10), at)
    sink.write(some(spark, 10, 14), at)
    sink.write(some(spark, 0, 0), at)
    want = sorted(map(tuple, some(spark, 0, 14).collect()))
    assert sorted(map(tuple, sink.read(spark, at, ROW).collect())) == want
    assert [m["rows"] for m in sink.manifests(spark, at)] == [10, 4, 0]
    # a file that no manifest names is never read
    (tmp_path / "s/data/left-over.parquet").write_bytes(b"no parquet")
    assert sink.read(spark, at, ROW).count() == 14
    sink.write(some(spark, 0, 2), at, mode="overwrite")
    assert sink.read(spark, at, ROW).count() == 2


def test_a_failing_task_leaves_nothing_visible(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    sink.write(some(spark, 0, 5), at)
    before = sorted(p.name for p in (tmp_path / "s/manifests").iterdir())
    bad = some(spark, 5, 60).withColumn("name", F.when(F.col("id") == 57, F.raise_error(F.lit("no more"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no more"):
        sink.write(bad, at)
    assert sorted(p.name for p in (tmp_path / "s/manifests").iterdir()) == before and sink.read(spark, at, ROW).count() == 5
    with pytest.raises(Exception, match="unknown kind"):
        sink.write(some(spark, 0, 1), at, kind="xml")


def test_lines_leave_nulls_out(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    sink.write(some(spark, 0, 6).drop("image"), at, kind="json")
    lines = [x for p in (tmp_path / "log/data").iterdir() for x in p.read_text().splitlines()]
    assert len(lines) == 6 and '{"id": 1}' in lines and '{"id": 2, "name": "n2"}' in lines
    assert sorted(map(tuple, sink.read(spark, at, "id long, name string", "json").collect())) == sorted((r.id, r.name) for r in some(spark, 0, 6).collect())


def test_files_written_by_tasks(spark, tmp_path):
    at = f"file://{tmp_path}/files"
    rows = spark.createDataFrame([("a/1.txt", b"one"), ("a/b/2.bin", b""), ("3", None), ("a/1.txt/x", b"no")], "tail string, content binary").coalesce(1)
    got = {r.tail: (r.bytes, r.error is None) for r in sink.write_files(rows, at).collect()}
    assert got["a/1.txt"] == (3, True) and got["3"] == (0, True) and got["a/1.txt/x"] == (None, False)
    assert (tmp_path / "files/a/1.txt").read_bytes() == b"one" and sorted(p.name for p in (tmp_path / "files/a").iterdir()) == ["1.txt", "b"]
