"""File sources, sinks and streams round trip."""

import json

from pyspark.sql import functions as F

from millrace.sources import files, logs, web
from millrace.streaming import metrics


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_last_line_of_a_key_wins(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in [{"id": "a", "v": 1}, {"id": "b", "v": 2}, {"id": "a", "v": 3}]))
    got = files.read_records(spark, str(tmp_path / "r.jsonl"), "id string, v int", "id")
    assert values(got, "id", "v") == [("a", 3), ("b", 2)]


def test_map_documents(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert files.read_map(spark, path, "int").count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    files.write_map(df, path)
    assert values(files.read_map(spark, path + "/part-*", "int"), "key", "value") == [("a", 1), ("b", 2)]
    many = spark.range(95).selectExpr("CAST(id AS STRING) AS key", "id AS value")
    files.write_map(many, path + "-many", most=10)
    assert values(files.read_map(spark, path + "-many/part-*", "long"), "key", "value") == sorted((str(i), i) for i in range(95))
    files.write_map(many.limit(0), path + "-none")
    assert files.read_map(spark, path + "-none/part-*", "long").count() == 0
    new = spark.createDataFrame([("b", 5), ("c", 6)], "key string, value int")
    assert values(files.upsert(df, new, "key"), "key", "value") == [("a", 1), ("b", 5), ("c", 6)]


def test_lists_grow_at_their_ends(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"x": [3, 1]}')
    old = files.read_map_of_lists(spark, str(tmp_path / "l.json"), "int")
    new = spark.createDataFrame([("x", 9), ("y", 4)], "key string, item int")
    assert values(files.append_item(old, new), "key", "pos", "item") == [("x", 0, 3), ("x", 1, 1), ("x", 2, 9), ("y", 0, 4)]


def test_labels_prefer_shards(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("image_file,text\nroot.png,r\n")
    assert values(files.read_labels(spark, str(tmp_path)), "image_file", "text") == [("root.png", "r")]
    for k in (0, 1):
        (tmp_path / f"shard_{k}").mkdir()
        (tmp_path / f"shard_{k}" / "labels.csv").write_text(f"image_file,text\n{k}.png,\n")
    assert values(files.read_labels(spark, str(tmp_path)), "image_file", "text", "shard") == [("0.png", "", "shard_0"), ("1.png", "", "shard_1")]


def test_splits(spark, tmp_path):
    assert files.read_splits(spark, str(tmp_path)).count() == 0
    (tmp_path / "train.txt").write_text("a \n\n b\n")
    assert values(files.read_splits(spark, str(tmp_path)), "split", "id") == [("train", "a"), ("train", "b")]


def test_images(spark, tmp_path):
    for name, size in (("s1/a.PNG", 600), ("s1/b.txt", 900), ("s2/c.jpg", 10), ("images/a.png", 700), ("images/d.png", 700), ("d.png", 800)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * size)
    images = files.list_images(spark, str(tmp_path))
    assert images.count() == 5
    assert files.sound_images(images).count() == 4
    labels = spark.createDataFrame([("d.png",), ("a.png",), ("none.png",)], "image_file string")
    got = {r["image_file"]: r["path"] for r in files.resolve(labels, images, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "d.png"} and "/images/" in got["a.png"] and "/images/" not in got["d.png"]
    got = {r["image_file"]: r["path"] for r in files.resolve(labels, images, str(tmp_path), nested_first=True).collect()}
    assert "/images/" in got["d.png"]
    table = files.image_table(spark, files.resolve(labels, images, str(tmp_path)), str(tmp_path))
    assert values(table, "difficulty", F.length("image")) == [("unknown", 700), ("unknown", 800)]


def test_metric_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.25, 0.75)], "step int, cer double, em double")
    logs.append(logs.metric_rows(df, "step", "cer", "em"), path)
    assert sorted((r["step"], r["cer"], r["em"]) for r in logs.read_metrics(spark, path, "cer", "em").collect()) == [(1, 0.5, None), (2, 0.25, 0.75)]
    stream = metrics.records(spark, path, logs.METRICS).select("timestamp", "step", F.col("metrics")["cer"].alias("cer"))
    q = metrics.window_means(stream, "timestamp", "step", "cer").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert values(spark.table("means"), "step", "mean", "n") == [(1, 0.5, 1), (2, 0.25, 1)]


def test_retention(spark):
    df = spark.createDataFrame([(e, f"epoch_{e:04d}") for e in range(5)], "epoch int, path string")
    assert values(logs.expired_checkpoints(df, 3), "epoch") == [(0,), (1,)]
    assert logs.expired_checkpoints(df, 0).count() == 0
    pred = spark.createDataFrame([(i, "a", "a" if i else "b") for i in range(60)], "i int, prediction string, reference string")
    got = logs.prediction_samples(pred, "i")
    assert got.count() == 50 and got.filter("not correct").count() == 1


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path):
    names = ("top.png", "a/x y%20#.png", "a/b/c/d/deep.PNG", "a/b/c/d/.hidden.png", "a/_none/e.png", "a/k=1/f.png", "b/g.txt")
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    rows = files.below(spark, str(tmp_path))
    tail = F.expr(f"substring(path, {len('file:' + str(tmp_path)) + 2})")
    seen = sorted([n for n in names if "hidden" not in n and "_none" not in n])
    assert values(rows, tail, "length") == [(n, len(n)) for n in seen]
    # the driver's file index holds none of them
    assert rows.inputFiles() == [] and files.list_images(spark, str(tmp_path)).inputFiles() == []
    assert values(files.contents(rows), tail, F.col("image").cast("string")) == [(n, n) for n in seen]
    assert values(files.below(spark, str(tmp_path), "*.png", "{deep,g}.*"), tail) == [(n,) for n in seen]
    assert values(files.below(spark, str(tmp_path), deep=False), tail) == [("top.png",)]
    assert values(files.union_of_globs(spark, str(tmp_path), "*.png", "t*"), "name") == sorted([(n.split("/")[-1],) for n in seen if n.endswith(".png")])
    assert files.contents(rows).select("image").count() == len(seen) and files.binary_files(spark, str(tmp_path), "g*").select("length").first()[0] == 7


def test_pages_are_told_as_by_a_text_reader(spark, tmp_path):
    (tmp_path / "a b%.html").write_bytes(b"<p>\xff</p>\n")
    (tmp_path / "c.txt").write_text("no")
    want = [(r[0], r[1]) for r in spark.read.text(f"{tmp_path}/*.html", wholetext=True).selectExpr("_metadata.file_path", "hex(value)").collect()]
    assert values(web.read_html(spark, f"{tmp_path}/*.html"), "url", F.hex("html")) == want
