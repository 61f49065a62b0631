"""Registered queries of the sources and sinks: each writes a table in the source's format and reads it back.

The folders lie below spark.checkpoint.dir and go when the driver's JVM ends.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import extract, pages, script
from millrace.operators import stems, variation  # noqa: F401 (steps of variation are found by name)
from millrace.operators.pixels import run_steps
from millrace.plans.registry import Group, pieces, spread
from millrace.sources import files, logs, pictures, sink, web
from millrace.sources.store import Store
from millrace.streaming import series

GROUP = Group()


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; without spark.checkpoint.dir, one of this machine if all tasks run in this process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file:///tmp/checkpoints"
    folder = f"{place.rstrip('/')}/formats/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def _q(name: str, oracle: str):
    def add(run):
        GROUP.frame(name, lambda s, d: run(s, lambda t: s.read.parquet(f"{d}/{t}.parquet"), work_folder(s)), oracle)
        return run

    return add


@_q("records_last_line", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'again' ELSE s_name END AS name FROM supplier")
def _(s: SparkSession, t, at: str) -> DataFrame:
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    files.append_records(rows, f"{at}/r")
    # the second file of the same store comes later by name
    files.append_records(rows.filter("id % 2 = 0").withColumn("name", F.lit("again")), f"{at}/s")
    return files.read_records(s, f"{at}/*", "id long, name string", "id")


@_q("records_appended", "SELECT count(*) AS n, count(DISTINCT s_suppkey) AS n_ids FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey FROM supplier)")
def _(s, t, at):
    for _ in range(2):
        files.append_records(t("supplier").select(F.col("s_suppkey").alias("id")), f"{at}/r")
    return files.read_records(s, f"{at}/r", "id long").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@_q("map_document", "SELECT n_name AS key, CASE WHEN n_nationkey < 5 THEN 'new' ELSE 'v' || n_regionkey END AS value FROM nation UNION ALL SELECT 'Atlantis', 'new'")
def _(s, t, at):
    files.write_map(t("nation").select(F.col("n_name").alias("key"), F.concat(F.lit("v"), "n_regionkey").alias("value")), f"{at}/m")
    new = t("nation").filter("n_nationkey < 5").select(F.col("n_name").alias("key")).unionAll(s.range(1).select(F.lit("Atlantis"))).withColumn("value", F.lit("new"))
    return files.upsert(files.read_map(s, f"{at}/m/part-*", "string"), new, "key")


@_q("map_of_lists", """SELECT CAST(n_regionkey AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY late, n_name) - 1 AS INT) AS pos, n_name AS item
  FROM (SELECT n_regionkey, n_name, 0 AS late FROM nation UNION ALL SELECT r_regionkey, 'added', 1 FROM region)""")
def _(s, t, at):
    lists = t("nation").groupBy(F.col("n_regionkey").cast("string").alias("key")).agg(F.sort_array(F.collect_list("n_name")).alias("value"))
    files.write_map(lists, f"{at}/m")
    new = t("region").select(F.col("r_regionkey").cast("string").alias("key"), F.lit("added").alias("item"))
    return files.append_item(files.read_map_of_lists(s, f"{at}/m/part-*", "string"), new)


@_q("labels_sheet", "SELECT printf('%06d.png', p_partkey) AS image_file, p_name AS text, '' AS latin, p_size::VARCHAR AS length, '' AS shard FROM part")
def _(s, t, at):
    files.write_labels(t("part").selectExpr("format_string('%06d.png', p_partkey) AS image_file", "p_name AS text", "'' AS latin", "CAST(p_size AS STRING) AS length"), f"{at}/labels.csv")
    return files.read_labels(s, at)


@_q("labels_of_shards", "SELECT printf('%06d.png', p_partkey) AS image_file, CASE WHEN p_size > 40 THEN 'severe' ELSE '' END AS severity, 'shard_' || p_partkey % 3 AS shard FROM part")
def _(s, t, at):
    for k in range(3):
        files.write_labels(t("part").filter(f"p_partkey % 3 = {k}").selectExpr("format_string('%06d.png', p_partkey) AS image_file", "CASE WHEN p_size > 40 THEN 'severe' END AS severity"), f"{at}/shard_{k}/labels.csv")
    rows = s.read.option("header", True).csv(f"{at}/shard_*/labels.csv")
    return rows.select("image_file", "severity", F.regexp_extract("_metadata.file_path", "/(shard_[^/]+)/", 1).alias("shard")).fillna("")


@_q("split_files", "SELECT CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 9 THEN 'val' ELSE 'test' END AS split, c_name AS id FROM customer")
def _(s, t, at):
    files.write_splits(t("customer").selectExpr("CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 9 THEN 'val' ELSE 'test' END AS split", "c_name AS id"), at)
    return s.read.text(at).select("split", files.strip(F.col("value")).alias("id")).filter("id <> ''")


def _contents(rows: DataFrame, content) -> DataFrame:
    """rows: k, tail. With the bytes that content gives for k."""

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("tail"), pa.array(map(content, b.column("k").to_pylist()), pa.binary())], ["tail", "content"])

    return spread(rows.select("k", "tail")).mapInArrow(run, "tail string, content binary")


def _written(rows: DataFrame, root: str) -> None:
    """Writes the files (tail, content), each by the task that has its row."""
    # one job over all tasks; the rows that come back are one a task
    failed = sink.write_files(rows, root).agg(F.max("error")).first()[0]
    if failed:
        raise OSError(failed)


def _picture(k: int) -> bytes:
    if k % 4 == 0:
        return b"tiny"
    x = np.full((9, 5 + k % 50, 3), k % 200, np.uint8)
    x[::2] = np.random.default_rng(k).integers(0, 255, x[::2].shape)
    return pictures.encoded(x)


def _tails(t, keep: str = "true") -> DataFrame:
    return t("part").filter(keep).selectExpr("p_partkey AS k", "concat('stone_', p_partkey % 97, '/', p_partkey, element_at(array('.PNG', '.png', '.txt'), CAST(p_partkey % 3 + 1 AS INT))) AS tail")


def _gallery(s: SparkSession, t, at: str) -> DataFrame:
    """A folder of files, one a part, below its stone: every third is no image, every fourth is too small."""
    _written(_contents(_tails(t), _picture), f"{at}/site")
    return files.list_images(s, f"{at}/site")


_FILES = "(SELECT p_partkey AS k, 'stone_' || p_partkey % 97 AS folder, p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.png' ELSE '.txt' END AS file FROM part)"


@_q("image_listing", f"SELECT folder, file, k % 4 = 0 AS small FROM {_FILES} WHERE k % 3 < 2")
def _(s, t, at):
    return _gallery(s, t, at).select("folder", "file", (F.col("length") < 10).alias("small"))


@_q("image_folders", f"SELECT folder, count(*) AS n_images FROM {_FILES} WHERE k % 3 < 2 GROUP BY folder")
def _(s, t, at):
    _gallery(s, t, at)
    return files.folders_with_images(s, f"{at}/site")


@_q("sound_images", f"SELECT file FROM {_FILES} WHERE k % 3 < 2 AND k % 4 > 0")
def _(s, t, at):
    return files.sound_images(_gallery(s, t, at), least=50).select("file")


@_q("decoded_images", f"SELECT file, CASE WHEN k % 4 > 0 THEN 9 END::INT AS height, CASE WHEN k % 4 > 0 THEN 5 + k % 50 END::INT AS width, CASE WHEN k % 4 > 0 THEN k % 200 END::INT AS value, k % 4 = 0 AS failed FROM {_FILES} WHERE k % 3 < 2")
def _(s, t, at):
    told = pictures.decode_table(files.contents(_gallery(s, t, at).select("path")))
    # the second row of each picture is plain
    value = F.conv(F.hex(F.expr("substring(pixels, width * channels + 1, 1)")), 16, 10).cast("int")
    return told.select(F.element_at(F.split("path", "/"), -1).alias("file"), "height", "width", value.alias("value"), F.col("error").isNotNull().alias("failed"))


@_q("resolved_paths", f"SELECT file AS image_file, folder FROM {_FILES} WHERE k % 3 < 2 AND folder = 'stone_1'")
def _(s, t, at):
    images = _gallery(s, t, at)
    labels = images.select(F.col("file").alias("image_file"))
    got = files.resolve(labels, images, f"{at.replace('file://', '')}/site/stone_1")
    return got.select("image_file", F.element_at(F.split("path", "/"), -2).alias("folder"))


@_q("hub_table", f"SELECT file, CASE WHEN k % 5 = 0 THEN 'unknown' ELSE 'hard' END AS difficulty, true AS has_image FROM {_FILES} WHERE k % 3 < 2")
def _(s, t, at):
    images = _gallery(s, t, at)
    number = F.regexp_extract("file", "^([0-9]+)", 1).cast("long")
    told = images.select("path", "file", F.when(number % 5 == 0, "").otherwise("hard").alias("difficulty"))
    files.image_table(s, told, f"{at}/site").write.parquet(f"{at}/hub")
    return s.read.parquet(f"{at}/hub").select("file", "difficulty", (F.length("image") > 0).alias("has_image"))


@_q("hub_rows", """WITH g AS (SELECT p_partkey AS i, p_name FROM part WHERE p_partkey % 7 > 1), f AS (SELECT min(i) AS i FROM g)
  SELECT p.p_partkey AS idx, g.p_name AS text FROM (SELECT p_partkey, coalesce((SELECT min(i) FROM g WHERE i >= p_partkey), (SELECT i FROM f)) AS at FROM part) p JOIN g ON g.i = p.at""")
def _(s, t, at):
    rows = t("part").select(F.col("p_partkey").alias("idx"), F.when(F.col("p_partkey") % 7 > 1, F.col("p_name")).otherwise("").cast("binary").alias("image"), F.col("p_name").alias("text"))
    rows.write.parquet(f"{at}/hub")
    return web.read_hub(s.read.parquet(f"{at}/hub"), "idx", "image", ["text"]).select("idx", "text")


@_q("stream_early_stop", "SELECT p_partkey AS idx, CASE WHEN n <= 3 THEN 'few_shot' ELSE 'test' END AS part FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 500) WHERE length(p_name) BETWEEN 5 AND 30) WHERE n <= 33")
def _(s, t, at):
    return web.early_stop(t("part").select(F.col("p_partkey").alias("idx"), "p_name"), "idx", "p_name").select("idx", "part")


@_q("metric_log", "SELECT event_id % 50 AS step, sum(value) AS a, count(value) AS n FROM events WHERE event_id % 3 > 0 GROUP BY event_id % 50")
def _(s, t, at):
    logs.append(logs.metric_rows(t("events").selectExpr("event_id % 50 AS step", "CASE WHEN event_id % 3 > 0 THEN value END AS a"), "step", "a"), f"{at}/log")
    return logs.read_metrics(s, f"{at}/log", "a").filter("a IS NOT NULL").groupBy("step").agg(F.sum("a").alias("a"), F.count("a").alias("n"))


def _streamed(s: SparkSession, rows: DataFrame, cuts: list, at: str, kind, **options) -> DataFrame:
    """rows (key, step, value), written to a log by all tasks, one part between the cuts after the other; a stream follows the log and takes each part as a batch."""
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.filter(F.lit(True) if low is None else F.col("step") > low).filter(F.lit(True) if high is None else F.col("step") <= high)
        part.write.mode("append").json(f"{at}/log")
        log = s.readStream.schema(rows.schema).json(f"{at}/log")
        told = series.run_to_end(series.followed(log, kind, **options), f"{at}/told", f"{at}/state")
    return told.filter("NOT late").drop("late")


def _thirds(rows: DataFrame) -> list:
    low, high = rows.agg(F.min("step"), F.max("step")).first()
    return [] if low is None else [low + (high - low) // 3, low + (high - low) * 2 // 3]


@_q("stream_progress", """WITH b AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events),
  i AS (SELECT *, (b IS NULL OR value < b)::INT AS i FROM b), g AS (SELECT *, sum(i) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM i),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS stale FROM g)
  SELECT user_id AS key, event_id AS step, least(b, value) AS best, i = 1 AS improved, stale, max(stale) OVER (PARTITION BY user_id ORDER BY event_id) >= 5 AS stopped,
  count(*) OVER (PARTITION BY user_id ORDER BY event_id) > 10 AND max(value) OVER w - min(value) OVER w < 60 AS plateau FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(s, t, at):
    rows = t("events").selectExpr("user_id AS key", "event_id AS step", "value")
    return _streamed(s, rows, _thirds(rows), at, series.Progress, spread=60.0)


@_q("stream_misses", """WITH h AS (SELECT user_id, event_id, (event_type = 'purchase')::INT AS hit, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
  m AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id, g ORDER BY event_id) AS m FROM h), c AS (SELECT *, coalesce(max(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS probed FROM m)
  SELECT user_id AS key, event_id AS step, probed, CASE WHEN probed THEN m ELSE 10 END::BIGINT AS misses FROM c""")
def _(s, t, at):
    rows = t("events").selectExpr("user_id AS key", "event_id AS step", "IF(event_type = 'purchase', 1D, 0D) AS value")
    return _streamed(s, rows, _thirds(rows), at, series.Misses)


@_q("stream_quota", """WITH n AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM n WHERE n <= 500 AND length(p_name) BETWEEN 5 AND 30)
  SELECT p_brand AS key, p_partkey AS step, CASE WHEN f <= 3 THEN 'few_shot' ELSE 'test' END AS part FROM f WHERE f <= 33""")
def _(s, t, at):
    rows = t("part").selectExpr("p_brand AS key", "p_partkey AS step", "CAST(length(p_name) AS DOUBLE) AS value")
    return _streamed(s, rows, _thirds(rows), at, series.Quota).filter("part IS NOT NULL")


@_q("event_log", "SELECT 'finished' AS event, CAST(r_regionkey AS VARCHAR) AS run FROM region UNION ALL SELECT 'artifact_logged', CAST(r_regionkey AS VARCHAR) FROM region")
def _(s, t, at):
    for name in ("artifact_logged", "finished"):
        logs.append(logs.event(t("region"), name, run=F.col("r_regionkey")), f"{at}/events")
    return s.read.schema(logs.EVENTS).json(f"{at}/events").select("event", F.try_element_at("data", F.lit("run")).alias("run"))


@_q("prediction_samples", "SELECT o_orderkey, o_orderstatus = 'O' AS correct FROM orders ORDER BY o_orderkey LIMIT 50")
def _(s, t, at):
    return logs.prediction_samples(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("prediction"), F.lit("O").alias("reference")), "o_orderkey").select("o_orderkey", "correct")


@_q("folder_sizes", "SELECT 'stone_' || p_partkey % 97 AS folder, sum(p_size) AS n FROM part GROUP BY p_partkey % 97")
def _(s, t, at):
    # as many bytes as the part's size says, in units of 64
    rows = t("part").selectExpr("p_partkey * 64 + p_size AS k", "concat('stone_', p_partkey % 97, '/', p_partkey, '.bin') AS tail")
    _written(_contents(rows, lambda k: b"x" * (64 * (k % 64))), f"{at}/size")
    return files.folder_sizes(s, f"{at.replace('file://', '')}/size").select("folder", F.round(F.col("mib") * 16384).cast("long").alias("n"))


@_q("store_rounds", """SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'traced' WHEN p_partkey % 2 = 0 THEN 'keep' ELSE 'pending' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 3 WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::INT AS round, p_name AS notes FROM part WHERE p_partkey % 5 > 0""")
def _(s, t, at):
    store = _stored(s, t, at)
    return store.read()


@_q("store_as_of", """SELECT 1 AS number, 'pending' AS status, count(*) AS n FROM part UNION ALL SELECT 2, CASE WHEN p_partkey % 2 = 0 THEN 'keep' ELSE 'pending' END AS status, count(*) FROM part GROUP BY p_partkey % 2 = 0""")
def _(s, t, at):
    store = _stored(s, t, at)
    told = [store.read(n).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(n).alias("number"), "status", "n") for n in (1, 2)]
    return told[0].unionAll(told[1])


def _stored(s: SparkSession, t, at: str) -> Store:
    """A store of the parts after three rounds of changes and one of removals."""
    store = Store(s, f"{at}/store", "key long, status string, round int, notes string", "key", 16)
    rows = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("notes"))
    for n, (status, every) in enumerate((("pending", 1), ("keep", 2), ("traced", 4)), 1):
        store.upsert(rows.filter(F.col("key") % every == 0).withColumns({"status": F.lit(status), "round": F.lit(n)}))
    store.remove(rows.filter("key % 5 = 0"))
    return store


@_q("sink_images", f"SELECT file, folder, k % 200 AS value FROM {_FILES} WHERE k % 3 < 2 AND k % 4 > 0")
def _(s, t, at):
    images = _gallery(s, t, at)
    sink.write(files.contents(files.sound_images(images, least=50)).select("file", "folder", "image"), f"{at}/hub")
    told = pictures.decode_table(sink.read(s, f"{at}/hub", "file string, folder string, image binary").select(F.concat_ws("/", "folder", "file").alias("path"), "image"))
    value = F.conv(F.hex(F.expr("substring(pixels, width * channels + 1, 1)")), 16, 10).cast("long")
    return told.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), 1).alias("folder"), value.alias("value"))


@_q("sink_log", "SELECT event_type AS name, count(*) AS n, count(CASE WHEN event_id % 3 > 0 THEN value END) AS n_values, sum(CASE WHEN event_id % 3 > 0 THEN value END) AS value FROM events GROUP BY event_type")
def _(s, t, at):
    rows = t("events").selectExpr("event_id AS step", "event_type AS name", "CASE WHEN event_id % 3 > 0 THEN value END AS value")
    for k in range(2):
        sink.write(rows.filter(F.col("step") % 2 == k), f"{at}/log", kind="json")
    return sink.read(s, f"{at}/log", "step long, name string, value double", "json").groupBy("name").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("value"))


@_q("curation_store", "SELECT p_brand || '/' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'traced' WHEN p_partkey % 2 = 0 THEN 'keep' ELSE 'pending' END AS status, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_name END AS notes FROM part")
def _(s, t, at):
    keyed = t("part").select(F.concat_ws("/", "p_brand", F.col("p_partkey")).alias("key"), "p_partkey", "p_name")
    files.write_map(keyed.filter("p_partkey % 2 = 0").select("key", F.struct(F.lit("keep").alias("status"), F.col("p_name").alias("notes")).alias("value")), f"{at}/curation.json")
    saved = files.read_map(s, f"{at}/curation.json/part-*", "struct<status:string,notes:string>")
    # a saved entry replaces the whole entry of its key
    new = keyed.filter("p_partkey % 4 = 0").select("key", F.struct(F.lit("traced").alias("status"), F.lit(None).cast("string").alias("notes")).alias("value"))
    return keyed.select("key").join(files.upsert(saved, new, "key"), "key", "left").select("key", F.coalesce("value.status", F.lit("pending")).alias("status"), "value.notes")


@_q("trace_store", "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::INT AS n_strokes, p_size / 100.0::DOUBLE AS first FROM part")
def _(s, t, at):
    stroke = "named_struct('kind', 'char', 'charKey', p_name, 't', p_size / 100D)"
    old = t("part").selectExpr("p_partkey AS key", f"array({stroke}) AS strokes")
    old.write.parquet(f"{at}/traces")
    new = t("part").filter("p_partkey % 2 = 0").selectExpr("p_partkey AS key", f"array({stroke}, {stroke}) AS strokes")
    return files.upsert(s.read.parquet(f"{at}/traces"), new, "key").select("key", F.size("strokes").alias("n_strokes"), F.col("strokes")[0]["t"].alias("first"))


@_q("missing_store", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS curated, CAST(NULL AS VARCHAR) AS annotated, p_partkey % 3 = 0 AS is_curated FROM part")
def _(s, t, at):
    # one store is there, the other has never been written
    keyed = t("part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").cast("string").alias("k"))
    files.write_map(t("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value")), f"{at}/curation.json")
    curated = files.read_map(s, f"{at}/curation.json/part-*", "string").select(F.col("key").alias("k"), F.col("value").alias("curated"))
    annotated = files.read_map(s, f"{at}/annotations.json", "string").select(F.col("key").alias("k"), F.col("value").alias("annotated"))
    return keyed.join(curated, "k", "left").join(annotated, "k", "left").select("key", "curated", "annotated", F.col("curated").isNotNull().alias("is_curated"))


@_q("label_row", "SELECT p_name AS text FROM part WHERE p_partkey = (SELECT min(p_partkey) + 7 FROM part)")
def _(s, t, at):
    least = t("part").agg(F.min("p_partkey")).first()[0]
    return files.row_at(t("part").withColumn("n", F.col("p_partkey") - least), "n", 7).select(F.col("p_name").alias("text"))


_PAGED = """SELECT 'brand_' || p_brand AS listing, CAST(n - 1 AS INT) AS place, p_partkey AS pageid, 'File:' || p_name AS title, false AS failed FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
  UNION ALL SELECT 'missing', 0, NULL, NULL, true"""
_PAGE = 50


def _listings(s: SparkSession, t, at: str) -> tuple[str, list[str]]:
    """Pages of the parts of each brand, so many members a page, written by tasks; the address of a page, and the names of the listings and of one that isn't there."""
    ranked = t("part").select(F.concat(F.lit("brand_"), "p_brand").alias("name"), "p_partkey", "p_name")
    page = F.floor((F.row_number().over(Window.partitionBy("name").orderBy("p_partkey")) - 1) / _PAGE)
    members = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda m: F.struct(m["p_partkey"].alias("pageid"), F.concat(F.lit("File:"), m["p_name"]).alias("title")))
    pages_of = ranked.withColumn("page", page).groupBy("name", "page").agg(members.alias("members"))
    last = F.col("page") == F.max("page").over(Window.partitionBy("name"))
    told = pages_of.select(
        F.concat("name", F.lit("-"), F.when(F.col("page") > 0, F.concat(F.lit("p"), F.col("page"))).otherwise(""), F.lit(".json")).alias("tail"),
        F.to_json(F.struct("members", F.when(~last, F.concat(F.lit("p"), F.col("page") + 1)).alias("continue"))).cast("binary").alias("content"),
    )
    _written(told, at)
    names = [r["name"] for r in ranked.select("name").distinct().orderBy("name").collect()]  # of the brands, a few dozen at any size
    return (at if at.startswith("file:") else f"file://{at}") + "/{name}-{more}.json", [*names, "missing"]


@_q("paged_listing", _PAGED)
def _(s, t, at):
    return web.paged_listings(s, *_listings(s, t, at), 0.0).select("listing", "place", "pageid", "title", F.col("error").isNotNull().alias("failed"))


@_q("listing_stream", _PAGED)
def _(s, t, at):
    rows = web.listing_stream(s, *_listings(s, t, at), 0.0, pages=32)
    told = rows.writeStream.format("parquet").option("path", f"{at}/told").option("checkpointLocation", f"{at}/state").start()
    told.processAllAvailable()
    told.stop()
    return s.read.schema(rows.schema).parquet(f"{at}/told").select("listing", "place", "pageid", "title", F.col("error").isNotNull().alias("failed"))


@_q("page_files", "SELECT p_name AS title, p_partkey || '.html' AS file FROM part")
def _(s, t, at):
    made = t("part").select(F.concat("p_partkey", F.lit(".html")).alias("tail"), F.concat(F.lit("<html>\n<title>"), "p_name", F.lit("</title></html>")).cast("binary").alias("content"))
    _written(spread(made), f"{at}/pages")
    return web.read_html(s, f"{at}/pages/*.html").select(F.regexp_extract("html", "<title>(.*)</title>", 1).alias("title"), F.element_at(F.split("url", "/"), -1).alias("file"))


@_q("site_stones", "SELECT 'b' || substring(p_brand, 7) AS site, 'n' || p_partkey AS stone, p_name AS name FROM part")
def _(s, t, at):
    link = lambda href, text: F.concat(F.lit('<a href="'), href, F.lit('"> '), text, F.lit("</a>"))
    site = F.concat(F.lit("b"), F.substring("p_brand", 7, 10))
    # pages of a site hold a bounded number of stones each, as its listing does; the index has a page for each last figure of their names
    by_site = t("part").select(site.alias("site"), F.floor(F.col("p_partkey") / 200).alias("page"), link(F.concat(F.lit("n"), "p_partkey"), F.col("p_name")).alias("a"))
    made = by_site.groupBy("site", "page").agg(F.concat_ws("", F.collect_list("a")).alias("html")).select(F.col("site").alias("page_id"), "html")
    listed = t("part").select(F.concat(F.lit("index_"), F.substring("p_brand", -1, 1)).alias("page_id"), site.alias("site")).distinct().groupBy("page_id").agg(F.concat_ws("", F.collect_list(link(F.col("site"), F.lit("x")))).alias("html"))
    links = lambda df: pages.by_page(df, "links array<struct<href:string,text:string>>", lambda x: {"links": pages.links(pages.parsed(x))}).select(F.col("page_id").alias("page"), F.inline("links"))
    return web.two_levels(links(listed), links(made))


@_q("overview_ids", "SELECT DISTINCT p_partkey % 97 || 'a' AS number, 'I-KER-0' || (p_partkey % 90 + 10) AS id FROM part WHERE p_size % 2 = 0")
def _(s, t, at):
    made = t("part").select(F.col("p_partkey").alias("page_id"), F.expr("""concat('<a href="stone.php?site=1&stone=', p_partkey, '">', p_partkey % 97, 'a. ', p_name, '</a><a href="x">1. no</a>')""").alias("html"))
    found = pages.by_page(made, "entries array<struct<href:string,number:string,name:string>>", lambda x: {"entries": pages.old_entries(pages.parsed(x))}).select("page_id", F.inline("entries"))
    old = t("part").select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("see I-KER-0"), F.col("p_partkey") % 90 + 10, F.lit("."))).otherwise("none").alias("html"))
    return found.join(old.select("page_id", extract.new_id(F.col("html")).alias("id")), "page_id").filter("id IS NOT NULL").select("number", "id").distinct()


_IMAGES = """concat('<img src="', CASE WHEN p_size % 2 = 0 THEN 'photos/' ELSE '/images/IRE/' END, p_partkey, '.jpg" alt="', CASE p_size % 3 WHEN 0 THEN 'A sketch' WHEN 1 THEN 'rubbing' ELSE 'stone' END, '"><img src="logo.gif"><img src="/images/ire/b.png">')"""


@_q("catalogue_photographs", """SELECT p_partkey AS page_id, i::INT AS index, CASE WHEN i = 1 THEN '/images/ire/b.png' WHEN p_size % 2 = 0 THEN 'photos/' || p_partkey || '.jpg' ELSE '/images/IRE/' || p_partkey || '.jpg' END AS src, CASE WHEN i = 1 THEN 'photograph' ELSE ['drawing', 'rubbing', 'photograph'][p_size % 3 + 1] END AS kind FROM part, (SELECT unnest(range(2)) AS i)""")
def _(s, t, at):
    made = t("part").select(F.col("p_partkey").alias("page_id"), F.expr(_IMAGES).alias("html"))
    return pages.by_page(made, "images array<struct<index:int,src:string,alt:string,kind:string>>", lambda x: {"images": pages.photographs(pages.parsed(x))}).select("page_id", F.inline("images")).drop("alt")


@_q("stone_images", """SELECT p_partkey AS page_id, 0::INT AS index, CASE WHEN p_size % 2 = 0 THEN '/images/ire/b.png' ELSE '/images/IRE/' || p_partkey || '.jpg' END AS src FROM part UNION ALL SELECT p_partkey, 1, '/images/ire/b.png' FROM part WHERE p_size % 2 = 1""")
def _(s, t, at):
    made = t("part").select(F.col("p_partkey").alias("page_id"), F.expr(_IMAGES).alias("html"))
    return pages.by_page(made, "images array<struct<index:int,src:string,alt:string>>", lambda x: {"images": pages.images(pages.parsed(x))}).select("page_id", F.inline("images")).drop("alt")


@_q("commons_images", "SELECT p_brand AS listing, place::INT AS index, url FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, p_partkey, CASE WHEN p_size % 3 > 0 THEN 'https://x/' || p_partkey END AS url FROM part) WHERE url IS NOT NULL")
def _(s, t, at):
    found = t("part").groupBy(F.col("p_brand").alias("listing")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("https://x/"), "p_partkey")).alias("url")))).alias("images"))
    return web.numbered_images(found, "images", "x.url IS NOT NULL", gaps=True).select("listing", "index", "image.url")


@_q("image_records", "SELECT substring(md5('S' || p_partkey || '_commons_' || p_size), 1, 12) AS image_id, CASE WHEN p_size % 5 > 0 THEN 'S' || p_partkey || '_' || printf('%03d', p_size) || CASE WHEN p_size % 2 = 0 THEN '.png' ELSE '.jpg' END END AS file, CASE WHEN p_size % 5 > 0 THEN 'ok' ELSE 'failed' END AS status FROM part")
def _(s, t, at):
    rows = t("part").selectExpr("concat('S', p_partkey) AS stone_id", "'commons' AS source", "p_size AS index", "CASE WHEN p_size % 5 > 0 THEN concat('https://x/', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.PNG?w=3' ELSE '/' END) END AS url")
    return web.image_records(rows).select("image_id", "file", "status")


@_q("source_settings", """SELECT source, rate, 3::BIGINT AS tries, n, rate * (n - 1) AS least_seconds FROM (SELECT ['cisp', 'dias', 'commons'][p_size % 3 + 1] AS source, count(*) AS n FROM part GROUP BY p_size % 3)
  JOIN (VALUES ('cisp', 2.0::DOUBLE), ('dias', 3.0::DOUBLE), ('commons', 1.0::DOUBLE)) AS r(source, rate) USING (source)""")
def _(s, t, at):
    # what a crawl of the parts takes at least, at each source's pace
    asked = t("part").select(F.expr("element_at(array('cisp', 'dias', 'commons'), CAST(p_size % 3 + 1 AS INT))").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return asked.join(F.broadcast(web.settings(s)), "source").select("source", "rate", F.col("tries").cast("long").alias("tries"), "n", (F.col("rate") * (F.col("n") - 1)).alias("least_seconds"))


@_q("glob_union", f"SELECT file AS name, folder, lower(right(file, 3)) AS kind FROM {_FILES} WHERE k % 3 < 2")
def _(s, t, at):
    _gallery(s, t, at)
    return files.union_of_globs(s, f"{at}/site", "*.png", "*.PNG").select("name", "folder", "kind")


@_q("split_metadata", """SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer)::DOUBLE, 9) AS share, 42::BIGINT AS seed, (SELECT count(*) FROM customer) AS total
  FROM (SELECT CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM customer) GROUP BY split""")
def _(s, t, at):
    files.write_splits(t("customer").selectExpr("CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 9 THEN 'val' ELSE 'test' END AS split", "c_name AS id"), f"{at}/splits", seed=42)
    told = files.read_split_metadata(s, f"{at}/splits")
    return told.select("seed", "total", F.explode("splits").alias("x")).select("x.split", "x.n", F.round(F.col("x.n") / F.col("total"), 9).alias("share"), "seed", "total")


@_q("folder_crops", f"SELECT folder || '/' || file AS tail, CASE WHEN k % 4 > 0 THEN (5 + k % 50) // 10 END::INT AS left, k % 4 = 0 AS failed, 'low' AS confidence FROM {_FILES} WHERE k % 3 < 2")
def _(s, t, at):
    images = _gallery(s, t, at).select("path")
    told = stems.crop_reports(pictures.decode_table(files.contents(images)), "path")
    return told.select(F.expr("substring_index(path, '/', -2)").alias("tail"), F.col("box")[0].alias("left"), F.col("error").isNotNull().alias("failed"), "confidence")


@_q("folder_styles", f"SELECT folder || '/' || k || '.png' AS tail, 40::INT AS height, CASE WHEN k % 4 > 0 THEN greatest(134, floor(40::DOUBLE * ((5 + k % 50) / 9::DOUBLE) * 1.2::DOUBLE)) END::INT AS width FROM {_FILES} WHERE k % 3 < 2 AND k % 4 > 0")
def _(s, t, at):
    images = _gallery(s, t, at).select("path")
    made = run_steps(pictures.decode_table(files.contents(images)).filter("error IS NULL"), [("match", {"height": 40})], "path")
    tail = F.concat(F.regexp_replace(F.expr("substring_index(path, '/', -2)"), r"\.[^.]*$", ""), F.lit(".png"))
    _written(pictures.encode_table(made.withColumn("tail", tail), "tail").select("tail", F.col("image").alias("content")), f"{at}/styled")
    back = files.contents(files.below(s, f"{at}/styled").select("path"))
    return pictures.decode_table(back).select(F.expr("substring_index(path, '/', -2)").alias("tail"), "height", "width")


@_q("clean_transcriptions", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ᚁᚂ' WHEN 1 THEN 'ᚁ' || chr(5760) || 'ᚂ' WHEN 2 THEN 'ᚃ' ELSE '' END AS text FROM part")
def _(s, t, at):
    raw = F.expr("element_at(array('12. ᚁ[...]ᚂ', '  ᚁ   x ᚂ?', '<ᚃ̣>', 'abc'), p_size % 4 + 1)")
    return t("part").select("p_partkey", script.clean_transcription(raw).alias("text"))


@_q("plain_answers", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ᚁᚂ ᚃ' WHEN 1 THEN 'ᚁ' ELSE '' END AS text FROM part")
def _(s, t, at):
    return t("part").select("p_partkey", extract.plain_answer(F.expr("element_at(array('Transcription: \"ᚁᚂ ᚃ\"', 'The transcription is: ᚁ.', 'none'), p_size % 3 + 1)")).alias("text"))


@_q("year_ranges", "SELECT p_partkey, [400, 500, 450, 500, NULL][p_size % 5 + 1]::INT AS first, [450, 600, 500, 700, NULL][p_size % 5 + 1]::INT AS last FROM part")
def _(s, t, at):
    text = F.expr("element_at(array('early fifth century', 'of the fifth to sixth century', 'second half of the fifth century', '6th to 7th century', 'unknown'), p_size % 5 + 1)")
    return t("part").select("p_partkey", extract.year_range(text).alias("y")).select("p_partkey", "y.first", "y.last")


@_q("glyph_counts", "SELECT p_partkey, 2 * (p_size % 5)::INT AS n FROM part")
def _(s, t, at):
    return t("part").select("p_partkey", extract.glyphs(F.concat(F.repeat(F.lit("ᚁᚔ"), F.col("p_size").cast("int") % 5), F.lit("ᚕ x"))).alias("n"))


@_q("sync_plan", f"SELECT folder || '/' || file AS tail FROM {_FILES} WHERE k % 4 > 0 OR k % 8 = 4")
def _(s, t, at):
    _gallery(s, t, at)
    # the copy has some of the small files, of another size or of the same, and none of the others
    _written(_contents(_tails(t, "p_partkey % 4 = 0"), lambda k: b"tiny" if k % 8 == 0 else b"tinier"), f"{at}/copy")
    return files.to_copy(files.listing(s, f"{at}/site"), files.listing(s, f"{at}/copy")).select("tail")


@_q("commons_rows", "SELECT p_partkey AS idx, CAST(NULL AS VARCHAR) AS transcription, 'CC-BY-SA' AS licence FROM part")
def _(s, t, at):
    return t("part").select(F.col("p_partkey").alias("idx"), F.lit(None).cast("string").alias("transcription"), extract.licence(F.lit("CC BY 4.0"), F.lit(None)).alias("licence"))


@_q("batch_metadata", "SELECT n_regionkey AS batch, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(s, t, at):
    rows = t("nation").groupBy(F.col("n_regionkey").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return rows.select("batch", F.array_join(F.col("r.n_name"), ",").alias("names"), F.size("r").cast("long").alias("n"))
