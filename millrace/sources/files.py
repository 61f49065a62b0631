"""File sources and sinks: line records, keyed documents, label tables, splits, image folders.

Tables are read by Spark, so any store that Spark can open will do. Trees of files are listed and
read by tasks, with pyarrow's file systems as the sink writes them, so the driver holds none of their names. A
source whose path is missing gives an empty frame where its docstring says so.
"""

from __future__ import annotations

import contextlib
import os
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.plans.registry import pieces
from millrace.sources import sink

IMAGE_TYPES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
#: Keys of one JSON document.
MAP_KEYS = 100_000
#: Image files below this size count as broken.
LEAST_IMAGE = 500
#: Rows of a batch of a listing, and bytes of files that a task holds.
LISTED, HELD = 10_000, 16 << 20


def exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_records(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """JSON lines. With a key, the last line of each key (by file and place) stays, found by a partial aggregate."""
    rows = spark.read.schema(schema).json(path)
    if key is None:
        return rows
    names = rows.columns
    # within a block of a file, the row number grows with the place
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    last = rows.select(F.struct(*names).alias("row"), place.alias("place")).groupBy(F.col(f"row.{key}").alias("__key"))
    return last.agg(F.max_by("row", "place").alias("row")).select("row.*")


def append_records(df: DataFrame, path: str) -> None:
    """Appends JSON lines; nothing is deduplicated."""
    df.write.mode("append").json(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """JSON documents that map keys to values of the given type: key, value. Empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")))


def read_map_of_lists(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A JSON document that maps keys to lists: key, pos, item."""
    return read_map(spark, path, f"array<{item}>").select("key", F.posexplode("value").alias("pos", "item"))


def write_map(df: DataFrame, path: str, most: int = MAP_KEYS) -> None:
    """df: key, value. JSON documents that each map a range of the keys, `most` of them about; a small store is one document."""
    n = max(1, -(-df.count() // most))
    dealt = (df.repartitionByRange(n, "key") if n > 1 else df.coalesce(1)).withColumn("__doc", F.spark_partition_id())
    docs = dealt.groupBy("__doc").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))).alias("value"))
    docs.select("value").repartition(n).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new, and those of old whose key it has not; a key's whole row is replaced."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def append_item(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lists as rows (key, pos, item): the items of new (key, item) go behind those of old, in the order of their text."""
    ends = old.groupBy("key").agg((F.max("pos") + 1).alias("end"))
    added = new.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items")).join(ends, "key", "left")
    added = added.select("key", F.coalesce("end", F.lit(0)).alias("end"), F.posexplode("items").alias("k", "item"))
    return old.unionByName(added.select("key", (F.col("end") + F.col("k")).alias("pos"), "item"))


def read_labels(spark: SparkSession, root: str, name: str = "labels.csv", multiline: bool = False) -> DataFrame:
    """The label table as strings, empty fields as ''. With shard_* folders theirs are read (and a shard column tells which), else the root's."""
    sharded = exists(spark, f"{root}/shard_*")
    place = f"{root}/shard_*/{name}" if sharded else f"{root}/{name}"
    rows = spark.read.option("header", True).option("multiLine", multiline).csv(place)
    names = rows.columns
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"/(shard_[^/]+)/[^/]+$", 1)
    return rows.select(*names, shard.alias("shard")).fillna("")


def write_labels(df: DataFrame, path: str, order: str = "image_file") -> None:
    """CSV with a header, in order over all files."""
    df.orderBy(order).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_splits(spark: SparkSession, root: str, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One id per line of <split>.txt: split, id. Blank lines go; a missing file gives no row."""
    found = [f"{root}/{n}.txt" for n in names if exists(spark, f"{root}/{n}.txt")]
    if not found:
        return spark.createDataFrame([], "split string, id string")
    rows = spark.read.text(found).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("split"), strip(F.col("value")).alias("id"))
    return rows.filter("id <> ''")


def write_splits(df: DataFrame, root: str, seed: int | None = None) -> None:
    """df: split, id. A folder of sorted lines for each split, and beside root a record of the seed, the total and the number and share of each split's ids."""
    df.repartitionByRange("split", "id").sortWithinPartitions("split", "id").select("split", F.col("id").alias("value")).write.mode("overwrite").partitionBy("split").text(root)
    counts = df.groupBy("split").agg(F.count("*").alias("n"))  # a row for each split
    told = counts.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("split", "n"))).alias("splits"))
    shares = F.transform("splits", lambda x: F.struct(x["split"].alias("split"), x["n"].alias("n"), (x["n"] / F.col("total")).alias("share")))
    told.select(F.lit(seed).cast("long").alias("seed"), F.coalesce("total", F.lit(0)).alias("total"), shares.alias("splits")).coalesce(1).write.mode("overwrite").json(f"{root}.metadata")


def read_split_metadata(spark: SparkSession, root: str) -> DataFrame:
    """seed, total, splits (split, n, share) as they were written."""
    return spark.read.schema("seed long, total long, splits array<struct<split:string,n:long,share:double>>").json(f"{root}.metadata")


def union_of_globs(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """path, name, folder and kind of the files below root that any of the globs names; one that several name comes once."""
    if not globs:
        raise ValueError("no glob")
    part = F.split("path", "/")
    return below(spark, root, *globs).select("path", F.element_at(part, -1).alias("name"), F.element_at(part, -2).alias("folder"), extension(F.col("path")).alias("kind"))


def _shown(name: str) -> bool:
    """As Spark's readers see it: names that begin with a dot or an underscore are hidden, but for partition folders."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _entries(files, place: str, sizes: bool):
    """Name, whether it is a folder, and bytes of all that lies directly in a folder; one of this machine is read as it comes, not held, and sizes are looked up only if asked for."""
    if files.type_name == "local":
        with os.scandir(place) as found:
            for e in found:
                with contextlib.suppress(FileNotFoundError):  # gone meanwhile
                    is_folder = e.is_dir()
                    yield e.name, is_folder, None if is_folder or not sizes else e.stat().st_size
        return
    from pyarrow import fs

    for i in files.get_file_info(fs.FileSelector(place)):
        yield i.base_name, i.type == fs.FileType.Directory, i.size


def below(spark: SparkSession, root: str, *globs: str, deep: bool = True) -> DataFrame:
    """path and length of the files below root (of those that any of the globs names; of those directly in it if not deep), listed by tasks.

    The driver holds no name of a file. Folders of the first levels are dealt out, so that trees of any
    shape are listed by many tasks; one task lists what lies directly in one folder.
    """
    jvm, path = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(path)  # an error if it is missing
    shown = whole.toString().rstrip("/")
    base = f"file://{quote(whole.toUri().getPath())}" if shown.startswith("file:") else shown
    named = [jvm.GlobPattern(g).compiled().pattern() for g in globs]

    def level(kinds: str):
        """files: those directly in each folder; folders: the same of folders; tree: all files below each."""
        def run(batches):
            import pyarrow as pa

            files, top = sink.opened(base)
            top = top.rstrip("/")
            out: list[tuple[str, int | None]] = []

            def told():
                got = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64()))], ["tail", "length"])
                out.clear()
                return got

            for tail in (x for b in batches for x in b.column("tail").to_pylist()):
                waiting = [tail]
                while waiting:
                    folder = waiting.pop()
                    for name, is_folder, size in _entries(files, top + folder, kinds != "folders"):
                        if is_folder and kinds != "files" and _shown(name):
                            (waiting.append(f"{folder}/{name}") if kinds == "tree" else out.append((f"{folder}/{name}", None)))
                        elif not is_folder and kinds != "folders" and _shown(name) and (not named or any(re.fullmatch(g, name, re.S) for g in named)):
                            out.append((f"{folder}/{name}", size))
                        if len(out) >= LISTED:
                            yield told()
            if out:
                yield told()

        return run

    schema = "tail string, length long"
    top = spark.createDataFrame([("",)], "tail string").coalesce(1)
    rows = top.mapInArrow(level("files"), schema)
    if deep:
        first = top.mapInArrow(level("folders"), schema).select("tail").repartition(_tasks(spark), "tail")
        second = first.mapInArrow(level("folders"), schema).select("tail").repartition(_tasks(spark), "tail")
        rows = rows.unionAll(first.mapInArrow(level("files"), schema)).unionAll(second.mapInArrow(level("tree"), schema))
    return rows.select(F.concat(F.lit(shown), "tail").alias("path"), "length")


def _tasks(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def contents(rows: DataFrame, name: str = "image") -> DataFrame:
    """rows with a path, and the file's bytes as a column more. Rows are dealt over tasks, whichever folders their files lie in; a task holds few files at a time. A missing file is an error."""

    def run(batches):
        import pyarrow as pa

        known: dict = {}  # file systems, and where their paths begin
        for b in pieces(batches):
            got, first, size = [], 0, 0
            for i, path in enumerate(b.column("path").to_pylist()):
                root, place = re.fullmatch(r"(file:|[^:/]+://[^/]*)(/.*)", path, re.S).groups()
                if root not in known:
                    known[root] = sink.opened(f"{root}/" if root != "file:" else "/")
                with known[root][0].open_input_stream(known[root][1].rstrip("/") + place) as f:
                    got.append(f.read())
                size += len(got[-1])
                if size > HELD or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, i + 1 - first).columns, pa.array(got, pa.binary())], [*b.schema.names, name])
                    got, first, size = [], i + 1, 0

    return rows.repartition(_tasks(rows.sparkSession), "path").mapInArrow(run, StructType([*rows.schema.fields, StructField(name, BinaryType())]))


def binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The files below root, whole: path, length, content."""
    return contents(below(spark, root, *([glob] if glob else [])), "content")


def list_images(spark: SparkSession, root: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """path, folder (the last), file, length of all images below root; contents are not read."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, folder string, file string, length long")
    rows = below(spark, root)
    part = F.split("path", "/")
    return rows.filter(extension(F.col("path")).isin(*types)).select("path", F.element_at(part, -2).alias("folder"), F.element_at(part, -1).alias("file"), "length")


def folders_with_images(spark: SparkSession, root: str, types: tuple[str, ...] = ("jpg", "png")) -> DataFrame:
    return list_images(spark, root, types).groupBy("folder").agg(F.count("*").alias("n_images"))


def sound_images(images: DataFrame, least: int = LEAST_IMAGE, trusted: str = "/drive/") -> DataFrame:
    """Without files that are too small to be images; those on trusted paths stay."""
    return images.filter((F.col("length") >= least) | F.col("path").contains(trusted))


def resolve(labels: DataFrame, images: DataFrame, base: str, nested_first: bool = False) -> DataFrame:
    """Labels with the path of their image_file: base/file, else base/images/file (or the other way round); unresolved rows go."""
    root = base.rstrip("/")
    known = images.select("path", F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})").alias("tail")).filter(F.col("path").contains(f"{root}/"))
    ways = known.select(F.regexp_replace("tail", "^images/", "").alias("image_file"), F.struct((F.col("tail").startswith("images/") != F.lit(nested_first)).alias("later"), "path").alias("way"))
    best = ways.groupBy("image_file").agg(F.min("way").alias("way")).select("image_file", F.col("way.path").alias("path"))
    return labels.join(best, "image_file")


def image_table(spark: SparkSession, resolved: DataFrame, root: str) -> DataFrame:
    """Resolved labels with the image's bytes, ready for a Parquet sink; difficulty defaults to `unknown`."""
    base = root.split(":")[-1].rstrip("/")
    level = F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("unknown")) if "difficulty" in resolved.columns else F.lit("unknown")
    return contents(resolved.withColumn("difficulty", level).filter(F.col("path").contains(f"{base}/")))


def folder_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Size in MiB of every folder directly below root."""
    files = below(spark, root)
    folder = F.element_at(F.split(F.element_at(F.split("path", f"{root.rstrip('/')}/", 2), -1), "/"), 1)
    return files.groupBy(folder.alias("folder")).agg((F.sum("length") / F.lit(1048576.0)).alias("mib"))


def to_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Listings (tail: the path below the root, length): what a sync copies, files that the target lacks or has in another size."""
    return source.join(target, ["tail", "length"], "left_anti")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """tail and length of all files below root; empty if it is missing."""
    if not exists(spark, root):
        return spark.createDataFrame([], "tail string, length long")
    files = below(spark, root)
    return files.select(F.element_at(F.split("path", f"{root.split(':')[-1].rstrip('/')}/", 2), -1).alias("tail"), "length")


def row_at(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    """The row whose ordinal is k; reading it fails if there is none."""
    hit = df.filter(F.col(ordinal) == k)
    if hit.isEmpty():
        raise IndexError(f"no row {k}")
    return hit
