"""What the operators share: inputs, scratch tables in the shared folder, word splitting.

Scratch tables are written below spark.checkpoint.dir, which driver and executors
share, so a lost executor costs a re-read and never a recomputed lineage.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that goes to a Python worker; texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = 500
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers get at a time, for this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a folder of this machine if all tasks run in this process, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Within this block, the shuffle files of a finished write are removed at once."""
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
    except Exception:  # a version without the setting keeps them until garbage collection
        before = None
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            if before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_live: list["Scratch"] = []


@contextlib.contextmanager
def scratch_freed():
    """The tables that operators write within this block go when it ends; what they return must have been written elsewhere by then."""
    before = len(_live)
    try:
        yield
    finally:
        for s in _live[before:]:
            drop_path(s.spark, s.base)
        del _live[before:]


class Scratch:
    """Tables of one operator call. put() writes a frame and reads it again; drop() removes one. What is left goes when the driver's JVM ends in good order."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        small_batches(spark)
        _live.append(self)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)  # only what exists can be marked
        fs.deleteOnExit(p)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def dealt_join(many: DataFrame, few: DataFrame, keys: list[str], counts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """many joined with few on keys (inner or left), where a key that holds much of many is dealt over several tasks.

    counts: keys and c, how many rows of many they have (keys left out count as rare). A key
    with more than one in `parts` of the rows gets a salt for each such part, taken in many
    from a hash of the columns in by; its rows in few are repeated for each salt. There are at
    most `parts` such keys, so what is broadcast is bounded by the shuffle partitions.
    """
    parts = 4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max((counts.agg(F.sum("c")).first()[0] or 0) // parts, 1)
    hot = F.broadcast(counts.filter(F.col("c") > step).select(*keys, F.ceil(F.col("c") / step).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("__salts")
    right = few.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
