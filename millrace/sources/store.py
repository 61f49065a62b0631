"""Keyed stores of hash buckets with numbered snapshots: what a change doesn't touch is never rewritten.

A snapshot is a small JSON file that names the folder of each bucket. A change reads the
buckets that its keys fall in, writes those anew beside the old ones, and then makes the next
snapshot by a rename that fails if another writer has made it first: then nothing of the
change is seen, its files go, and the writer gets a Conflict. Readers keep the snapshot that they opened.

Buckets are chosen when the store is made, so that one bucket is one task's work; the driver
holds a path for each bucket and nothing that grows with the rows. A row replaces the whole
row of its key. A change with a key twice is an error, unless `latest` names a column whose
greatest value decides (nulls are least). A null key is a key like any other. A store without rows,
and a change without rows, are fine; the latter makes no snapshot.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOT = re.compile(r"(\d{12})\.json$")


class Conflict(RuntimeError):
    """Another writer made the next snapshot first."""


class Store:
    """Opens the store below base, or makes one (schema, key and buckets are then needed)."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType | str | None = None, key: str | None = None, buckets: int = 64):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        if not self.numbers():
            if schema is None or key is None:
                raise ValueError(f"no store below {base}")
            kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
            try:
                self._publish(0, {"key": key, "buckets": buckets, "schema": kind.jsonValue(), "folders": {}})
            except Conflict:
                pass  # someone else has just made it
        first = self._told(0)
        self.key, self.buckets, self.schema = first["key"], first["buckets"], StructType.fromJson(first["schema"])

    # files

    def _path(self, tail: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{tail}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """The snapshots that there are, oldest first."""
        if not self._fs().exists(self._path("snapshots")):
            return []
        return sorted(int(m[1]) for s in self._fs().listStatus(self._path("snapshots")) if (m := SNAPSHOT.search(s.getPath().getName())))

    def _told(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"snapshots/{number:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, number: int, told: dict) -> None:
        """Makes the snapshot, whole or not at all."""
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"snapshots/{number:012d}.json")
        out = self._fs().create(draft)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        self._fs().mkdirs(final.getParent())
        replacing_nothing = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf).rename(draft, final, replacing_nothing)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.toString():
                raise Conflict(f"snapshot {number} of {self.base} was made by another writer") from None
            raise

    # rows

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{f}" for f in folders])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot, by default of the last one."""
        told = self._told(self.numbers()[-1] if number is None else number)
        return self._rows(list(told["folders"].values()))

    def upsert(self, rows: DataFrame, latest: str | None = None, on: int | None = None) -> int:
        """Puts the rows in the place of those with their keys; the new snapshot's number. on: the snapshot that the change is meant for, by default the last one."""
        names = self.schema.names
        kept = [F.col(f"`{n}`").cast(self.schema[n].dataType).alias(n) for n in names]
        change = rows.select(*kept, (F.col(latest) if latest else F.lit(0)).alias("__order"), F.lit(True).alias("__new"))
        return self._change(change, latest is not None, on)

    def remove(self, keys: DataFrame, on: int | None = None) -> int:
        """Takes the rows of the keys (a column named as the store's) out."""
        gone = [F.col(n) if n == self.key else F.lit(None).cast(self.schema[n].dataType).alias(n) for n in self.schema.names]
        change = keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).distinct().select(*gone, F.lit(0).alias("__order"), F.lit(False).alias("__new"))
        return self._change(change, True, on)

    def _change(self, change: DataFrame, ordered: bool, on: int | None) -> int:
        base = self.numbers()[-1] if on is None else on
        told = self._told(base)
        change = change.withColumn("__bucket", self.bucket(F.col(self.key)))
        touched = sorted(r[0] for r in change.select("__bucket").distinct().collect())
        if not touched:
            return base
        names = self.schema.names
        old = self._rows([told["folders"][str(b)] for b in touched if str(b) in told["folders"]])
        old = old.withColumn("__bucket", self.bucket(F.col(self.key))).select(*names, F.lit(None).cast(change.schema["__order"].dataType).alias("__order"), F.lit(None).cast("boolean").alias("__new"), "__bucket")
        both = change.select(*old.columns).unionByName(old).repartition(min(len(touched), self.buckets), "__bucket")
        # the store's row is the least, then rows of the change by their order
        row = F.struct(F.col("__new").isNotNull().alias("fresh"), F.col("__order").alias("order"), F.struct(*names).alias("row"), F.col("__new").alias("new"))
        best = both.groupBy("__bucket", F.col(self.key).alias("__key")).agg(
            F.max_by(row, F.struct(row["fresh"], F.col("__order").isNotNull(), F.col("__order"))).alias("best"), F.count(F.when(F.col("__new").isNotNull(), 1)).alias("n")
        )
        if not ordered:
            twice = F.raise_error(F.concat(F.lit("a key occurs twice in the change: "), F.coalesce(F.col("__key").cast("string"), F.lit("null"))))
            best = best.withColumn("best", F.when(F.col("n") > 1, twice).otherwise(F.col("best")))
        left = best.filter(~F.col("best.fresh") | F.col("best.new")).select("best.row.*", "__bucket")
        folder = f"data/{base + 1:012d}-{uuid.uuid4().hex}"
        try:
            left.write.partitionBy("__bucket").parquet(f"{self.base}/{folder}")
            made = {m[1] for s in self._fs().listStatus(self._path(folder)) if (m := re.fullmatch(r"__bucket=(\d+)", s.getPath().getName()))}
            folders = {b: f for b, f in told["folders"].items() if int(b) not in set(touched)} | {b: f"{folder}/__bucket={b}" for b in made}
            self._publish(base + 1, told | {"folders": folders})
        except BaseException:
            self._fs().delete(self._path(folder), True)
            raise
        return base + 1

    def vacuum(self, keep: int = 1) -> int:
        """Takes away all but the last `keep` snapshots (the first one stays as the store's head), and the folders that none of them names; how many folders went."""
        numbers = self.numbers()
        kept = set(numbers[-max(keep, 1) :])
        named = {f.split("/__bucket")[0] for n in kept for f in self._told(n)["folders"].values()} | {f for n in kept for f in self._told(n)["folders"].values()}
        for n in numbers:
            if n and n not in kept:
                self._fs().delete(self._path(f"snapshots/{n:012d}.json"), False)
        gone = 0
        if self._fs().exists(self._path("data")):
            for s in self._fs().listStatus(self._path("data")):
                # a folder of a later number belongs to a writer who hasn't finished
                if f"data/{s.getPath().getName()}" not in named and int(s.getPath().getName()[:12]) <= numbers[-1]:
                    self._fs().delete(s.getPath(), True)
                    gone += 1
        return gone
