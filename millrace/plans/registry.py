"""Registering SQL plans: the tables that a plan names become views of the given folder."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def dealt_out(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where they lie in fewer partitions than there are cores; larger tables stay as they are. For work that costs far more than a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def spread(rows: DataFrame) -> DataFrame:
    """The rows in even shares over all cores, several tasks each, wherever they lie: a table may have fewer row groups than splits. For rows that cost far more than their shuffle."""
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def sorted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides by key, sorted and merged: for sides of a row a picture, whose size is underestimated from the table they are made of, so that one would be collected by the driver and broadcast."""
    return left.hint("merge").join(right.hint("merge"), key)


#: Pictures of a batch that goes to a Python worker, which holds a batch several times over.
PICTURES = 128


def small_batches(spark: SparkSession) -> None:
    """Bounds the pictures that Python workers get at a time, for this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= PICTURES:
        spark.conf.set(key, PICTURES)


#: Bytes of a block that is freed once in each worker; the allocator keeps up to twice as much for later arrays from then on.
KEPT = 24 << 20


@lru_cache(1)
def keep_heap() -> None:
    """Freed arrays of a picture are used for the next one: otherwise the heap's top is given back and its pages are cleared anew for each array."""
    np.empty(KEPT, np.uint8)


def pieces(batches, most: int = 64):
    """Arrow batches, cut where they have more rows: for rows that are large, or become so in Python."""
    keep_heap()
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def plan(sql: str, prepared=lambda rows: rows):
    """A query function for Spark SQL over the driver tables, which are handed over as (prepared) frames: no view stays in the session."""
    named = rf"(\b(?:FROM|JOIN)\s+)({'|'.join(TABLES)})\b"
    used = {m[2] for m in re.finditer(named, sql)}
    text = re.sub(named, r"\1{__\2}", re.sub(r"([{}])", r"\1\1", sql))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {f"__{t}": prepared(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in used}
        return spark.sql(text, **frames)

    return run


class Group:
    """Queries of one kind, with their SQL for the other engine (the same text unless one is given)."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str, oracle: str | None = None) -> None:
        self.queries[name], self.sql[name] = plan(sql), oracle or sql

    def frame(self, name: str, run, oracle: str | None) -> None:
        self.queries[name] = run
        if oracle:
            self.sql[name] = oracle
