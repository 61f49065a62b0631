"""Weighted sampling with replacement: each draw finds its item by binary search in the cumulated weights.

Items lie in buckets of their key's hash, of some ITEMS each; the sums of the buckets are few
enough for every task to hold (MOST at most). A draw finds its bucket in those, and then,
with the other draws of that bucket, its item in the bucket's own cumulated weights: one
shuffle of the draws, and a logarithm of steps for each. A bucket that gets far more draws
than others, as one that holds a third of all weight does, has them dealt over several
tasks, each with the bucket's items.

Null and non-positive weights and null keys are never drawn. Weights of a repeated key add up.
Without items, or draws, there are no rows. Equal keys can't tie: they are one item.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import Group

#: Items of a bucket, expected, and the most buckets: 16 bytes each in every task and on the driver.
ITEMS, MOST = 4096, 1 << 20
#: Draws of one bucket that one task takes at least before they are dealt out.
CROWD = 1 << 16


def bits_for(n: int, items: int = ITEMS) -> int:
    """Bits of the hash that number the buckets."""
    return min(max(0, -(-n // items) - 1).bit_length(), MOST.bit_length() - 1)


def weighted_draws(items: DataFrame, key: str, weight: str, draws: DataFrame, items_of: int = ITEMS, crowd: int = CROWD) -> DataFrame:
    """draws: draw, u (a whole number). For each draw the key on which u modulo all weights falls, in the order of the key's md5 and then of the key."""
    spark = items.sparkSession
    rows = items.filter(F.col(key).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(key).alias("__key")).agg(F.sum(F.col(weight).cast("long")).alias("__w"))
    rows = rows.withColumn("__h", F.md5(F.col("__key").cast("string")))
    bits = bits_for(rows.count(), items_of)
    # the first bits of the hash as a number: buckets are ranges of the order
    bucket = F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")
    rows = rows.withColumn("__b", bucket)
    sums = rows.groupBy("__b").agg(F.sum("__w").alias("s")).orderBy("__b").collect()
    buckets, ends = np.array([r["__b"] for r in sums], np.int64), np.cumsum(np.array([r["s"] for r in sums], np.int64))
    total = int(ends[-1]) if len(ends) else 0
    shared = spark.sparkContext.broadcast((buckets, ends))
    src = draws.select("draw", "u").filter(F.col("u").isNotNull())
    kind = src.schema["draw"].dataType.simpleString()

    def placed(batches):
        import pyarrow as pa

        buckets, ends = shared.value
        for b in batches:
            at = b.column("u").to_numpy(zero_copy_only=False).astype(np.int64) % total
            i = np.searchsorted(ends, at, side="right")
            before = np.where(i > 0, ends[i - 1], 0)
            yield pa.RecordBatch.from_arrays([b.column("draw"), pa.array(buckets[i].astype(np.int32)), pa.array(at - before)], ["draw", "b", "at"])

    if not total:
        return src.limit(0).select("draw", F.lit(None).cast(items.schema[key].dataType).alias(key))
    aimed = src.mapInArrow(placed, f"draw {kind}, b int, at long")
    # buckets with more draws than a task should have: no more of them than there are such parts
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = aimed.groupBy("b").agg(F.count("*").alias("c"))
    step = max((counts.agg(F.sum("c")).first()[0] or 0) // parts, crowd)
    hot = F.broadcast(counts.filter(F.col("c") > step).select("b", F.ceil(F.col("c") / step).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = aimed.join(hot, "b", "left").select("b", "draw", "at", F.pmod(F.xxhash64("draw", "at"), salts).cast("int").alias("salt"))
    right = rows.select(F.col("__b").alias("b"), "__h", "__key", "__w").join(hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")

    def found(draws, items):
        import pyarrow as pa

        items = items.sort_by([("__h", "ascending"), ("__key", "ascending")])
        ends = np.cumsum(items.column("__w").to_numpy())
        i = np.searchsorted(ends, draws.column("at").to_numpy(), side="right")
        return pa.table({"draw": draws.column("draw"), key: items.column("__key").take(pa.array(i, pa.int64()))})

    out = f"draw {kind}, `{key}` {items.schema[key].dataType.simpleString()}"
    return left.groupBy("b", "salt").cogroup(right.groupBy("b", "salt")).applyInArrow(found, out)


GROUP = Group()


def _drawn(s, d: str) -> DataFrame:
    labels, orders = (s.read.parquet(f"{d}/{t}.parquet") for t in ("labels", "orders"))
    items = labels.select("doc_id", F.when(F.col("toxic") == 1, 3).otherwise(7).alias("w"))
    return weighted_draws(items.groupBy("doc_id").agg(F.max("w").alias("w")), "doc_id", "w", orders.select(F.col("o_orderkey").alias("draw"), (F.col("o_orderkey") * 7919 + F.col("o_custkey")).alias("u")))


GROUP.frame(
    "weighted_draws",
    _drawn,
    """WITH i AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 3 ELSE 7 END) AS w FROM labels GROUP BY doc_id),
    e AS (SELECT doc_id, w, sum(w) OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS z FROM i)
    SELECT o_orderkey AS draw, doc_id FROM orders JOIN e ON (o_orderkey * 7919 + o_custkey) % (SELECT sum(w) FROM i) < z AND (o_orderkey * 7919 + o_custkey) % (SELECT sum(w) FROM i) >= z - w""",
)
# a source's share of the draws is its ratio: synthetic rows 0.3 of them, each by its weight
GROUP.frame(
    "drawn_by_ratio",
    lambda s, d: _by_ratio(s, d),
    """WITH i AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 3 * (SELECT count(*) FROM part WHERE p_size <= 25) ELSE 7 * (SELECT count(*) FROM part WHERE p_size > 25) END AS w FROM part),
    e AS (SELECT p_partkey, w, sum(w) OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS z FROM i),
    t AS (SELECT sum(w) AS t FROM i), n AS (SELECT l_orderkey * 8 + l_linenumber AS draw, ((l_orderkey * 8 + l_linenumber) * 2654435761) % t AS at FROM lineitem, t),
    h AS (SELECT draw, p_partkey FROM n ASOF JOIN e ON n.at < e.z)
    SELECT p_partkey, count(*) AS n FROM h GROUP BY p_partkey""",
)


def _by_ratio(s, d: str) -> DataFrame:
    part, lines = (s.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    told = part.select("p_partkey", (F.col("p_size") > 25).alias("synthetic"))
    sizes = {r["synthetic"]: r["count"] for r in told.groupBy("synthetic").count().collect()}
    items = told.select("p_partkey", F.when(F.col("synthetic"), 3 * sizes.get(False, 0)).otherwise(7 * sizes.get(True, 0)).alias("w"))
    draw = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    got = weighted_draws(items, "p_partkey", "w", lines.select(draw.alias("draw"), (draw * F.lit(2654435761).cast("long")).alias("u")))
    return got.groupBy("p_partkey").agg(F.count("*").alias("n"))
