"""Transitive closure of a link table from seeds, by frontiers.

Each round joins the last frontier with the links and takes away what has been visited.
Rounds are cut by checkpoint(), in the session's folder; only "is there more" reaches
the driver. As many rounds run as the longest shortest path has links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.registry import Group

GROUP = Group()


def closure(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """links: src, dst. seeds: node. Gives node and depth (links from the nearest seed); null ends link nothing."""
    spark = links.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    links = links.select("src", "dst").dropna().distinct().checkpoint()
    frontier = seeds.select("node").dropna().distinct().checkpoint()
    levels = []
    while not frontier.isEmpty():
        levels.append(frontier.selectExpr("node", f"{len(levels)} AS depth"))
        seen = reduce(DataFrame.unionByName, levels).select("node")
        reached = frontier.join(links, frontier["node"] == links["src"]).select(links["dst"].alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti").checkpoint()
    return reduce(DataFrame.unionByName, levels) if levels else frontier.selectExpr("node", "0 AS depth")


def link_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers reached from supplier 1 when a part in a line links the line's supplier to the one its number falls on."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    links = lines.selectExpr("l_suppkey AS src", f"l_partkey % {max(n, 1)} + 1 AS dst")
    return closure(links, spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey = 1").selectExpr("s_suppkey AS node"))


# The other engine keeps depths by carrying all that has been visited, one row a round.
GROUP.frame("link_closure", link_closure, """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT greatest(count(*), 1) FROM supplier) + 1 AS dst FROM lineitem),
  w AS (SELECT 0 AS depth, list(s_suppkey) AS front, list(s_suppkey) AS seen FROM supplier WHERE s_suppkey = 1
    UNION ALL SELECT w.depth + 1, x.front, list_concat(w.seen, x.front) FROM w, LATERAL (SELECT list(DISTINCT dst) AS front FROM e WHERE list_contains(w.front, src) AND NOT list_contains(w.seen, dst)) x WHERE len(x.front) > 0)
  SELECT unnest(front) AS node, depth FROM w""")
