"""Connected components of an edge table, by contraction.

Each round relabels the edges, lets every label follow its least neighbour (with
pointer jumping), and drops what became a loop. All steps are joins and minimum
aggregates with partial results, and every round's tables go to the shared folder; no
neighbour list is gathered and nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, jumps: int = 2) -> DataFrame:
    """edges: a, b (any order, repeats allowed). Gives node, root for every node that has an edge; root is the component's least node."""
    live = scratch.put(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    labels = None
    k = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        step = scratch.put(step, f"step{k}-0")
        names = [f"step{k}-0"]
        for j in range(jumps):
            far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
            step = scratch.put(step.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root")), f"step{k}-{j + 1}")
            names.append(f"step{k}-{j + 1}")
        new = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if labels is None:
            labels = scratch.put(step, f"labels{k}")
        else:
            labels = scratch.put(labels.join(new, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"labels{k}")
            scratch.drop(f"labels{k - 1}")
        ends = live.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        live = scratch.put(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{k + 1}")
        scratch.drop(f"edges{k}", *names)
        k += 1
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
