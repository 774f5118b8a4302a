"""Connected components by alternating star operations (Kiveris et al., 2014).

Every round replaces the edges by a smaller graph with the same components and fewer levels; the
rounds end when nothing changes, after about log(longest path) of them. Edges are partitioned by
node and pre-aggregated, so a node with very many neighbours is only a minimum to be computed and
a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b). Needs one orderable type. Raises if ``rounds``, far more than graphs of any size take, don't do."""
    e = edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    e = cut(e)
    last = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = e.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        down = e.join(least, F.col("b") == F.col("n")).select("m", F.col("a").alias("n")).where("m <> n")
        e = cut(down.union(least.select("m", "n")).distinct().select(F.col("m").alias("a"), F.col("n").alias("b")))
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.crc32(F.concat_ws(":", "a", "b").cast("binary"))).alias("s")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components have not converged in {rounds} rounds")
    found = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return found.union(nodes.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
