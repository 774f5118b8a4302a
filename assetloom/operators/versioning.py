"""Merging and unfolding of graphs: nodes are (node, type, label, ...), edges (type, src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetloom.plans.frontier import adjacency, walk


def prefix_of(anchor: str) -> str:
    return f"exp:{anchor}:"


def merge_expansion(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame, root: str, anchor: str) -> tuple[DataFrame, DataFrame]:
    """Splice a graph in below an anchor: its root becomes the anchor, its other ids get the anchor's prefix, and what is there already stays."""
    new = lambda c: F.when(F.col(c) == root, F.lit(anchor)).otherwise(F.concat(F.lit(prefix_of(anchor)), c))
    added = more_nodes.withColumn("node", new("node")).join(nodes.select("node"), "node", "left_anti")
    linked = more_edges.withColumns({"src": new("src"), "dst": new("dst")}).join(edges.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti")
    return nodes.unionByName(added.select(*nodes.columns)), edges.unionByName(linked.select(*edges.columns))


def preview_nodes(nodes: DataFrame, edges: DataFrame, anchor: str, is_preview) -> DataFrame:
    """(node): preview nodes below an anchor, reached through previews only."""
    shown = nodes.where(is_preview).select("node")
    e = edges.join(shown.withColumnRenamed("node", "dst"), "dst", "left_semi")
    start = nodes.where(F.col("node") == anchor).select(F.col("node").alias("root"))
    return walk(adjacency(e), start).where("depth > 0").select("node")


def collapse_expansion(nodes: DataFrame, edges: DataFrame, anchor: str) -> tuple[DataFrame, DataFrame]:
    """Without the nodes spliced in below an anchor and their edges."""
    p = prefix_of(anchor)
    return nodes.where(~F.col("node").startswith(p)), edges.where(~F.col("src").startswith(p) & ~F.col("dst").startswith(p))


def merge_chain(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs of a chain (nodes and edges with chain, pos) as one: ids get their position as prefix, each root hangs below the graph before it at its slot, or else its root. roots: chain, pos, root, slot."""
    tag = lambda c: F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit(":"), c)
    n = nodes.withColumn("node", tag("node"))
    e = edges.withColumns({"src": tag("src"), "dst": tag("dst")})
    w = Window.partitionBy("chain").orderBy("pos")
    r = roots.withColumns({"at": tag("root"), "hook": F.coalesce(tag("slot"), tag("root"))})
    joints = r.select("chain", "pos", F.lit("children-slot").alias("type"), F.lag("hook").over(w).alias("src"), F.col("at").alias("dst")).where("src is not null")
    return n, e.select("chain", "pos", "type", "src", "dst").unionByName(joints)


def anchor_of(nodes: DataFrame) -> DataFrame:
    """(node, anchor): for spliced ids (``exp:<anchor>:<rest>``) the longest known id that they name, found by trying all prefixes at a colon."""
    n = nodes.where(F.col("node").startswith("exp:")).select("node", F.expr("substring(node, 5)").alias("rest"))
    parts = F.split("rest", ":")
    tried = n.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))).alias("anchor"))
    known = nodes.select(F.col("node").alias("anchor")).distinct()
    return tried.join(known, "anchor").groupBy("node").agg(F.max_by("anchor", F.char_length("anchor")).alias("anchor"))
