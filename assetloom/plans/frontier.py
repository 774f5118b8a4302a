"""Frontier loops: many-rooted graph walks as rounds of joins.

The state is ``visited(root, node, depth)``. A round joins the frontier with the edges, drops what
its root has visited, and becomes the next frontier. Only ids travel through the loop; attributes
are joined afterwards. A frontier of at most ``FEW`` rows is broadcast, so that the edges are read but
not shuffled in its round. For the first larger one the edges are laid out by their source, once (``Clustered``); from then on frontiers
go to the edges, which no round shuffles again. Each round is cut from its lineage in the shared
checkpoint folder, so a walk survives lost executors: a lost part of the layout is made again from the written edges.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut, saved

#: Rows of two ids that may be broadcast: about 100 bytes each.
FEW = 200_000


def few(frontier: DataFrame, n: int) -> DataFrame:
    """The frontier of ``n`` rows for a join with the edges."""
    return F.broadcast(frontier) if n <= FEW else frontier


def looked_up(ids: DataFrame) -> DataFrame:
    """One row for each id, for a join with many rows: sent to the rows if few (of one id, twice as many as of two), else hashed where both are brought together, so that the rows aren't sorted."""
    return F.broadcast(ids) if ids.count() <= 2 * FEW else ids.hint("shuffle_hash")


#: Ids that may be broadcast as 64-bit hashes: about 20 bytes each.
FEW_HASHES = 4_000_000


def at_ids(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``ids`` (one column), and, by hashes that agree, a few others: for rows that are joined by that column afterwards. The rows aren't shuffled where the hashes are few."""
    hashes = ids.select(F.xxhash64(ids.columns[0]).alias("_hash")).distinct()
    sent = F.broadcast(hashes) if hashes.count() <= FEW_HASHES else hashes.hint("shuffle_hash")
    return rows.join(sent, F.xxhash64(column) == F.col("_hash"), "left_semi")


#: A source with more than this part of all edges is a hub.
HUB = 1000


class Clustered:
    """Written steps with the source column ``key``, met by frontiers of any size.

    The layout is made when a frontier is too large to be broadcast. Hubs, fewer than ``HUB``, are divided by a hash of the whole step into parts of about that share, and
    a frontier's rows at a hub are sent to all its parts."""

    def __init__(self, steps: DataFrame, key: str):
        self.steps, self.key, self.layout, self.hubs = steps, key, None, None

    def _lay(self) -> None:
        total = self.steps.count()
        parts = self.steps.groupBy(F.col(self.key).alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HUB > total).where("n > 1")
        self.hubs = cut(parts.select("hub", F.ceil(F.col("n") * HUB / F.lit(max(total, 1))).cast("int").alias("parts")))
        divided = self.steps.join(F.broadcast(self.hubs), F.col(self.key) == F.col("hub"), "left")
        part = F.coalesce(F.pmod(F.xxhash64(*self.steps.columns), F.col("parts")).cast("int"), F.lit(0))
        self.layout = divided.select(*self.steps.columns, part.alias("part")).repartition(self.key, "part").persist(StorageLevel.DISK_ONLY)

    def met(self, frontier: DataFrame, n: int, node: str = "node") -> DataFrame:
        """The frontier of ``n`` rows joined with the steps that leave its nodes."""
        if n <= FEW:
            return F.broadcast(frontier).join(self.steps, frontier[node] == self.steps[self.key])
        if self.layout is None:
            self._lay()
        sent = frontier.join(F.broadcast(self.hubs), F.col(node) == F.col("hub"), "left")
        sent = sent.select(*frontier.columns, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("to_part"))
        return sent.join(self.layout, (F.col(node) == self.layout[self.key]) & (F.col("to_part") == F.col("part"))).drop("to_part", "part")

    def clear(self) -> None:
        if self.layout is not None:
            self.layout.unpersist()


def grown(seen: DataFrame, more: DataFrame, level: int) -> DataFrame:
    """Rows seen so far with those of a round; the plan is cut now and then, so that long walks don't pile up unions."""
    both = seen.unionByName(more)
    return both if level % 16 else cut(both)


def steps_of(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(src, dst) steps along, against or in both directions of the edges, parallel ones as often as they are: a walk makes distinct what a round finds, so that all edges needn't be brought together for it."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    out = e.select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()
    return steps.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def adjacency(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """Distinct (src, dst) steps along, against or in both directions of the edges."""
    return steps_of(edges, direction, types).distinct()


def clustered(steps: DataFrame) -> Clustered:
    """Steps (src, dst), written once, for several walks."""
    return Clustered(saved(steps.select(F.col("src").alias("from"), F.col("dst").alias("next"))), "from")


def walk(steps: DataFrame | Clustered, roots: DataFrame, depth: int | None = None, closed: Column | None = None) -> DataFrame:
    """(root, node, depth) with the least depth, roots at 0. ``roots``: (root, node) or (root). Nodes that meet ``closed`` are reached but not left. Steps that are ``clustered`` already are left so."""
    if "node" not in roots.columns:
        roots = roots.select("root", F.col("root").alias("node"))
    shared, steps = isinstance(steps, Clustered), steps if isinstance(steps, Clustered) else clustered(steps)
    frontier = cut(roots.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    level, n = 0, frontier.count()
    while n and (depth is None or level < depth):
        level += 1
        leaving = (frontier if closed is None else frontier.where(~closed)).select("root", "node")
        found = steps.met(leaving, n).select("root", F.col("next").alias("node")).distinct()
        frontier = cut(found.join(visited.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        n = frontier.count()
        visited = grown(visited, frontier, level) if n else visited
    if not shared:
        steps.clear()
    return visited


def walk_with_parents(edges: DataFrame, roots: DataFrame, depth: int | None = None, against: bool = False) -> DataFrame:
    """(root, node, depth, parent, via): as ``walk``; the first edge by (type, parent) on the shortest way is the parent's."""
    a, b = ("dst", "src") if against else ("src", "dst")
    steps = Clustered(saved(edges.select(F.col(a).alias("from"), F.col(b).alias("next"), F.col("type").alias("via")).distinct()), "from")
    none = F.lit(None).cast("string")
    frontier = cut(roots.select("root", F.col("root").alias("node")).distinct().select("root", "node", F.lit(0).alias("depth"), none.alias("parent"), none.alias("via")))
    visited = frontier
    level, n = 0, frontier.count()
    while n and (depth is None or level < depth):
        level += 1
        here = frontier.select("root", F.col("node").alias("parent"))
        found = steps.met(here, n, "parent").groupBy("root", F.col("next").alias("node")).agg(F.min(F.struct("via", "parent")).alias("x"))
        found = found.join(visited.select("root", "node"), ["root", "node"], "left_anti")
        frontier = cut(found.select("root", "node", F.lit(level).alias("depth"), "x.parent", "x.via"))
        n = frontier.count()
        visited = grown(visited, frontier, level) if n else visited
    steps.clear()
    return visited


def incident(edges: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Edges that start or end at a node, once for each combination of ``keys`` in ``nodes`` (node, *keys)."""
    n = nodes.select("node", *keys).distinct()
    out = edges.join(n, edges["src"] == n["node"]).drop("node")
    back = edges.join(n, edges["dst"] == n["node"]).drop("node")
    return out.unionByName(back).distinct()
