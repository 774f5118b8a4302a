"""Pointer doubling: chains of parents in a number of rounds that grows with the logarithm of their length.

Every node points at one parent at most. A round replaces pointers by the pointers of what they lead to, so that after round r they
reach 2^r parents up. A chain of 10,000 parents takes 14 rounds, where a walk takes 10,000. Each round is a join of two frames with one row a node,
written to the shared folder; there is nothing to broadcast, no list that grows with the depth, and no group that is gathered.

Cycles end by the number of rounds: as soon as 2^r reaches the number of nodes, every parent has been met.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut, saved
from .frontier import HUB


def hop(rows: DataFrame, far: str, on: DataFrame, n: str, total: int) -> DataFrame:
    """``rows`` joined with what ``far`` leads to (left): ``on``, written, has one row for each ``n``. Ways run together at the top, so after some rounds most rows point at a few nodes.

    Nodes that more than a thousandth of ``total`` rows point at, fewer than ``HUB``, are sent to the rows; the others are brought together. Rows that point at nothing stay where they are."""
    done = rows.where(F.col(far).isNull()).select(*rows.columns, *(F.lit(None).cast(t).alias(c) for c, t in on.dtypes))
    rows = rows.where(F.col(far).isNotNull())
    hubs = rows.groupBy(F.col(far).alias("hub")).agg(F.count(F.lit(1)).alias("to")).where((F.col("to") * HUB > total) & (F.col("to") > 1))
    hubs = cut(hubs.select("hub").join(on, F.col("hub") == F.col(n), "left"))
    if hubs.isEmpty():
        return rows.join(on, F.col(far) == F.col(n), "left").unionByName(done)
    at_hub = rows.join(F.broadcast(hubs), F.col(far) == F.col("hub")).drop("hub")
    rest = rows.join(F.broadcast(hubs.select("hub")), F.col(far) == F.col("hub"), "left_anti")
    return at_hub.unionByName(rest.join(on, F.col(far) == F.col(n), "left")).unionByName(done)


def nearest(parents: DataFrame, hit: Column, *carried: str) -> DataFrame:
    """(node, hit, dist, *carried): of every node the nearest parent for which ``hit`` holds, if there is one.

    parents: node, up, and columns that ``hit`` and ``carried`` name, which belong to the step from ``node`` to ``up``. On a cycle a node may be its own parent."""
    found = F.when(hit, F.struct(F.lit(1).cast("long").alias("dist"), F.col("up").alias("node"), *carried))
    at = saved(parents.select("node", F.when(hit, None).otherwise(F.col("up")).alias("far"), F.lit(1).cast("long").alias("d"), found.alias("hit")))
    n = at.count()
    for r in count():
        if 1 << r > n or at.where("far is not null").isEmpty():
            break
        on = at.select(F.col("node").alias("n"), F.col("far").alias("n_far"), F.col("d").alias("n_d"), F.col("hit").alias("n_hit"))
        moved = hop(at, "far", on, "n", n)
        further = F.when(F.col("n_hit").isNotNull(), F.struct((F.col("d") + F.col("n_hit.dist")).alias("dist"), F.col("n_hit.node").alias("node"), *(F.col(f"n_hit.{c}").alias(c) for c in carried)))
        at = saved(moved.select("node", F.when(F.col("n_hit").isNull(), F.col("n_far")).alias("far"), (F.col("d") + F.coalesce("n_d", F.lit(0))).alias("d"), F.coalesce("hit", further).alias("hit")))
    return at.where("hit is not null").select("node", F.col("hit.node").alias("hit"), F.col("hit.dist").alias("dist"), *(F.col(f"hit.{c}").alias(c) for c in carried))


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(*starts, dist): with each start (node and further columns, one row for each value of these) all parents above it, itself included, once, with the distance.

    parents: node, up, and steps (1 where it is missing). What is reached doubles in every round; only the starts' own rows are multiplied."""
    keys = [c for c in starts.columns if c not in ("node", "dist")]
    steps = F.col("steps").cast("long") if "steps" in parents.columns else F.lit(1).cast("long")
    jump = saved(parents.where("up is not null").select(F.col("node").alias("j_node"), F.col("up").alias("j_up"), steps.alias("j_steps")))
    n = jump.count()
    reached = cut(starts.select(*keys, "node", (F.col("dist") if "dist" in starts.columns else F.lit(0)).cast("long").alias("dist")))
    while True:
        new = reached.join(jump, F.col("node") == F.col("j_node")).select(*keys, F.col("j_up").alias("node"), (F.col("dist") + F.col("j_steps")).alias("dist"))
        new = saved(new.join(reached.select(*keys, "node"), [*keys, "node"], "left_anti").groupBy(*keys, "node").agg(F.min("dist").alias("dist")))
        if new.isEmpty():
            return reached
        reached = saved(reached.unionByName(new))
        on = jump.select(F.col("j_node").alias("n"), F.col("j_up").alias("n_up"), F.col("j_steps").alias("n_steps"))
        jump = saved(hop(jump, "j_up", on, "n", n).where("n is not null").select("j_node", F.col("n_up").alias("j_up"), (F.col("j_steps") + F.col("n_steps")).alias("j_steps")))


def lifted(parents: DataFrame, asks: DataFrame) -> DataFrame:
    """``asks`` (node, steps and further columns) with the node that many steps above in place of ``node``; those that lead beyond a top are left out. parents: node, up.

    The binary digits of the steps are gone through: a round moves what has a digit there, and doubles the pointers."""
    keys = [c for c in asks.columns if c not in ("node", "steps")]
    jump = saved(parents.where("up is not null").select(F.col("node").alias("n"), F.col("up").alias("n_up")))
    n = jump.count()
    at = saved(asks.select(*keys, "node", F.col("steps").cast("long").alias("steps")))
    while not at.where("steps > 0").isEmpty():
        moved = hop(at.where("steps % 2 = 1"), "node", jump, "n", n).where("n is not null").select(*keys, F.col("n_up").alias("node"), "steps")
        at = saved(at.where("steps % 2 = 0").unionByName(moved).withColumn("steps", F.expr("steps div 2")))
        if at.where("steps > 0").isEmpty():
            break
        on = jump.select(F.col("n").alias("m"), F.col("n_up").alias("m_up"))
        jump = saved(hop(jump, "n_up", on, "m", n).where("m is not null").select("n", F.col("m_up").alias("n_up")))
    return at.drop("steps")


def ranks(links: DataFrame) -> DataFrame:
    """(node, rank): the sum of the weights behind each node of lists, its own included. links: node, next (null at the end of a list), weight, closed.

    Only lists whose last node is ``closed`` are ranked: not those that lead to a missing node, nor cycles, which are left when 2^r has passed the number of nodes."""
    ends = F.col("next").isNull()
    at = saved(links.select("node", F.col("next").alias("far"), F.col("weight").cast("long").alias("rank"), F.when(ends, F.col("closed")).alias("closed")))
    n = at.count()
    for r in count():
        if 1 << r > 2 * n or at.where("far is not null").isEmpty():
            break
        on = at.select(F.col("node").alias("n"), F.col("far").alias("n_far"), F.col("rank").alias("n_rank"), F.col("closed").alias("n_closed"))
        at = saved(at.join(on, F.col("far") == F.col("n"), "left").select("node", F.col("n_far").alias("far"), (F.col("rank") + F.coalesce("n_rank", F.lit(0))).alias("rank"), F.coalesce("closed", "n_closed").alias("closed")))
    return at.where("closed").select("node", "rank")


def preorder(tree: DataFrame) -> DataFrame:
    """(tree_id, node_id, first, last): the number of every node in preorder, from 0, and that of the last node below it. tree: tree_id, node_id, parent_id, ord.

    Siblings, and tops without a parent, come by ord, then node_id; what hangs from no top has no number. The Euler tour enters and leaves every node; its next place is known from siblings and parents alone, and
    ranking the list gives the numbers: two of fixed width, however deep the tree is."""
    w = Window.partitionBy("tree_id", "parent_id").orderBy("ord", "node_id")
    t = saved(tree.select("tree_id", "node_id", "parent_id", F.row_number().over(w).alias("place"), F.lead("node_id").over(w).alias("beside")))
    first = t.where("parent_id is not null and place = 1").select(F.col("tree_id").alias("c_tree"), F.col("parent_id").alias("c_parent"), F.col("node_id").alias("below"))
    j = t.join(first, (F.col("tree_id") == F.col("c_tree")) & (F.col("node_id") == F.col("c_parent")), "left")
    place = lambda node, leaving: F.struct("tree_id", F.col(node).alias("node_id"), F.lit(leaving).alias("leaving"))
    enter = F.struct(place("node_id", False).alias("node"), F.when(F.col("below").isNotNull(), place("below", False)).otherwise(place("node_id", True)).alias("next"), F.lit(1).alias("weight"), F.lit(False).alias("closed"))
    after = F.when(F.col("beside").isNotNull(), place("beside", False)).when(F.col("parent_id").isNotNull(), place("parent_id", True))
    leave = F.struct(place("node_id", True).alias("node"), after.alias("next"), F.lit(0).alias("weight"), F.col("parent_id").isNull().alias("closed"))
    r = saved(ranks(j.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*")).select("node.*", "rank"))
    size = r.groupBy("tree_id").agg(F.max("rank").alias("n"))
    pair = r.groupBy("tree_id", "node_id").agg(F.max(F.when(~F.col("leaving"), F.col("rank"))).alias("a"), F.max(F.when(F.col("leaving"), F.col("rank"))).alias("z"))
    return pair.join(size, "tree_id").select("tree_id", "node_id", (F.col("n") - F.col("a")).alias("first"), (F.col("n") - F.col("z") - 1).alias("last"))
