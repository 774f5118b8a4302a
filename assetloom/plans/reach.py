"""Which of many members reach a node: one propagation for all members instead of a walk for each.

Members (routes, entry points) get a bit of a word of 64. A node's members are rows (node, word, bits), and a round sends the bits that a node has newly got along its steps, merged
by ``bit_or`` before they are shuffled. So a node that a thousand members reach has 16 rows instead of a thousand, and a round
costs what is new in it. The rounds end when no node gets a new bit, at the longest of the shortest ways.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import saved


def numbered(members: DataFrame) -> DataFrame:
    """(member, word, bit). Members are dealt to blocks of about 48 by a hash and numbered there, so that no task numbers all."""
    m = saved(members.select("member").distinct())
    blocks = max(1, m.count() // 48)
    m = m.withColumn("block", F.pmod(F.xxhash64("member"), F.lit(blocks)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("member")) - 1
    return m.withColumn("place", place).select("member", F.concat_ws(":", "block", F.floor(F.col("place") / 64)).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))


def reach(steps: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets (node, word, bits) of members that reach each node along the steps (src, dst), and the members' numbers (member, word, bit). starts: member, node."""
    numbers = saved(numbered(starts))
    steps = saved(steps.select("src", "dst").where("src is not null and dst is not null").distinct())
    merged = lambda df: df.groupBy("node", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    new = saved(merged(starts.join(numbers, "member").select("node", "word", F.col("bit").alias("bits"))))
    seen = new
    for r in count(1):
        if new.isEmpty():
            return saved(merged(seen)), numbers
        sent = merged(new.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "word", "bits"))
        had = merged(seen).select(F.col("node").alias("h_node"), F.col("word").alias("h_word"), F.col("bits").alias("had"))
        fresh = sent.join(had, (F.col("node") == F.col("h_node")) & (F.col("word") == F.col("h_word")), "left")
        new = saved(fresh.select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0"))
        seen = seen.unionByName(new)
        seen = seen if r % 16 else saved(merged(seen))


def members_of(sets: DataFrame, numbers: DataFrame, *keys: str) -> DataFrame:
    """(*keys, member): the members in sets with columns word and bits."""
    n = numbers.select(F.col("word").alias("n_word"), "bit", "member")
    return sets.join(n, (F.col("word") == F.col("n_word")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0)).select(*keys, "member")
