"""Chat formatting after collapsing cumulative snapshots, with DataFrame functions only.

Chat services log a conversation again after every turn, so that most logged conversations are
prefixes of longer ones. The turns of a conversation are numbered, each numbered turn is hashed with
its number, and running sums of the hashes give a rolling hash of every turn prefix (two 64-bit
hashes in four 32-bit lanes, whose sums can't overflow before 2^31 turns). A conversation whose
whole hash is a proper prefix of another one is dropped by an anti-join; of equal conversations the
one with the smallest id stays. What is left is rendered.

Texts are hashed before anything is shuffled, so they travel only to be rendered. Numbering and
sums run inside blocks of turn numbers and again over block totals, and a conversation is rendered
in parts, one for each block, so no task holds a whole conversation.

Cases: turns are ordered by turn number (null first), then role, then a hash of the text; a null role is
rendered as ``unknown`` and a null text as empty, but both differ from their stand-ins when
conversations are compared; rows with a null conversation id form one conversation; repeated rows
are repeated turns; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

LANES = ["l0", "l1", "l2", "l3"]
BLOCK = 256
#: Conversations that may be broadcast: 40 bytes each.
FEW = 500_000


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, block: int) -> DataFrame:
    """ck (the conversation id as text, never null), conv, blk, turn, role, text."""
    t = turns.select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    return t.withColumns({"ck": key, "blk": F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62)))})


def _text_hashes() -> tuple[Column, Column]:
    return F.xxhash64("text", F.col("text").isNull()), F.xxhash64(F.lit("second"), "text", F.col("text").isNull())


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Every turn prefix of the conversations: ck, conv, blk, ord (its number of turns), l0 to l3 (its hash)."""
    h, g = _text_hashes()
    t = turns.select("ck", "conv", "blk", "turn", "role", h.alias("h"), g.alias("g"))
    within = Window.partitionBy("ck", "blk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "h", "g")
    before = Window.partitionBy("ck").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy("ck", "blk").agg(F.count(F.lit(1)).alias("n")).select("ck", "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    t = t.withColumn("rn", F.row_number().over(within)).join(starts, ["ck", "blk"])
    t = t.select("ck", "conv", "blk", (F.col("start") + F.col("rn")).alias("ord"), "role", "h", "g")
    given = (F.col("ord"), F.col("role"), F.col("role").isNull())
    t = t.withColumns({"p": F.xxhash64(*given, "h"), "q": F.xxhash64(F.lit("second"), *given, "g")})
    mask = F.lit(0xFFFFFFFF)
    t = t.select("ck", "conv", "blk", "ord", F.col("p").bitwiseAND(mask).alias("l0"), F.shiftrightunsigned("p", 32).alias("l1"), F.col("q").bitwiseAND(mask).alias("l2"), F.shiftrightunsigned("q", 32).alias("l3"))
    t = saved(t)
    sums = t.groupBy("ck", "blk").agg(*(F.sum(x).alias(x) for x in LANES))
    sums = sums.select("ck", "blk", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in LANES))
    running = Window.partitionBy("ck", "blk").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({x: F.sum(x).over(running) for x in LANES}).join(sums, ["ck", "blk"])
    return t.select("ck", "conv", "blk", "ord", *((F.col(x) + F.col(f"before_{x}")).alias(x) for x in LANES))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another, one of each: ck, n_turns, n_copies."""
    ends = prefixes.groupBy("ck").agg(F.max_by(F.struct("conv", "ord", *LANES), "ord").alias("end")).select("ck", "end.*")
    whole = ends.groupBy("ord", *LANES).agg(F.min(F.struct(F.col("conv").isNull().alias("none"), "conv", "ck")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    ended = prefixes.join(ends.select("ck", F.col("ord").alias("last")), "ck")
    proper = ended.where("ord < last").select("ord", *LANES).distinct()
    return whole.join(proper, ["ord", *LANES], "left_anti").select(F.col("first.ck").alias("ck"), F.col("ord").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, head: str = "<|im_start|>", tail: str = "<|im_end|>") -> DataFrame:
    """Rendered parts of the kept conversations: conv, part (from 0), n_turns, n_copies, rendered."""
    h, g = _text_hashes()
    t = turns.join(F.broadcast(kept) if kept.count() <= FEW else kept, "ck")
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{tail}\n"))
    seg = F.struct("turn", "role", h.alias("h"), g.alias("g"), line.alias("line"))
    parts = t.repartition("ck", "blk").groupBy("ck", "blk").agg(F.first("conv").alias("conv"), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(seg)).alias("segs"))
    parts = parts.select("ck", "blk", "conv", "n_turns", "n_copies", F.array_join(F.transform("segs", lambda x: x["line"]), "").alias("rendered"))
    numbers = turns.select("ck", "blk").distinct().select("ck", "blk", (F.row_number().over(Window.partitionBy("ck").orderBy("blk")) - 1).cast("long").alias("part"))
    return parts.join(numbers, ["ck", "blk"]).select("conv", "part", "n_turns", "n_copies", "rendered")


def collapse_and_render(turns: DataFrame, block: int = BLOCK, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    t = _turns(turns, conv_col, turn_col, role_col, text_col, block)
    kept = saved(maximal_conversations(saved(turn_prefixes(t))))
    return render(t, kept)


def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


OP4_SQL = """
WITH c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l, count(*) AS n
  FROM conversations GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, l, n, count(*) AS n_copies FROM c GROUP BY l, n),
k AS (SELECT conv_id, n, n_copies FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n > a.n AND b.l[1] = a.l[1] AND b.l[1:a.n] = a.l)),
t AS (SELECT conv_id, n, n_copies, turn, role, text, turn // 256 AS blk FROM k JOIN conversations USING (conv_id)),
p AS (
  SELECT conv_id, blk, any_value(n) AS n_turns, any_value(n_copies) AS n_copies,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
  FROM t GROUP BY conv_id, blk)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY blk NULLS FIRST) - 1 AS part, n_turns, n_copies, rendered FROM p
"""
