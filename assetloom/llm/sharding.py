"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number in (0, 1) from the record key and its own number; the shard with the
largest ``-weight / ln(draw)`` takes the record. A record's shard thus depends on its key and the
shards alone, shares are proportional to the weights, and one more shard takes records only into
itself. Slots number the records of a shard without gaps: records are dealt into about sqrt(n)
blocks by a hash of the key, each block is numbered on its own and starts where the blocks before
it end, so that no task sorts a whole shard.

Cases: a null key is a key of its own; a null text has no bytes and the checksum of no bytes (0);
repeated rows go to one shard and get slots of their own, in no particular order among themselves;
an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def _draw(key: Column, salt: str) -> Column:
    """48 bits of MD5 as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard of a key (string, not null) among ``len(weights)`` shards of those weights."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    bids = [F.struct((F.lit(-float(w)) / F.ln(_draw(key, str(s)))).alias("bid"), F.lit(-s).alias("n")) for s, w in enumerate(weights)]
    return (-F.array_max(F.array(*bids))["n"]).cast("int")


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards and number them there; ``grown_shard`` is the shard with one more of ``grown_weight``."""
    n = docs.count()
    blocks = max(1, math.isqrt(n))
    key = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    text = F.coalesce(docs[text_col], F.lit(""))
    dealt = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous_shard(key, weights).alias("shard"),
        rendezvous_shard(key, [*weights, grown_weight]).alias("grown_shard"),
        F.floor(_draw(key, "block") * blocks).cast("long").alias("block"),
    )
    starts = (
        dealt.groupBy("shard", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32"))
    return (
        dealt.withColumn("rank", rank)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )


#: Shards 0 to 7, all of one weight.
WEIGHTS = [1.0] * 8


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), WEIGHTS)


def _sql_draw(salt: str) -> str:
    return f"((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{salt}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def _sql_best(n: int) -> str:
    bids = ", ".join(f"{{'bid': -1.0::DOUBLE / ln({_sql_draw(str(s))}), 'n': {-s}}}" for s in range(n))
    return f"(-list_max([{bids}]).n)::INTEGER"


#: DuckDB has no CRC-32: its bytes are folded through the 256-entry table, built here from the polynomial.
_SQL_CRC = """(list_reduce(
  list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda a, b: xor(a >> 8, l[xor(a & 255, b) + 1])))"""

OP5_SQL = f"""
WITH RECURSIVE bit(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bit WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS l FROM bit WHERE k = 8),
dealt AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         xor({_SQL_CRC}, 4294967295::BIGINT) AS text_crc32,
         {_sql_best(8)} AS shard, {_sql_best(9)} AS grown_shard,
         floor({_sql_draw("block")} * (SELECT greatest(1, floor(sqrt(count(*)))) FROM documents))::BIGINT AS block
  FROM documents, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM dealt
"""
