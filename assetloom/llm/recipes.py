"""Exact dedup by content-defined chunk recipes.

A text, lower-cased in A to Z, is divided where a hash of the last 8 bytes says so, so that equal texts have equal chunks. Its recipe
is the ordered list of its chunks' identifiers, and equal recipes are equal texts. A text is read where it lies, twice; what is shuffled for it
is its recipe, some thousandth of it.

An identifier is a 64-bit hash once it is verified: chunks of all recipes that occur twice are compared byte by byte, each
distinct chunk once (copies are combined before the shuffle). Texts whose recipe occurs once equal no other and aren't moved at all; a bitmap of
fixed size (``BITS``) tells them from the others. It errs to one side only, so that at worst more chunks are compared. Where two chunks share a hash,
their occurrences are numbered by content and the numbers become part of the recipe, so that no two texts count as equal by accident.

Groups are combined before they are shuffled. Rows get their group's result by a join on the recipe, in which recipes with more than a
thousandth of all rows (fewer than a thousand of them) are split by a salt.

Cases: a null text counts as empty, and all empty ones are equal; a null id is the smallest; of rows that agree in id and text one
stays; an empty table gives no rows; a text of any length is divided block by block; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table

#: Bytes of a chunk: at least, at most, and bits of the hash that are zero at a boundary (4,096 bytes on the average).
LEAST, MOST, ZEROS = 1024, 16384, 12
#: Bytes hashed at a time; bits of the bitmap of repeated recipes (8 MB).
BLOCK, BITS = 1 << 20, 1 << 26
#: Rows of more than this part of all are split.
PART = 1000
Hash = Callable[[bytes], int]


def xxh(chunk: bytes) -> int:
    return xxhash.xxh64_intdigest(chunk) - (1 << 63)


def marks_of(text: bytes) -> list[int]:
    """Places after which a chunk may end: the hash of the 8 bytes before is zero in its first bits."""
    out = []
    for at in range(0, len(text) - 7, BLOCK):
        part = text[at : at + BLOCK + 7]
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        found = np.flatnonzero(words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ZEROS) == 0)
        out += (found + (at + 8)).tolist()
    return out


def chunk_ends(text: bytes) -> list[int]:
    """Where the chunks of a text end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    out, begin = [], 0
    for m in marks_of(text):
        while m - begin > MOST:
            begin += MOST
            out.append(begin)
        if m - begin >= LEAST:
            out.append(m)
            begin = m
    while n - begin > MOST:
        begin += MOST
        out.append(begin)
    return out if begin == n else [*out, n]


def chunks(text: bytes) -> list[bytes]:
    ends = chunk_ends(text)
    return [text[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def _recipe(text: bytes | None, digest: Hash) -> tuple[bytes, list[bytes], list[int], int]:
    low = (text or b"").lower()  # of bytes, A to Z only
    parts = chunks(low)
    ids = [digest(c) for c in parts]
    return low, parts, ids, xxh(np.array(ids, np.int64).tobytes())


def _recipes(digest: Hash) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            sha, recipes, whole = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                low, _, ids, d = _recipe(t, digest)
                sha.append(hashlib.sha256(low).hexdigest())
                recipes.append(ids)
                whole.append(d)
            rows = pa.array(range(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(sha, pa.string()), pa.array(whole, pa.int64()), pa.array(recipes, pa.list_(pa.int64()))], names=["doc", "row", "sha", "d", "recipe"])

    return run


def _bit(d: int) -> int:
    return (d ^ d >> 29) & (BITS - 1)


def _candidates(bitmap: bytes, digest: Hash) -> Callable:
    """Chunks of the texts whose recipe may occur twice, with their text's id and checksum and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows, sha, seq, h, chunk = [], [], [], [], []
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                low, parts, ids, d = _recipe(t, digest)
                x = _bit(d)
                if bitmap[x >> 3] >> (x & 7) & 1:
                    rows += [i] * len(ids)
                    sha += [hashlib.sha256(low).hexdigest()] * len(ids)
                    seq += range(len(ids))
                    h += ids
                    chunk += parts
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(sha, pa.string()), pa.array(seq, pa.int64()), pa.array(h, pa.int64()), pa.array(chunk, pa.binary())], names=["doc", "sha", "seq", "h", "chunk"])

    return run


def _bitmap(repeated: DataFrame) -> bytes:
    """A bit for every recipe of ``repeated`` (d), set by Spark in parts of 4 KB: at most ``BITS`` bits reach the driver."""
    x = F.col("d").bitwiseXOR(F.shiftright("d", 29)).bitwiseAND(F.lit(BITS - 1))
    parts = repeated.select(x.alias("x")).groupBy(F.shiftright("x", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(BITS // 8)
    for part, bits in parts.collect():
        out[part << 12 : part + 1 << 12] = bits
    return bytes(out)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Hash = xxh) -> DataFrame:
    """doc_id, keep_id (the largest id of the equal texts), group_size, kept, text_sha256, n_chunks, for every row."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = d.schema["doc"].dataType.simpleString()
    rec = scratch.saved(d.mapInArrow(_recipes(digest), f"doc {kind}, row long, sha string, d long, recipe array<long>"), keep=True)
    repeated = scratch.saved(rec.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), keep=True)
    chunk_rows = d.mapInArrow(_candidates(_bitmap(repeated), digest), f"doc {kind}, sha string, seq long, h long, chunk binary")
    clashes = scratch.saved(chunk_rows.select("h", "chunk").distinct().groupBy("h").count().where("count > 1").select("h"))
    if clashes.isEmpty():
        rec = rec.withColumn("marks", F.array().cast("array<long>"))
    else:
        marks = scratch.saved(_numbered(chunk_rows, clashes), keep=True)
        same = F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("sha") == F.col("m_sha"))
        rec = rec.join(marks, same, "left").select("doc", "row", "sha", "d", "recipe", F.coalesce("marks", F.array().cast("array<long>")).alias("marks"))
    scratch.clear()
    total = rec.count()
    hot = F.broadcast(repeated.where(F.col("n") * PART > total).select(F.col("d").alias("hot"), F.ceil(F.col("n") * PART / F.lit(max(total, 1))).cast("int").alias("salts")))
    top = F.max(F.struct(F.col("doc").isNotNull().alias("some"), "doc", (-F.col("row")).alias("first"))).alias("top")
    groups = rec.groupBy("d", "recipe", "marks").agg(top, F.count(F.lit(1)).alias("n")).join(hot, F.col("d") == F.col("hot"), "left")
    groups = groups.select(F.col("d").alias("g_d"), F.col("recipe").alias("g_recipe"), F.col("marks").alias("g_marks"), "top", "n", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("g_salt"))
    rows = rec.join(hot, F.col("d") == F.col("hot"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"), F.lit(0)))
    ours = (F.col("d") == F.col("g_d")) & (F.col("salt") == F.col("g_salt")) & (F.col("recipe") == F.col("g_recipe")) & (F.col("marks") == F.col("g_marks"))
    out = rows.join(groups, ours)
    return out.select(F.col("doc").alias("doc_id"), F.col("top.doc").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == -F.col("top.first")).alias("kept"), F.col("sha").alias("text_sha256"), F.size("recipe").cast("long").alias("n_chunks"))


def _numbered(chunk_rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """(m_doc, m_sha, marks): the places of chunks that share their hash with another content, and which content of that hash they have."""
    c = chunk_rows.join(clashes, "h", "left_semi")
    which = c.select("h", "chunk").distinct().withColumn("which", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long"))
    marks = F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("seq", "which"))), lambda x: F.array(x["seq"], x["which"])))
    return c.join(which, ["h", "chunk"]).groupBy(F.col("doc").alias("m_doc"), F.col("sha").alias("m_sha")).agg(marks.alias("marks"))


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
