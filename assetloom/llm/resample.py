"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs are fitted: one on target texts (labelled
good and not toxic), one on all raw texts. A document's log importance weight is the sum of the log
ratios of its n-grams; adding Gumbel noise and keeping the k largest sums draws k documents without
replacement in proportion to the weights. Raw counts cover all documents; the target model is
fitted on a sample of at most ``most_targets`` labelled rows (chosen by a hash of the id).

The k-th largest sum is found exactly by four rounds of counting 16 bits of it, so no task sorts
or holds the rows that are kept.

Cases: words are lower-cased (A to Z) and split at ASCII white space; null and empty texts weigh 0
and rows without labels are raw texts only; noise depends on seed, id and text, so repeated rows get
equal sums; sums that tie with the k-th are all kept; a null id is an id of its own; an empty
table gives no rows; without any target row all weights are 0; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table
from .minhash import WordHashes

BUCKETS, SHARE, MOST_TARGETS, SEED = 1 << 16, 0.8, 20_000, "2024"
_P = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: bytes | None, hashes: WordHashes, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    a = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    pairs = (a[:-1] * _P + a[1:]) * _P
    return (np.concatenate([a, pairs ^ (pairs >> np.uint64(31))]) % np.uint64(buckets)).astype(np.int64)


def fit(docs: DataFrame, targets: DataFrame, buckets: int) -> np.ndarray:
    """Log ratio of target to raw probability for every bucket. ``docs``: doc, text as binary; ``targets``: distinct ids, few."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, good = WordHashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in slices(batches):
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(ngrams(t, hashes, buckets), minlength=buckets) if t else 0
                raw += n
                if g:
                    good += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    flagged = docs.join(F.broadcast(targets.select(F.col("doc"), F.lit(True).alias("good"))), "doc", "left").select("text", "good")
    sums = flagged.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.ones(buckets), np.ones(buckets)
    for x in sums.collect():  # one row for each bucket at most
        raw[x.bucket] += x.raw
        good[x.bucket] += x.good
    if good.sum() == buckets:
        return np.zeros(buckets)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, from 0."""
    bits = np.asarray(x, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def importance_resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS, most_targets: int = MOST_TARGETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept: the ``share`` of documents with the largest keys is kept."""
    d = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("binary").alias("text"))
    good = labels.where((labels["quality"] == 1) & (labels["toxic"] == 0)).select(labels["doc_id"].alias("doc")).where("doc is not null").distinct()
    ratio = fit(d, good.orderBy(F.md5(F.col("doc").cast("string").cast("binary")), "doc").limit(most_targets), buckets)
    kind = d.schema["doc"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            weight, key = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for i, (doc, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                weight[i] = math.fsum(ratio[ngrams(t, hashes, buckets)])
                u = ((xxhash.xxh64_intdigest(f"{seed}:{doc}:".encode() + (t or b"")) >> 12) + 0.5) / (1 << 52)  # never 0 or 1
                key[i] = weight[i] - math.log(-math.log(u))
            order = sortable(key)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(key), pa.array((order ^ np.uint64(1 << 63)).view(np.int64))], names=["doc", "log_weight", "gumbel_key", "ord"])

    scored = saved(d.mapInArrow(score, f"doc {kind}, log_weight double, gumbel_key double, ord long"))
    left = math.ceil(share * scored.count())
    if not left:
        return scored.select(F.col("doc").alias("doc_id"), "log_weight", "gumbel_key", F.lit(False).alias("kept"))
    least, part = 0, scored
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("ord", shift).bitwiseAND(F.lit(0xFFFF))
        if shift == 48:
            digit = digit.bitwiseXOR(F.lit(0x8000))  # the sign bit
        counts = sorted(part.groupBy(digit.alias("x")).count().collect(), reverse=True)  # 65,536 rows at most
        for x, n in counts:
            if n >= left:
                break
            left -= n
        least = (least << 16) | x
        part = part.where(digit == x)
    cutoff = least - (1 << 63)
    return scored.select(F.col("doc").alias("doc_id"), "log_weight", "gumbel_key", (F.col("ord") >= F.lit(cutoff)).alias("kept"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
