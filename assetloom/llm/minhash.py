"""Near-duplicate documents by min-max hashing.

A document is the set of its five-word shingles. Under each of ``PERMUTATIONS`` hash functions both
the smallest and the largest value of the set are kept: twice the signature values from one pass of
hash evaluations. Bands of ``ROWS`` values make documents candidates (a pair at the threshold
is missed with a chance under 1e-5). Sets that are equal are one class from the start.

Candidates are confirmed on full sets, but a bucket is not expanded into all its pairs:

1. every class of a bucket is compared with the bucket's smallest one, and components are formed;
2. buckets that hold classes of several components are opened again. In small buckets the pairs of
   classes in different components are compared. The classes of large buckets are joined on the
   rarest shingles of each class, as many as two sets of the needed overlap must share one of (prefix
   filtering), so common lines and passages open no pairs; this is exact for all their pairs.

A pair is dropped before its texts are read only if its sizes or bitmaps of its shingles (every bit that
differs is a shingle that differs) prove that the threshold is out of reach.

The pairs of one class are dealt in blocks of about ``BLOCK``. A block gets the class's bitmap and text once, whatever
the number of its partners, and goes to a task of its own, so a class with very many partners is neither copied
for each of them nor gathered in one task.

Cases: a null or empty text has no shingles and is linked with nothing; with one to four words the
whole sequence is one shingle; rows with equal text and id are rows of one document; a row without
id is linked with nothing and kept; if an id comes with several texts, each row is linked by its own
text, but classes of texts with the same smallest id count as linked, since components carry ids; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.plans.components import components

from .common import Scratch, cut, slices, table

WIDTH, PERMUTATIONS, ROWS = 5, 64, 4
#: Percent of the union that must be shared.
LEAST = 75
#: Buckets with more classes than this are joined on rare shingles.
SMALL_BUCKET = 12
#: Ids that may be broadcast: 8 bytes each.
FEW_IDS = 2_000_000
#: Partners of a class that share one copy of its text.
BLOCK = 256
SLOTS, LONGS = 1 << 14, 32

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words (bytes); forgets them when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a text in UTF-8. Bytes are split at ASCII white space and lower-case A to Z only."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    a = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    k = min(width, len(a))
    s = np.full(len(a) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * _P + a[i : len(a) - k + 1 + i]
    return np.unique(_mix(s))


class MinMax:
    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = 11):
        if 2 * permutations % rows:
            raise ValueError("bands must come out even")
        rng = np.random.default_rng(seed)
        self.times = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.rows = rows

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Smallest and largest value under each permutation, side by side."""
        low = high = None
        for i in range(0, len(s), 4096):
            x = self.times[:, None] * s[None, i : i + 4096] + self.plus[:, None]
            a, z = x.min(1), x.max(1)
            low, high = (a, z) if low is None else (np.minimum(low, a), np.maximum(high, z))
        return np.stack([low, high], 1).reshape(-1)

    def bands(self, s: np.ndarray) -> np.ndarray:
        v = self.signature(s).reshape(-1, self.rows)
        key = np.arange(len(v), dtype=np.uint64)
        for j in range(self.rows):
            key = key * _P + v[:, j]
        return _mix(key)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """64 * LONGS bits, set where a shingle falls."""
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(64 * LONGS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b) and (100 + least) * both >= least * (len(a) + len(b)))


_SIGNED = "doc long, rev long, n long, s1 long, s2 long, bands array<long>, bits array<long>"


def _sign(permutations: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minmax, slots = WordHashes(), MinMax(permutations, rows), np.zeros(SLOTS, np.int64)
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        names = ["doc", "rev", "n", "s1", "s2", "bands", "bits"]
        for b in slices(batches):
            out = []
            for d, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(t, hashes, width)
                if not len(s):
                    out.append((d, r, 0, 0, 0, None, None))
                    continue
                slots += np.bincount((s & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
                x = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
                out.append((d, r, len(s), int(x[0]), int(x[1]), minmax.bands(s).view(np.int64), _bitmap(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if slots.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, -1, 0, 0, slots, None), kinds, strict=True)], names=names)

    return run


def _confirm(least: int, width: int):
    """Rows of a block follow each other: the class's own texts (without ``b``), then those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block, own = WordHashes(), None, []
        for batch in slices(batches):
            out = []
            for a, part, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, part) != block:
                    block, own = (a, part), []
                s = shingles(t, hashes, width)
                if b is None:
                    own.append(s)
                elif any(linked(x, s, least) for x in own):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _prefixes(least: int, width: int, slots: np.ndarray):
    """The rarest shingles of each class; rarity by the corpus-wide count of the shingle's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            keys, counts = [np.zeros(0, np.int64)], []
            for t in b.column(3).to_pylist():
                s = shingles(t, hashes, width)
                n = len(s)
                first = s[np.lexsort((s, slots[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))][: n - -(-least * n // 100) + 1]
                counts.append(len(first))
                keys.append(first.view(np.int64))
            at = pa.array(np.repeat(np.arange(b.num_rows), counts))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(np.concatenate(keys))], names=["doc", "n", "label", "key"])

    return run


def _semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``df`` where ``on`` is among the distinct ``ids``; they are broadcast only while they are few."""
    return df.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, on, "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, width: int = WIDTH, permutations: int = PERMUTATIONS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET, revisions: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept, for every row of ``docs``; with ``revisions`` also rev, the xxhash64 of the text."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(docs[id_col].cast("long").alias("doc"), F.xxhash64(docs[text_col]).alias("rev"), docs[text_col].cast("binary").alias("text"))
    signed = scratch.saved(d.mapInArrow(_sign(permutations, rows, width), _SIGNED), keep=True)
    slots = np.zeros(SLOTS, np.int64)
    for x in signed.where("n = -1").select(F.posexplode("bands")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # SLOTS rows at most
        slots[x.pos] = x.n
    rows_ = signed.where("n >= 0")
    of_class = rows_.where("n > 0 and doc is not null").groupBy("n", "s1", "s2")
    classes = of_class.agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = scratch.saved(classes.select("doc", "n", "s1", "s2", "bands", "bits"), keep=True)
    banded = classes.select("doc", "n", F.explode("bands").alias("key"))
    shared = scratch.saved(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("first")).where("size > 1"))
    buckets = scratch.saved(banded.join(shared, "key").select("key", "doc", "n", "size", "first"))
    members = buckets.select("doc").distinct()
    texts = scratch.saved(_semi(d.select("doc", "text"), cut(members), "doc").distinct())
    sketch = scratch.saved(classes.select("doc", "n", "bits").join(members, "doc", "left_semi"))

    def wide(name: str) -> list[Column]:
        """The bitmap as columns without nulls: arrays would make the code of ``apart`` too long to be compiled."""
        return [F.coalesce(F.col("bits")[i], F.lit(0)).alias(f"{name}{i}") for i in range(LONGS)]

    def apart(x: str, y: str, n: str, m: str) -> Column:
        """Whether sizes and bitmaps leave two classes a chance."""
        bits = sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(LONGS)), F.lit(0))
        return (F.lit(100) * F.least(n, m) >= F.lit(least) * F.greatest(n, m)) & (F.lit(100 + least) * bits <= F.lit(100 - least) * (F.col(n) + F.col(m)))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among (a, b, size) pairs of classes from groups of ``size`` classes."""
        blocks = F.ceil(F.col("size") / BLOCK).cast("long")
        dealt = pairs.groupBy("a", "b").agg(F.max("size").alias("size")).select("a", (blocks * F.lit(1 << 31) + F.pmod(F.xxhash64("b"), blocks)).alias("part"), "b")
        dealt = scratch.saved(dealt)
        own = scratch.saved(dealt.select("a", "part").distinct().join(sketch.select(F.col("doc").alias("a"), "n", "bits"), "a"))
        theirs = dealt.join(sketch.select(F.col("doc").alias("b"), F.col("n").alias("m"), *wide("y")), "b")
        near = theirs.join(own.select("a", "part", "n", *wide("x")), ["a", "part"]).where(apart("x", "y", "n", "m"))
        near = scratch.saved(near.select("a", "part", "b").distinct())
        theirs = near.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", "text")
        ours = near.select("a", "part").distinct().join(texts.withColumnRenamed("doc", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        dealt_out = ours.union(theirs).repartition("a", "part").sortWithinPartitions("a", "part", "b")  # nulls come first
        return cut(dealt_out.mapInArrow(_confirm(least, width), "a long, b long"))

    def labelled(frame: DataFrame, links: DataFrame) -> DataFrame:
        label = cut(components(links)).select(F.col("node").alias("doc"), F.col("component").alias("c"))
        return frame.join(label, "doc", "left").withColumn("label", F.coalesce("c", "doc")).drop("c")

    def opened(groups: DataFrame) -> DataFrame:
        """Groups whose classes are in several components, with the component of most of their classes."""
        counts = groups.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key")
        open_ = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("size"), F.max_by("label", F.struct("k", "label")).alias("most")).where("kinds > 1").select("key", "size", "most")
        return scratch.saved(groups.drop("size").join(scratch.saved(open_), "key"))

    def across(groups: DataFrame) -> DataFrame:
        """Pairs of a group's classes that are in different components and that sizes and bitmaps don't rule out. Classes of the commonest component aren't paired with each other."""
        g = scratch.saved(groups.select("key", "doc", "n", "label", "size", "most").join(sketch.select("doc", "bits"), "doc"))
        x = g.where("label <> most").select("key", F.col("doc").alias("a"), F.col("n").alias("n1"), F.col("label").alias("l1"), *wide("x"))
        y = g.select("key", F.col("doc").alias("b"), F.col("n").alias("n2"), F.col("label").alias("l2"), "most", "size", *wide("y"))
        once = (F.col("l1") != F.col("l2")) & ((F.col("a") < F.col("b")) | (F.col("l2") == F.col("most")))
        return x.join(y, "key").where(once & apart("x", "y", "n1", "n2")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "size")

    links = confirmed(buckets.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b"), "size"))
    again = opened(labelled(buckets.select("key", "doc", "n", "size"), links))
    large = cut(again.where(F.col("size") > small_bucket).select("doc", "n", "label").distinct())
    keyed = scratch.saved(texts.join(large, "doc").select("doc", "n", "label", "text").mapInArrow(_prefixes(least, width, slots), "doc long, n long, label long, key long").distinct())
    of_key = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc", "label")).alias("first"), F.min("label").alias("x"), F.max("label").alias("z"))
    keyed = scratch.saved(keyed.join(scratch.saved(of_key.where("x <> z").select("key", "size", "first")), "key"))
    star = keyed.where("label <> first.label").select(F.col("first.doc").alias("a"), F.col("doc").alias("b"), "size")
    links = cut(links.union(confirmed(star)))
    still = opened(labelled(keyed.select("key", "doc", "n"), links))
    small = again.where(F.col("size") <= small_bucket)
    pairs = across(small).union(across(still))
    links = cut(links.union(confirmed(pairs)))
    found = cut(components(links)).select(F.col("node").alias("doc"), "component")
    scratch.clear()
    named = classes.select("n", "s1", "s2", "doc").join(found, "doc", "left").select("n", "s1", "s2", F.coalesce("component", "doc").alias("component"))
    narrow = rows_.select("doc", "rev", "n", "s1", "s2")
    alone = narrow.where("n = 0 or doc is null").select("doc", "rev", "n", F.col("doc").alias("component"))
    out = alone.union(narrow.where("n > 0 and doc is not null").join(named, ["n", "s1", "s2"]).select("doc", "rev", "n", "component"))
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"), "rev")
    return out if revisions else out.drop("rev")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept. Rows go by id and text, so that another text of a rejected row's id stays if it is kept; repeated rows of a kept document all stay."""
    found = near_duplicates(docs, id_col, text_col, revisions=True, **params)
    gone = Scratch(docs.sparkSession).saved(found.where("not kept").select(F.col("doc_id").alias("g_doc"), F.col("rev").alias("g_rev")).distinct(), keep=True)
    return docs.join(gone, (docs[id_col].cast("long") == F.col("g_doc")) & (F.xxhash64(docs[text_col]) == F.col("g_rev")), "left_anti")


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
         ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (
  WITH RECURSIVE t(a, b) AS (SELECT a, b FROM p UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a)
  SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, r.b) AS component_id, s.doc_id = least(s.doc_id, r.b) AS kept
FROM s LEFT JOIN r ON s.doc_id = r.a
"""
