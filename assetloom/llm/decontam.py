"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

Windows of a document as long as a benchmark item are fingerprinted with SimHash (63 bits over the
words of the window, weighted by their counts). Fingerprints are cut into four blocks of 15 or 16
bits. Two fingerprints within ``radius`` bits of each other differ in at most ``radius // 4`` bits of
some block, so every block of an item is indexed with all values that near to it, and an equi-join on
(item size, block number, block) finds every item within the radius; what is similar enough but
farther off is lost (the README has the share). Equal fingerprints are looked up once. Each candidate
is verified by the exact weighted Jaccard similarity of the bags of five-word shingles.

A window can only reach the similarity if most of its places begin a shingle that items of its size have, whatever the order there: of a
window and an item of n shingles each, 6/7 of n at the default similarity. Windows are laid where so many are, beginning at such a place, or at the end of the text.
A window that begins elsewhere holds no more of an item than the one that begins at the next such place, so the best window of a document and an
item is among them. Moved parts, swapped halves and shifted copies are met like others, and texts without benchmark shingles cost one pass.

Cases: words are lower-cased and split at ASCII white space; items of fewer than five words are no
evidence and match nothing; a text shorter than the item is one window; null and empty texts match
nothing; rows that agree in id and text are one document; empty tables give no rows; further columns are ignored (``remove_contaminated`` returns them as they were).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Of four blocks, one differs in three bits at most up to a radius of 15.
WIDTH, RADIUS, LEAST = 5, 15, 0.75
#: Blocks of a fingerprint.
BLOCKS = 4
#: Rows of narrow columns (32 bytes) that may be broadcast; index rows, which are wider in memory.
FEW, FEW_PROBES = 1_000_000, 200_000
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE)), r"[\x20\x09-\x0D]+")


def _key(at: str) -> Column:
    return F.xxhash64(*(F.expr(f"w[{at} + {i}]") for i in range(WIDTH)))


def _places() -> Column:
    return F.expr(f"explode(CASE WHEN size(w) >= {WIDTH} THEN sequence(0, size(w) - {WIDTH}) ELSE array() END)")


def simhash(win: str) -> Column:
    """63 bits; bit b is set if most words of the window have it. Counts of 3 bits share a long, 21 bits for each."""
    hashes = f"transform({win}, x -> xxhash64(x))"
    sums = f"transform(sequence(0, 20), k -> aggregate(hs, 0L, (a, h) -> a + (shiftright(h, k) & {1 + (1 << 21) + (1 << 42)}L)))"
    bits = f"aggregate(sequence(0, 62), 0L, (a, b) -> a | CASE WHEN 2 * (shiftright(sums[b % 21], 21 * (b div 21)) & {(1 << 21) - 1}L) > size(hs) THEN shiftleft(1L, b) ELSE 0L END)"
    inner = f"transform(array({hashes}), hs -> transform(array({sums}), sums -> {bits})[0])[0]"
    return F.expr(inner.replace("sums[b % 21]", "sums[cast(b % 21 AS int)]").replace("21 * (b div 21)", "cast(21 * (b div 21) AS int)"))


def _blocks() -> Column:
    """(no, block) of every block of the column ``bits``."""
    edges = [63 * i // BLOCKS for i in range(BLOCKS + 1)]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.shiftright("bits", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("block")) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)))))


def _probes(radius: int) -> Column:
    """All values that differ from the column ``block`` in at most ``radius // BLOCKS`` bits: by counting, two fingerprints within the radius are that near in some block."""
    width = -(-63 // BLOCKS)
    return F.explode(F.transform(F.lit([m for m in range(1 << width) if m.bit_count() <= radius // BLOCKS]), lambda m: F.col("block").bitwiseXOR(m.cast("long"))))


def _bag(win: str) -> Column:
    """Shingles of a window with their occurrence numbers. Sorted, equal shingles are neighbours, so they are numbered by runs."""
    shingles = f"sort_array(transform(sequence(1, size({win}) - {WIDTH - 1}), i -> array_join(slice({win}, i, {WIDTH}), ' ')))"
    starts = "filter(transform(g, (x, i) -> CASE WHEN get(g, i - 1) IS DISTINCT FROM x THEN i END), i -> i IS NOT NULL)"
    numbered = "flatten(transform(s, (a, j) -> transform(sequence(1, coalesce(get(s, j + 1), size(g)) - a), k -> concat(get(g, a), ' ', k))))"
    return F.expr(f"transform(array({shingles}), g -> transform(array({starts}), s -> {numbered})[0])[0]")


def _few(df: DataFrame, most: int = FEW) -> DataFrame:
    """Broadcast while proven small; else a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def contaminated(docs: DataFrame, items: DataFrame, radius: int = RADIUS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc, rev (hash of the text), item, start (word), n_words, hamming, similarity: the best window for each document and item."""
    d = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    spread = d.select("doc", F.xxhash64("text").alias("rev"), words(F.col("text")).alias("w"))
    known = items.select(items[item_col].alias("item"), words(items[item_text_col]).alias("w")).withColumn("size", F.size("w")).where(F.col("size") >= WIDTH)
    known = cut(known.withColumn("bits", simhash("w")).withColumn("bag", _bag("w")))
    marks = cut(known.select("size", "w", _places().alias("q")).select("size", _key("q").alias("key")).distinct())
    positions = spread.select("doc", "rev", "w", _places().alias("p")).select("doc", "rev", F.size("w").alias("n"), "p", _key("p").alias("key"))
    met = positions.join(_few(marks), "key").groupBy("doc", "rev", "n", "size").agg(F.sort_array(F.collect_set("p")).alias("at"))
    length = F.least("size", "n")
    needed = F.greatest(F.lit(1), F.ceil(F.lit(least / (1 + least)) * (length + F.col("size") - 2 * (WIDTH - 1)) - F.lit(1e-9)))
    met = met.withColumns({"len": length, "last": F.col("n") - length, "needed": needed.cast("int")})
    begins = f"filter(at, (p, i) -> p <= last and get(at, i + needed - 1) <= p + len - {WIDTH})"
    ending = "if(size(filter(at, p -> p >= last)) >= needed, array(last), array())"
    laid = cut(met.select("doc", "rev", "size", F.explode(F.expr(f"array_union({begins}, {ending})")).alias("start"), "len"))
    by_doc = laid.groupBy(F.col("doc").alias("of"), F.col("rev").alias("of_rev")).agg(F.collect_set(F.struct("size", "start", "len")).alias("laid"))
    again = d.withColumn("rev", F.xxhash64("text")).join(_few(by_doc), F.col("doc").eqNullSafe(F.col("of")) & (F.col("rev") == F.col("of_rev")))
    windows = again.select("doc", "rev", words(F.col("text")).alias("w"), "laid").select("doc", "rev", "w", F.explode("laid").alias("x"))
    windows = windows.select("doc", "rev", F.col("x.size").alias("size"), F.col("x.start").alias("start"), F.slice("w", F.col("x.start") + 1, F.col("x.len")).alias("win")).distinct()
    windows = cut(windows.withColumn("bits", simhash("win")))
    prints = windows.select("size", "bits").distinct().select("size", "bits", _blocks().alias("b")).select("size", "bits", "b.no", "b.block")
    index = known.select("item", "size", "bits", _blocks().alias("b")).select("item", "size", F.col("bits").alias("item_bits"), "b.no", "b.block")
    index = index.select("item", "size", "item_bits", "no", _probes(radius).alias("block"))
    near = prints.join(_few(index, FEW_PROBES), ["size", "no", "block"]).withColumn("hamming", F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))))
    near = cut(near.where(F.col("hamming") <= radius).select("size", "bits", "item", "hamming").distinct())
    found = windows.join(_few(near), ["size", "bits"]).join(known.select("item", "bag"), "item")
    found = found.withColumn("own", _bag("win")).withColumn("both", F.size(F.array_intersect("own", "bag")))
    found = found.select("doc", "rev", "item", "start", F.size("win").alias("n_words"), "hamming", (F.col("both") / (F.size("own") + F.size("bag") - F.col("both"))).alias("similarity"))
    best = found.where(F.col("similarity") >= least).groupBy("doc", "rev", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "hamming")).alias("x"))
    return best.select("doc", "rev", "item", "x.start", "x.n_words", "x.hamming", (-F.col("x.s")).alias("similarity"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` without those that hold a benchmark item."""
    bad = cut(contaminated(docs, items, id_col=id_col, text_col=text_col, **params).select(F.col("doc").alias("bad_doc"), F.col("rev").alias("bad_rev")).distinct())
    return docs.join(_few(bad), docs[id_col].eqNullSafe(F.col("bad_doc")) & (F.xxhash64(docs[text_col]) == F.col("bad_rev")), "left_anti")


def op3_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "similarity")


_SQL_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SQL_BAG = "list_transform({g}, lambda x, i: x || ' ' || len(list_filter({g}[:i], lambda y: y = x)))"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
k AS (SELECT item_id, w, len(w) AS size, list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) AS g FROM i WHERE len(w) >= 5),
m AS (SELECT DISTINCT size, unnest(g) AS x FROM k),
e AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS x, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
h AS (SELECT DISTINCT doc_id, size, least(p, n - least(size, n)) AS start, least(size, n) AS l FROM e JOIN m USING (x)),
c AS (SELECT h.doc_id, k.item_id, start, l, k.g AS b, list_transform(range(start + 1, start + l - 3), lambda p: array_to_string(d.w[p:p + 4], ' ')) AS a
      FROM h JOIN d USING (doc_id) JOIN k USING (size)),
s AS (SELECT doc_id, item_id, start, l, len(list_intersect({_SQL_BAG.format(g="a")}, {_SQL_BAG.format(g="b")})) AS shared, len(a) AS na, len(b) AS nb FROM c),
t AS (SELECT doc_id, item_id, start, l, shared / (na + nb - shared) AS similarity FROM s)
SELECT doc_id, item_id, start::INTEGER AS start, l::INTEGER AS n_words, similarity FROM t WHERE similarity >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
