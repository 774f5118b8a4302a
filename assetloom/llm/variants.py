"""Spelling variants by a relational trie frontier.

Words that differ in one code point are found in a trie that is a table: an edge is a row (node, label, child), where nodes are prefixes at
which words end or part, so that a label may have several characters. The trie of the reversed words is a second part of
the same table. A pair of words has an edit after the first half of one of them, read from the front or from the back, and is looked for in that direction.

A state is (word, position, node, edits). A word's states without edits are the nodes on its own path, which are known when the trie has been
built. The frontier is joined with the edges of its nodes. A state without edits takes an edge of another first character, which
replaces or inserts it (deletions are the other word's insertions); a state with an edit takes the edge that its word goes on with. A state that has used up its word at a
node where a word ends makes the two neighbours. So a pair is found where the words first differ, once in each direction.

An edge also says, in twice 64 bits, what the words behind it may end with; a state that can't end is not written. A node has no more edges
than there are characters, so a node that very many words pass is a join key with few rows on that
side, which Spark may split; words are never paired within a group. The walk takes as many rounds as the second half of a word has nodes, and its frontier soon shrinks.
Nodes are numbered by a hash of their prefix; should two words that end there share a number the trie is built anew with another
base, and all pairs are compared in the end, so that hashes neither lose nor add a pair.

Cases: a null text has no words; a null id counts as an empty one; repeated rows are counted like others; empty texts
and tables give no rows; words of any length have as many nodes as other words part from them; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.plans.frontier import FEW

from .common import SQL_CRC, Scratch, saved, slices, sql_crc32, table

#: Code points of a word, occurrences, and how many times as frequent a form is.
LETTERS = "[a-zÀ-ÿ]"
LEAST, TWICE, TIMES = 7, 2, 10
#: A run loses a code point if this divides its checksum.
EVERY = 31
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
_run = re.compile(f"{LETTERS}{{{LEAST},}}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts; a word may come several times."""
    held: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in slices(batches):
        for key, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            start = crc32(f"{'' if key is None else key}:".encode())
            for w, n in Counter(_run.findall((t or b"").lower().decode("utf-8", "surrogatepass"))).items():
                h = crc32(w.encode(), start)
                if not h % EVERY:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                if len(w) >= LEAST:
                    held[w] += n
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of enough letters that occur twice or more."""
    counted = docs.select(docs[id_col].cast("string").alias("doc"), docs[text_col].alias("text")).mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def _prefixes(base: int):
    """(id, back, k, node, next) of the prefixes from the middle of a word on, read from either end; ``next`` is -1 where the word ends."""
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            ids, backs, ks, nodes, following = [], [], [], [], []
            for i, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for back in (False, True):
                    codes = [ord(c) for c in (word[::-1] if back else word)]
                    first, h = len(codes) // 2 - 1, 2 + back
                    for k, c in enumerate([*codes, -1]):
                        if k >= first:
                            mixed = (h ^ h >> 31) * 0x9E3779B97F4A7C15 & mask
                            ids.append(i)
                            backs.append(back)
                            ks.append(k)
                            nodes.append((mixed ^ mixed >> 29) - (1 << 63))
                            following.append(c)
                        h = (h * base + c + 1) & mask
                if len(ids) > 1 << 16:
                    yield _batch(ids, backs, ks, nodes, following)
                    ids, backs, ks, nodes, following = [], [], [], [], []
            yield _batch(ids, backs, ks, nodes, following)

    return run


def _batch(ids, backs, ks, nodes, following) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(backs, pa.bool_()), pa.array(ks, pa.int32()), pa.array(nodes, pa.int64()), pa.array(following, pa.int32())], names=["id", "back", "k", "node", "next"])


def _ending(s: str, k: str, second: bool = False) -> str:
    """SQL for one of two bits of what is left of a text after k characters: of its first 24 and its length."""
    h = f"xxhash64(substring({s}, {k} + 1, 24))"
    return f"shiftleft(1L, cast(pmod({f'shiftrightunsigned({h}, 24)' if second else h} + length({s}) - {k}, 64) as int))"


#: The word of a row, read in its direction.
_READ = "if(back, reverse(word), word)"


def _trie(words: DataFrame, scratch: Scratch, base: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Paths (word, n, back, ks: places and nodes) and edges (at, first, tail, len, child, ends, ends2, t_word, t_n) of the words (id, word, n) from both ends."""
    for seed in count() if base is None else (base, 0):
        found = scratch.saved(words.select("id", "word").mapInArrow(_prefixes(0x9E3779B97F4A7C15 + 2 * seed if base is None or not seed else seed), "id long, back boolean, k int, node long, next int"))
        ends = F.when(F.col("next") == -1, F.col("id"))
        nodes = found.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("z"), F.min(ends).alias("one"), F.max(ends).alias("two"))
        nodes = scratch.saved(nodes.where("a = -1 or a != z").select(F.col("node").alias("at"), (F.col("one") != F.col("two")).alias("clash")))
        if nodes.where("clash").isEmpty():
            break
    path = found.join(nodes, found["node"] == nodes["at"], "left_semi").groupBy("id", "back").agg(F.array_sort(F.collect_list(F.struct("k", "node"))).alias("ks"))
    paths = scratch.saved(path.join(words, "id").select("word", "n", "back", "ks"))
    steps = paths.select("word", "n", "back", F.expr(_READ).alias("s"), F.explode(F.expr("transform(slice(ks, 1, size(ks) - 1), (x, i) -> struct(x.node as node, x.k as k, ks[i + 1].node as child, ks[i + 1].k as to))")).alias("x"))
    last = F.col("x.to") == F.length("s")
    steps = steps.select("x.node", F.expr("substring(s, x.k + 1, x.to - x.k)").alias("label"), "x.child", F.expr(_ending("s", "x.to")).alias("ending"), F.expr(_ending("s", "x.to", True)).alias("ending2"), F.when(last, F.col("word")).alias("t_word"), F.when(last, F.col("n")).alias("t_n"))
    edges = steps.groupBy("node", "label", "child").agg(F.expr("bit_or(ending)").alias("ends"), F.expr("bit_or(ending2)").alias("ends2"), F.max("t_n").alias("t_n"), F.max("t_word").alias("t_word"))
    return paths, scratch.saved(edges.selectExpr("node as at", "substring(label, 1, 1) as first", "substring(label, 2) as tail", "length(label) as len", "child", "ends", "ends2", "t_word", "t_n"))


def neighbours(words: DataFrame, scratch: Scratch, base: int | None = None) -> DataFrame:
    """(word, near, near_n): words one inserted, deleted or replaced code point apart, in both orders. words: id, word, n."""
    paths, edges = _trie(words, scratch, base)
    seeds = paths.select(F.expr(_READ).alias("s"), "n", "back", F.explode(F.expr("filter(ks, x -> x.k >= length(word) div 2)")).alias("x"))
    seeds = seeds.selectExpr("s", "n", "back", "x.k as pos", "x.node as node", "substring(s, x.k + 1, 1) as now", "0 as edits")
    replaced, inserted = "struct(pos + len as pos, false as inserted)", "struct(pos + len - 1 as pos, true as inserted)"
    met = seeds.join(edges, (F.col("node") == F.col("at")) & (F.col("now") != F.col("first")))
    met = met.selectExpr("s", "n", "back", "pos", "len", "child", "ends", "ends2", "t_word", "t_n", "pos < length(s) and substring(s, pos + 2, len - 1) = tail as r", "substring(s, pos + 1, len - 1) = tail as i").where("r or i")
    met = met.select("s", "n", "back", "child", "ends", "ends2", "t_word", "t_n", F.explode(F.expr(f"if(r and i, array({replaced}, {inserted}), array(if(r, {replaced}, {inserted})))")).alias("to"))
    step, found = _step(met.selectExpr("s", "n", "back", "child", "ends", "ends2", "t_word", "t_n", "to.*"), scratch), []
    while True:
        found.append(step.where("done"))
        frontier = step.where("not done").selectExpr("s", "n", "back", "pos", "node", "inserted", "substring(s, pos + 1, 1) as now")
        size = frontier.count()
        if not size:
            break
        side = F.broadcast(frontier) if size <= FEW else frontier
        met = side.join(edges, (F.col("node") == F.col("at")) & (F.col("now") == F.col("first"))).where("substring(s, pos + 2, len - 1) = tail")
        step = _step(met.selectExpr("s", "n", "back", "child", "ends", "ends2", "t_word", "t_n", "pos + len as pos", "inserted"), scratch)
    pairs = reduce(DataFrame.unionByName, found).selectExpr("if(back, reverse(s), s) as word", "n", "inserted", "near", "near_n").where("levenshtein(word, near, 1) = 1")
    both = F.when(F.col("inserted"), F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).otherwise(F.array(F.struct("word", "near", "near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*").repartition("word").distinct()


def _step(met: DataFrame, scratch: Scratch) -> DataFrame:
    """The states with one edit that a round has led to, without those that can't end; ``done`` where word and path both end."""
    done = "pos = length(s)"
    met = met.where(f"if({done}, t_word is not null, (ends & {_ending('s', 'pos')}) != 0 and (ends2 & {_ending('s', 'pos', True)}) != 0)")
    return scratch.saved(met.selectExpr("s", "n", "back", "pos", "child as node", "inserted", "1 as edits", f"{done} as done", f"if({done}, t_word, null) as near", f"if({done}, t_n, null) as near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead to in the end. A form is more frequent than its word, so there are no cycles; every round doubles the way."""
    f = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not f.where("open").isEmpty():
        up = f.select(F.col("word").alias("w"), F.col("root").alias("far"))
        f = saved(f.join(up, F.col("root") == F.col("w"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("open")))
    return f.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.saved(vocabulary(docs, id_col, text_col).withColumn("id", F.monotonically_increasing_id()), keep=True)  # written, so that the numbers stay
    near = neighbours(words, scratch, base).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.select("word", "n").join(near, "word", "left")
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    known = scratch.saved(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), keep=True)
    last = roots(known.where("form is not null"))
    scratch.clear()
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE {SQL_CRC},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {sql_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM d, crc),
m AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
g AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * n THEN best.near END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM v LEFT JOIN g USING (word)),
up AS (SELECT word, word AS root FROM f UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
last AS (SELECT up.word, root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""
