"""Line dedup: passages that stand elsewhere before go, all but their first place.

Texts are cut into chunks by their content: a rolling hash over the hashes of ``WINDOW`` lines is kept at
every line, and a line whose rolling hash is a local minimum opens a chunk (two lines at least, but for the first and
last chunk of a text). Chunks that stand elsewhere before go first (``dedup_lines`` does this alone). A shared run that begins and ends within chunks keeps its ends,
and one that holds no whole chunk stays.

``dedup_passages`` therefore goes on from the chunks that went: windows are laid at every unit that isn't in one of them, and those that recur
extend what goes to both ends of each shared run, and find the runs without a whole chunk. Its units are the lines with words; a line
of more than ``LONG`` words is divided into pieces, where the hash of what follows a word's beginning is
the least among its neighbours, so that a passage within such lines is divided the same way wherever it
stands. Any two neighbouring units are a window, and so is an undivided line of ``ALONE`` words or more. As windows
begin at every unit, the windows that recur cover every shared run of whole lines from end to end. A run that
begins or ends within a long line is covered but for the pieces at its ends. Lines may also be left undivided
(``divide``): what they share in part is then left to a later search for near copies. No first place of a window lies in a chunk that
went: the chunk's own first place is before it.

Chunks and windows that occur elsewhere by hash are fetched and compared byte by byte; of equal ones the
first, by document and position, stays and the others are removed. What is removed stands
unchanged at an earlier place, so the first place of every unit is never lost.

Only hashes are shuffled for all chunks and windows. Texts are joined by document: to fetch the chunks
whose hash repeats, to leave out what went, to fetch the windows, and to remove lines. Counts per window are combined before they are shuffled, so
a passage that a third of all documents share is no hot spot; what they are joined with has one row a
key and is written first, so that adaptive execution can split the joins.

Cases: a null text stays null and an empty one empty; rows that agree in id and text are
one document, whose windows don't count as repeats of each other, and are all treated alike; null ids
sort last; blank lines go with the lines around them but are no unit; an empty table
gives no rows; further columns are carried along (``keep_cols``) and never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, slices, table

_word = re.compile(WORD)
WINDOW, LONGEST = 2, 32
#: Words of a line that is divided if it has more; words of a line that is a window alone; words to either side of a division.
LONG, ALONE, NEAR = 64, 10, 8
#: Bytes of fetched windows in a batch.
MOST = 16 << 20
#: Where a text's windows begin and end, in bytes.
Spans = Callable[[bytes], tuple[list[int], list[int]]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def chunk_bounds(lines: list[str] | list[bytes], window: int = WINDOW, longest: int = LONGEST) -> list[int]:
    """Where chunks begin, and the number of lines at the end. No chunk is longer than ``longest`` lines."""
    n = len(lines)
    if n == 0:
        return [0]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, n)
    rolling = np.zeros(n, np.uint64)
    for k in range(min(window, n)):
        rolling[k:] = rolling[k:] * np.uint64(0x9E3779B97F4A7C15) + hashes[: n - k] * np.uint64(2 * k + 1)
    rolling = _mix(rolling)
    opens = np.zeros(n, bool)
    opens[0] = True
    if n > 2:
        opens[1:-1] = (rolling[1:-1] < rolling[:-2]) & (rolling[1:-1] <= rolling[2:])
    opens[1:2] = False
    starts = [int(x) for x in np.flatnonzero(opens)] + [n]
    return [x for a, b in zip(starts, starts[1:], strict=False) for x in range(a, b, longest)] + [n]


def chunks_of(text: str) -> list[tuple[int, int, int]]:
    """(first line, line after the last, hash) of the chunks that may be removed."""
    lines = text.split("\n")
    bounds = chunk_bounds(lines)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1 and sum(_word.search(x) is not None for x in lines[a:b]) > 1:
            out.append((a, b, xxhash.xxh64_intdigest("\n".join(lines[a:b]).encode("utf-8", "surrogatepass")) - (1 << 63)))
    return out


def _divided(line: bytes) -> list[int]:
    """Where the pieces of a line begin. Pieces have more than ``NEAR`` words."""
    raw = np.frombuffer(line + bytes(16), np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    at = np.flatnonzero(space[:-17] > space[1:-16]) + 1
    if len(at) <= 2 * NEAR:
        return [0]
    ahead = np.ndarray((len(line) + 8,), "<u8", raw.data, strides=(1,))
    h = _mix(ahead[at] * np.uint64(0x9E3779B97F4A7C15) ^ ahead[at + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
    least, k = h, 1
    while k < NEAR:
        step = min(k, NEAR - k)
        least, k = np.minimum(least[:-step], least[step:]), k + step
    here = h[NEAR:-NEAR]
    opens = (here < least[: len(here)]) & (here <= least[NEAR + 1 :])
    return [0, *at[NEAR:-NEAR][opens].tolist()]


def windows_of(text: bytes, divide: bool = True) -> tuple[list[int], list[int]]:
    """The windows of ``dedup_passages``."""
    begins: list[int] = []
    ends: list[int] = []
    alone, alone_ends, at = [], [], 0
    for line in text.split(b"\n"):
        end = at + len(line)
        if n := len(line.split()):
            more = _divided(line) if divide and n > LONG else [0]
            if len(more) > 1:
                more = [at + x for x in more]
                begins += more
                ends += more[1:]
            else:
                if n >= ALONE:
                    alone.append(at)
                    alone_ends.append(end)
                begins.append(at)
            ends.append(end)
        at = end + 1
    return alone + begins[:-1], alone_ends + ends[1:]


def _chunk_spans(text: bytes) -> tuple[list[int], list[int]]:
    """The chunks of ``dedup_lines`` that may be removed."""
    found = chunks_of(text.decode("utf-8", "surrogatepass"))
    at = np.cumsum([0, *(len(x) + 1 for x in text.split(b"\n"))]).tolist()
    return [at[a] for a, _, _ in found], [at[z] - 1 for _, z, _ in found]


def passage_chunks(text: bytes) -> tuple[list[int], list[int]]:
    """The chunks of ``dedup_passages``: those with two lines with words, from the first to the last of these."""
    lines = text.split(b"\n")
    begins: list[int] = []
    ends: list[int] = []
    if len(lines) < 2:
        return begins, ends
    at, k = 0, 0
    for z in chunk_bounds(lines)[1:]:
        held = []
        for line in lines[k:z]:
            if line.strip():
                held.append((at, at + len(line)))
            at += len(line) + 1
        if len(held) > 1:
            begins.append(held[0][0])
            ends.append(held[-1][1])
        k = z
    return begins, ends


def outside(begins: list[int], ends: list[int], gone: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The windows that don't lie in one of ``gone``, which don't overlap."""
    gone = sorted(gone)
    starts = [a for a, _ in gone]
    left = [(a, z) for a, z in zip(begins, ends, strict=True) if not (k := bisect_right(starts, a)) or z > gone[k - 1][1]]
    return [a for a, _ in left], [z for _, z in left]


def _hashes(spans: Spans) -> Callable:
    """Of (uid, text), or of (uid, text, gone): without the spans that lie in ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in slices(batches):
            counts, begins, ends, h = [], [], [], []
            gone = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for t, g in zip(b.column(1).cast(pa.binary()).to_pylist(), gone, strict=True):
                x, y = spans(t or b"")
                if g:
                    x, y = outside(x, y, _bounds(g))
                counts.append(len(x))
                begins += x
                ends += y
                h += [digest(t[a:z]) for a, z in zip(x, y, strict=True)]
            uid = np.repeat(b.column(0).to_numpy(zero_copy_only=False), counts)
            place = (np.array(begins, np.int64) << 32) | np.array(ends, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(place, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64))], names=["uid", "place", "h"])

    return run


def _bounds(places: list[int]) -> list[tuple[int, int]]:
    return [(p >> 32, p & 0xFFFFFFFF) for p in places]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        row, place, chunk, size = [], [], [], 0

        def full() -> pa.RecordBatch:
            at = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(place, pa.int64()), pa.array(chunk, pa.binary())], names=["doc", "rev", "place", "chunk"])  # noqa: B023

        for i, (t, places) in enumerate(zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True)):
            found = [t[a:z] for a, z in _bounds(places)]
            row += [i] * len(found)
            place += places
            chunk += found
            size += sum(map(len, found))
            if size > MOST:
                yield full()
                row, place, chunk, size = [], [], [], 0
        yield full()


def _drop(text: bytes, places: list[int]) -> tuple[str, int]:
    """The text without those windows, and the number of lines that lost something."""
    merged: list[list[int]] = []
    for a, z in _bounds(sorted(places)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    kept, lost, at, k = [], 0, 0, 0
    for line in text.split(b"\n"):
        end = at + len(line)
        while k < len(merged) and merged[k][1] < at:
            k += 1
        j, left, here = k, [], at
        while j < len(merged) and merged[j][0] <= end:
            left.append(text[here : max(here, merged[j][0])])
            here = min(merged[j][1], end)
            j += 1
        if j == k:
            kept.append(line)
        else:
            lost += 1
            rest = b"".join(left) + text[here:end]
            if rest.strip():
                kept.append(rest if here < end else rest.rstrip())
        at = end + 1
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), lost


def _repeats(scratch: Scratch, d: DataFrame, spans: Spans) -> DataFrame:
    """(doc, rev, gone): the spans of each document that stand elsewhere before. d: doc, rev, uid, text, and ``gone`` if spans in it are left out."""
    kind = d.schema["doc"].dataType.simpleString()
    found = scratch.saved(d.select("uid", "text", *(c for c in d.columns if c == "gone")).mapInArrow(_hashes(spans), "uid long, place long, h long"))
    one = F.xxhash64("uid", "place")
    repeated = scratch.saved(found.groupBy("h").agg(F.min(one).alias("a"), F.max(one).alias("z")).where("a != z").select("h"))
    wanted = found.join(repeated, "h", "left_semi").groupBy("uid").agg(F.collect_set("place").alias("places"))
    fetched = scratch.saved(d.select("doc", "rev", "uid", "text").join(wanted, "uid").select("doc", "rev", "text", "places").mapInArrow(_fetch, f"doc {kind}, rev long, place long, chunk binary"))
    at = F.struct(F.col("doc").isNull().alias("none"), "doc", "rev", "place")
    kept = scratch.saved(fetched.groupBy("chunk").agg(F.min(at).alias("a"), F.max(at).alias("z")).where("a != z").select(F.col("chunk").alias("k_chunk"), "a"))
    gone = fetched.join(kept, F.col("chunk") == F.col("k_chunk")).where(at != F.col("a"))
    return gone.groupBy("doc", "rev").agg(F.collect_set("place").alias("gone"))


def _dedup(docs: DataFrame, steps: list[Spans], id_col: str, text_col: str, keep_cols: tuple[str, ...]) -> DataFrame:
    """Repeated spans go, step by step: those of a step are sought outside of what went before."""
    d = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), *(docs[c].alias(f"keep_{i}") for i, c in enumerate(keep_cols)))
    d = d.withColumn("rev", F.xxhash64("text")).withColumn("uid", F.xxhash64("doc", "rev"))
    kind = d.schema["doc"].dataType.simpleString()
    gone = None
    for spans in steps:
        scratch, plain = Scratch(docs.sparkSession), d.select("doc", "rev", "uid", "text")
        new = _repeats(scratch, plain if gone is None else plain.join(gone.select("uid", "gone"), "uid", "left"), spans).withColumn("uid", F.xxhash64("doc", "rev"))
        if gone is not None:
            new = new.unionByName(gone).groupBy("doc", "rev", "uid").agg(F.flatten(F.collect_list("gone")).alias("gone"))
        gone = scratch.saved(new, keep=True)
        scratch.clear()
    gone = gone.select(F.col("doc").alias("w_doc"), F.col("rev").alias("w_rev"), "gone")
    ours = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("rev") == F.col("w_rev"))
    keeps = [f"keep_{i}" for i in range(len(keep_cols))]
    joined = d.join(gone, ours, "left").select("doc", "text", "gone", *keeps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, lost = b.column(1).to_pylist(), [0] * b.num_rows
            for i, g in enumerate(b.column(2).to_pylist()):
                if g:
                    texts[i], lost[i] = _drop(texts[i].encode("utf-8", "surrogatepass"), g)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(lost, pa.int64()), *b.columns[3:]], names=["doc", "text", "n_removed", *keeps])

    s = joined.schema
    out = joined.mapInArrow(run, ", ".join([f"doc {kind}", "text string", "n_removed long", *(f"{k} {s[k].dataType.simpleString()}" for k in keeps)]))
    return out.select("doc", "text", "n_removed", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep_cols)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc, text without repeated chunks, n_removed (lines), and ``keep_cols``."""
    return _dedup(docs, [_chunk_spans], id_col, text_col, keep_cols)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = (), divide: bool = True) -> DataFrame:
    """doc, text without repeated passages, n_removed (lines that went in whole or in part), and ``keep_cols``. Without ``divide``, lines stay or go as a whole."""
    return _dedup(docs, [passage_chunks, partial(windows_of, divide=divide)], id_col, text_col, keep_cols)


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
