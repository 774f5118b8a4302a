"""SentencePiece encoding and decoding of texts of any length by a max-plus parallel scan.

The vocabulary is a SentencePiece BPE model with byte fallback; ids equal the library's. A sequence
of pieces is the BPE encoding of a text exactly if every two neighbours are: if the encoding of
their joined text is those two pieces again. Encoding is therefore the search for a path whose steps
are all compatible, and a path's weight is its number of tokens (minus infinity where no
path exists).

A giant document is cut into chunks at fixed offsets. The state at a cut is the piece that covers
it: where it begins before the cut and where it ends behind it. Every chunk yields, on its own, the
max-plus matrix from states at its start to states at its end. Matrices of up to ``BLOCK`` chunks are
multiplied, then those of blocks; the one path through a document fixes the states at block ends,
these fix the states at all cuts, and then each chunk is traced back on its own. Documents of one
chunk have no cut and go through no shuffle.

No piece goes on over a space after another character (checked when the vocabulary is read), so
all paths of a chunk meet at its first word. Whole words have one path, so every task segments each of its distinct
words once, many at a time, and keeps the pieces in a table of bounded size; texts with runs of spaces or the space sign
itself are merged word by word. The search runs on words that a cut divides and on very long ones. The model has
to read texts as they are (checked: its normaliser changes nothing but spaces).

Cases: null texts have null ids and empty texts none; a space and the sign U+2581 are the same to
SentencePiece, so a text with that sign decodes to one with spaces; characters without a piece become
bytes; rows that agree in id and text get equal results each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, saved, slices, table
from .pieces import SPACE, WordTable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK = 32_768, 64
#: What normalisers change: runs of spaces and spaces at ends, wide and composed characters, other white space.
PROBE = "  \uff21\u2460\ufb01\tx  y\n z\u00a0\u00e9e\u0301\u3000 "
_segment = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

State = tuple[int, int]  # a piece's begin and end, relative to the cut that it covers
Matrix = dict[tuple[State, State], int]  # max-plus; pairs that are left out are minus infinity
OPEN: State = (0, 0)  # nothing covers the cut: the ends of a document


class Vocabulary:
    """Pieces, their scores, and the encodings of words seen so far."""

    def __init__(self, path: str = MODEL, most_words: int = 50_000):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model's normaliser changes texts")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece crosses a word's beginning")
        self.lines = not any("\n" in p for p in self.ids)  # then no piece crosses a line's end
        self.line_end = self._pack(self.ids_of("\n"))
        self.fits: dict[tuple[str, str], bool] = {}
        self.spaced, self.bare = Words(self, SPACE, most_words), Words(self, "", most_words)
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def merged(self, text: str) -> list[str]:
        """BPE: join the best-scored neighbours, the first of equals, until none is a piece."""
        parts, get, none = list(text), self.score.get, -float("inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 50_000:
                self.fits.clear()
            known = self.fits[key] = self.merged(a + b) == [a, b]
        return known

    def is_piece(self, text: str) -> bool:
        return text in self.ids or len(text) == 1

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def search(self, text: str, begin: int, last: str | None, stop: int) -> dict[int, tuple[int, int]]:
        """For every end up to ``stop`` that a compatible path from ``begin`` reaches: (begin of its last piece, tokens).

        ``last`` is the piece before ``begin`` (None: nothing precedes). The path to an end is the encoding of what it covers, so there is one at most."""
        found: dict[int, tuple[int, int]] = {begin: (begin, 0)}
        piece: dict[int, str | None] = {begin: last}
        ids, compatible, longest = self.ids, self.compatible, self.longest
        for i in range(begin + 1, stop + 1):
            for j in range(max(begin, i - longest), i):
                if j not in found:
                    continue
                t = text[j:i]
                if t not in ids and i - j > 1:
                    continue
                before = piece[j]
                if compatible(before, t) if before is not None else self.merged(t) == [t]:
                    found[i] = (j, found[j][1] + (1 if t in ids else len(t.encode("utf-8", "surrogatepass"))))
                    piece[i] = t
                    break
        return found

    def trace(self, text: str, found: dict[int, tuple[int, int]], begin: int, end: int) -> list[int]:
        spans = []
        while end > begin:
            spans.append((found[end][0], end))
            end = found[end][0]
        return [x for a, z in reversed(spans) for x in self.ids_of(text[a:z])]

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()

    def word(self, segment: str) -> bytes:
        """Packed ids of a text that begins where a word begins and ends where one ends."""
        if len(segment) > 48:  # merging takes time in the square of the length, the search does not
            return self._pack(self.trace(segment, self.search(segment, 0, None, len(segment)), 0, len(segment)))
        return self._pack([x for p in self.merged(segment) for x in self.ids_of(p)])

    def words(self, normal: str) -> bytes:
        """Packed ids of normalised text that begins and ends at word borders."""
        spaced, bare = self.spaced, self.bare
        return b"".join(spaced[s[1:]] if s[0] == SPACE else bare[s] for s in _segment.findall(normal))

    def split(self, text: str, space: str = " ") -> list[str] | None:
        """The words of a text (without the space before the first one), if single spaces divide them."""
        if not self.lines or (space == " " and SPACE in text):
            return None
        words = text.replace("\n", space + "\n").split(space)
        return None if "" in words else words

    def packed_all(self, texts: list[str | None], table: WordTable) -> list[np.ndarray | None]:
        """Ids of texts; the words of all of them are looked up at once."""
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[str] = []
        quick, ends = [], []
        for i, t in enumerate(texts):
            found = self.split(t) if t else None
            if found is not None:
                words += found
                quick.append(i)
                ends.append(len(words))
            elif t is not None:
                out[i] = np.frombuffer(self.words(normalise(t)), np.int32)
        if words:
            numbers = table.numbers(words)
            after = np.cumsum(table.length[numbers])[np.array(ends) - 1]
            for i, ids in zip(quick, np.split(table.tokens(numbers), after[:-1]), strict=True):
                out[i] = ids
        return out

    def table(self) -> WordTable:
        return WordTable(None, model=self.model)

    def encode(self, text: str) -> list[int]:
        return self.packed_all([text], self.table())[0].tolist()

    def decoded(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        return self.flat[np.repeat(self.start[ids], size) + at].tobytes().replace(SPACE.encode(), b" ")[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decoded(np.array(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """Read once by a worker."""
    return Vocabulary(path)


class Words(dict):
    """Packed ids of words seen so far, by the word without what stands before it."""

    def __init__(self, vocabulary: Vocabulary, before: str, most: int):
        super().__init__()
        self.vocabulary, self.before, self.most = vocabulary, before, most

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.word(self.before + word)
        if len(word) <= 48:
            if len(self) > self.most:
                self.clear()
            self[word] = ids
        return ids


def normalise(text: str) -> str:
    """What the model reads: a space first, and the space sign for spaces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def word_starts(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The first and last place in [begin, end) where a word begins: a space after another character."""
    first = regex.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, begin, end)
    if not first:
        return None
    at = first.start()
    last = end
    while (last := text.rfind(SPACE, at, last)) > at:
        if text[last - 1] != SPACE:
            return at, last
    return at, at


def states(v: Vocabulary, text: str, cut_at: int) -> list[State]:
    """Pieces that may cover a cut: begun before it, ending at it or behind it."""
    out = []
    for a in range(max(0, cut_at - v.longest), cut_at):
        for z in range(cut_at, min(len(text), a + v.longest) + 1):
            if v.is_piece(text[a:z]):
                out.append((a - cut_at, z - cut_at))
    return out


def transfer(v: Vocabulary, words: WordTable, text: str, begin: int, end: int, first: bool, last: bool) -> Matrix:
    """The matrix of the chunk [begin, end) of ``text``, which holds enough of its surroundings."""
    starts = word_starts(text, begin + v.longest, end - v.longest)
    out: Matrix = {}
    exits = [OPEN] if last else states(v, text, end)

    def leave(found: dict[int, tuple[int, int]]) -> list[tuple[State, int]]:
        if last:
            return [(OPEN, found[end][1])] if end in found else []
        return [((a, z), found[end + z][1]) for a, z in exits if end + z in found and found[end + z][0] == end + a]

    stop = end if last else min(len(text), end + v.longest)
    if starts:
        inner = text[starts[0] : starts[1]]
        found = v.split(inner[1:], SPACE)
        middle = len(v.words(inner)) // 4 if found is None else words.count(words.numbers(found))
        tail = leave(v.search(text, starts[1], None, stop))
    for s in [OPEN] if first else states(v, text, begin):
        at = begin + s[1]
        before = None if s == OPEN else text[begin + s[0] : at]
        if starts:
            n = v.search(text, at, before, starts[0]).get(starts[0])
            if n:
                out |= {(s, o): n[1] + middle + m for o, m in tail}
        else:
            out |= {(s, o): m for o, m in leave(v.search(text, at, before, stop))}
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product."""
    rows: dict[State, list[tuple[State, int]]] = {}
    for (s, o), w in b.items():
        rows.setdefault(s, []).append((o, w))
    out: Matrix = {}
    for (s, m), w in a.items():
        for o, x in rows.get(m, ()):
            if out.get((s, o), -1) < w + x:
                out[s, o] = w + x
    return out


def path(matrices: list[Matrix], enter: State, leave: State) -> list[State]:
    """The states at all cuts of the heaviest path, ends included."""
    best: list[dict[State, tuple[int, State]]] = [{enter: (0, enter)}]
    for m in matrices:
        now: dict[State, tuple[int, State]] = {}
        for (s, o), w in m.items():
            if s in best[-1] and (o not in now or now[o][0] < best[-1][s][0] + w):
                now[o] = (best[-1][s][0] + w, s)
        best.append(now)
    out = [leave]
    for b in reversed(best[1:]):
        out.append(b[out[-1]][1])
    return out[::-1]


def backtrace(v: Vocabulary, words: WordTable, text: str, begin: int, end: int, enter: State, leave: State) -> np.ndarray:
    """Ids of the pieces from the end of the entering one to the end of the leaving one."""
    at, stop = begin + enter[1], end + leave[1]
    before = None if enter == OPEN else text[begin + enter[0] : at]
    starts = word_starts(text, begin + v.longest, end - v.longest)
    if not starts:
        return np.array(v.trace(text, v.search(text, at, before, stop), at, stop), np.int32)
    head = v.trace(text, v.search(text, at, before, starts[0]), at, starts[0])
    inner = text[starts[0] : starts[1]]
    found = v.split(inner[1:], SPACE)
    middle = np.frombuffer(v.words(inner), np.int32) if found is None else words.tokens(words.numbers(found))
    tail = v.trace(text, v.search(text, starts[1], None, stop), starts[1], stop)
    return np.concatenate([np.array(head, np.int32), middle, np.array(tail, np.int32)])


def _pack(m: Matrix) -> bytes:
    return np.array([(*s, *o, w) for (s, o), w in m.items()], np.int64).tobytes()


def _unpack(packed: bytes) -> Matrix:
    return {((a, b), (c, d)): w for a, b, c, d, w in np.frombuffer(packed, np.int64).reshape(-1, 5).tolist()}


CHECKS = ["n_ids", "decoded_bytes", "decoded_crc32"]
_CHECK_SCHEMA = ", n_ids long, decoded_bytes long, decoded_crc32 long"


def _id_lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
    offsets = pa.array(ends, pa.int32())
    if any(x is None for x in ids):
        offsets = pa.array([None if x is None else e for x, e in zip([*ids, 0], ends.tolist(), strict=True)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]), pa.int32()))


def _checked(v: Vocabulary, ids: list[np.ndarray | None]) -> list[pa.Array]:
    texts = [b"" if x is None else v.decoded(x) for x in ids]
    return [pa.array([0 if x is None else len(x) for x in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]


def _rows(batches: Iterator[pa.RecordBatch], size: int = 8) -> Iterator[tuple]:
    for b in slices(batches, size):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _of_groups(frame: DataFrame, keys: list[str], order: str, columns: list[str], out: str, run: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``run`` on the rows (keys, columns) of each key in order, of which there are at most ``BLOCK`` or, for a document's blocks, as many as it has. It gives rows of ``out`` behind the keys."""
    types = frame.schema
    schema = ", ".join(f"{k} {types[k].dataType.simpleString()}" for k in keys) + ", " + out
    names = [*keys, *(x.split()[0] for x in out.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [f.type for f in b.schema][: len(keys)]
                yield b

        for key, group in groupby(_rows(seen(), 64), lambda r: r[: len(keys)]):
            made = [key + tuple(x) for x in run([r[len(keys) :] for r in group])]
            cols = list(zip(*made, strict=True))
            rest = [None] * (len(names) - len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, *rest], strict=True)], names=names)

    return frame.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(each, schema)


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """doc, ids: the encoding of every document; with ``check`` also the number of ids, and size and CRC-32 of what they decode to."""
    d = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    kind = d.schema["doc"].dataType.simpleString()
    giant = F.char_length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        words = v.table()
        for part in slices(batches, 64):
            ids = v.packed_all(part.column(1).to_pylist(), words)
            cols = [part.column(0), _id_lists(ids)]
            if check:
                cols += _checked(v, ids)
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "ids", *CHECKS][: len(cols)])

    small = d.where(~F.coalesce(giant, F.lit(False))).mapInArrow(whole, f"doc {kind}, ids array<int>" + (_CHECK_SCHEMA if check else ""))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = vocabulary(model).longest
        names = ["doc", "rev", "copies", "no", "n", "begin", "end", "body"]
        for b in slices(batches, 1):
            (r,), (t,), (c,) = (b.column(i).to_pylist() for i in (1, 2, 3))
            s = normalise(t)
            n = max(1, len(s) // chunk)
            for k in range(n):
                begin, end = k * chunk, (k + 1) * chunk if k < n - 1 else len(s)
                low = max(0, begin - edge)
                row = [r, c, k, n, begin - low, end - low]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x], pa.int64()) for x in row), pa.array([s[low : min(len(s), end + edge)]], pa.string())], names=names)

    long_ = d.where(giant).groupBy("doc", F.xxhash64("text").alias("rev"), "text").agg(F.count(F.lit(1)).alias("copies")).select("doc", "rev", "text", "copies")
    chunks = saved(long_.mapInArrow(split, f"doc {kind}, rev long, copies long, no long, n long, begin long, end long, body string").repartition("doc", "rev", "no"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        words = v.table()
        for b in slices(batches, 8):
            m = [_pack(transfer(v, words, t, a, z, k == 0, k == n - 1)) for k, n, a, z, t in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(m, pa.binary())], names=["doc", "rev", "no", "n", "m"])

    found = chunks.select("doc", "rev", "no", "n", "begin", "end", "body").mapInArrow(matrices, f"doc {kind}, rev long, no long, n long, m binary")
    mats = saved(found.withColumn("blk", F.floor(F.col("no") / block).cast("long")))

    def states_of(ms: list[bytes], enter: State, leave: State) -> list[tuple]:
        s = path(list(map(_unpack, ms)), enter, leave)
        return [(*a, *z) for a, z in zip(s, s[1:], strict=False)]

    def through(rows: list[tuple]) -> list[tuple]:
        return [(r[0], *x) for r, x in zip(rows, states_of([r[1] for r in rows], OPEN, OPEN), strict=True)]

    def multiply(rows: list[tuple]) -> list[tuple]:
        m = _unpack(rows[0][1])
        for r in rows[1:]:
            m = times(m, _unpack(r[1]))
        return [(_pack(m),)]

    def within(rows: list[tuple]) -> list[tuple]:
        return [(r[0], *x) for r, x in zip(rows, states_of([r[1] for r in rows], rows[0][2:4], rows[0][4:6]), strict=True)]

    at = "e0 long, e1 long, l0 long, l1 long"
    ends = ["e0", "e1", "l0", "l1"]
    one = _of_groups(mats.where(F.col("n") <= block), ["doc", "rev"], "no", ["no", "m"], f"no long, {at}", through)
    more = mats.where(F.col("n") > block)
    blocks = _of_groups(more, ["doc", "rev", "blk"], "no", ["no", "m"], "m binary", multiply)
    bounds = _of_groups(blocks, ["doc", "rev"], "blk", ["blk", "m"], f"blk long, {at}", through)
    same_block = more["doc"].eqNullSafe(bounds["doc"]) & (more["rev"] == bounds["rev"]) & (more["blk"] == bounds["blk"])
    joined = more.join(bounds, same_block).select(more["doc"], more["rev"], more["blk"], "no", "m", *ends)
    rest = _of_groups(joined, ["doc", "rev", "blk"], "no", ["no", "m", *ends], f"no long, {at}", within).drop("blk")
    cuts = cut(one.union(rest))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        words = v.table()
        for b in slices(batches, 8):
            ids = [backtrace(v, words, t, a, z, (e, f), (g, h)) for a, z, t, e, f, g, h in zip(*(b.column(i).to_pylist() for i in range(4, 11)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _id_lists(ids)], names=["doc", "rev", "copies", "no", "ids"])

    same_chunk = chunks["doc"].eqNullSafe(cuts["doc"]) & (chunks["rev"] == cuts["rev"]) & (chunks["no"] == cuts["no"])
    parts = chunks.join(cuts, same_chunk).select(chunks["doc"], chunks["rev"], "copies", chunks["no"], "begin", "end", "body", *ends)
    parts = parts.mapInArrow(traced, f"doc {kind}, rev long, copies long, no long, ids array<int>")
    large = parts.groupBy("doc", "rev").agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("x"))
    large = large.select("doc", F.flatten(F.transform("x", lambda y: y["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc", "ids")
    if check:

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = vocabulary(model)
            for part in slices(batches, 16):
                ids = [x.values.to_numpy() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *_checked(v, ids)], names=["doc", "ids", *CHECKS])

        large = large.mapInArrow(checked, f"doc {kind}, ids array<int>{_CHECK_SCHEMA}")
    return small.unionByName(large)


def decode_documents(encoded: DataFrame, model: str = MODEL, id_col: str = "doc", ids_col: str = "ids") -> DataFrame:
    """doc, text, ids."""
    e = encoded.select(encoded[id_col].alias("doc"), encoded[ids_col].alias("ids"))
    kind = e.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in slices(batches):
            texts = [None if x is None else v.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(1)], names=["doc", "text", "ids"])

    return e.mapInArrow(run, f"doc {kind}, text string, ids array<int>")


def encoded_and_checked(docs: DataFrame, **params) -> DataFrame:
    """doc_id, ids, n_ids, and size and checksum of what the ids decode to."""
    return encode_documents(docs, check=True, **params).withColumnRenamed("doc", "doc_id")


def op8_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_checked(table(spark, sf_dir, "documents"))
