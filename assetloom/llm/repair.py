"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation is repaired by the cheapest edits that give it the roles ``(s?(ua)+)?``. Four states say how far the roles written
so far go: none, a system turn, a user turn, an assistant turn. For each state one survivor is kept, the cheapest edits that lead there; of equal
costs the edits whose initials are least in ASCII order, which is known by comparing all of what the two have not in common. One sequence of
edits can't begin another of the same cost, since both have edited the same rows and each insertion costs: so the order of two survivors
doesn't depend on what follows.

Survivors are leaves of a tree of back pointers whose nodes count their references. A node that no survivor
needs goes. As soon as only one branch leaves the tree's root, its edits are settled: they are emitted, the text goes into the running checksum and
is forgotten. What is held of a conversation is thus the part that isn't settled, not the conversation. A survivor goes too once another is so much
cheaper that whatever may follow the one can follow the other at a lower cost (``_hopeful``): without that, the edits that delete all rows would keep the tree's root.

Rows are dealt out by conversation once; Spark finds repeated turns in a window over that layout, and sorts the rows
by turn on disk if need be. The checksum of a whole repaired conversation can't be computed in parts, so one task reads all rows of a conversation, in
order, with bounded memory; only its audit, one character an edit, grows with it, as it is the result.

Cases: a null role or text is one space; rows with a null turn come first; a null id is a conversation of its own; rows
of equal turn are ordered by role, then text, so repeated rows are neighbours; a conversation without rows (all dropped) has zeros, an empty
audit and the checksum of nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SQL_CRC, slices, sql_crc32, table

#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, REPEATED, CUT = 1, 2, 3
USER, ASSISTANT = "user", "assistant"
#: States: nothing, a system turn, a user turn, an assistant turn.
NONE, S, U, A = range(4)
#: From which states a turn may be written, by its initial, and the state that it leads to.
MOVES = {"s": ((NONE,), S), "u": ((NONE, S, A), U), "a": ((U,), A)}


class Edit:
    """A node of the tree: an edit after those of ``up``. It is referred to by the nodes after it and by survivors."""

    __slots__ = ("after", "at", "held", "letter", "role", "text", "up")

    def __init__(self, up: Edit | None, letter: str, role: str = "", text: str = ""):
        self.up, self.letter, self.role, self.text = up, letter, role, text
        self.after: list[Edit] = []
        self.held = 0
        self.at = 0
        if up is not None:
            self.at = up.at + 1
            up.after.append(self)

    def release(self) -> None:
        """Remove the node, and those before it, as far as nothing refers to them."""
        node = self
        while not node.held and not node.after and node.up is not None:
            node.up.after.remove(node)
            node.up, node = None, node.up


def less(a: Edit, x: str, b: Edit, y: str) -> bool:
    """Whether the edits up to ``a`` and then ``x`` come before those up to ``b`` and then ``y``."""
    one, two = [x], [y]
    while a is not b:
        if a.at >= b.at:
            one.append(a.letter)
            a = a.up
        else:
            two.append(b.letter)
            b = b.up
    return one[::-1] < two[::-1]


class Repair:
    """The repair of one conversation, row by row."""

    def __init__(self):
        self.root = Edit(None, "")
        self.best: list[tuple[int, Edit] | None] = [(0, self.root), None, None, None]
        self.root.held = 1
        self.audit: list[str] = []
        self.sha, self.lines = hashlib.sha256(), 0
        self._turn(self._inserted(self.best))

    def _inserted(self, best: list) -> list:
        """The survivors with those that end in insertions."""
        best = list(best)
        for state, froms, role in ((U, (NONE, S, A), USER), (A, (U,), ASSISTANT)):
            pick = None
            for q in froms:
                if best[q] is not None:
                    pick = self._better(pick, (best[q][0] + INSERT, best[q][1], "I", role, ""))
            old = best[state]
            if pick is not None and (old is None or pick[0] < old[0] or pick[0] == old[0] and less(pick[1], "I", old[1].up, old[1].letter)):
                best[state] = (pick[0], Edit(pick[1], *pick[2:]))
                if old is not None:
                    old[1].release()
        return best

    @staticmethod
    def _hopeful(best: list) -> list:
        """Without survivors that can't win. After an assistant turn all may follow that may follow a system turn; and also what may follow nothing, if a system turn is deleted instead of kept."""
        for q, more in ((S, 0), (NONE, DELETE - KEEP)):
            if best[A] is not None and best[q] is not None and best[A][0] + more < best[q][0]:
                node, best[q] = best[q][1], None
                node.release()
        return best

    @staticmethod
    def _better(a, b):
        if a is None or b[0] < a[0] or b[0] == a[0] and less(b[1], b[2], a[1], a[2]):
            return b
        return a

    def _turn(self, best: list) -> None:
        """Make ``best`` the survivors, drop what they don't need and emit what they share."""
        old, self.best = self.best, best
        for x in best:
            if x is not None:
                x[1].held += 1
        for x in old:
            if x is not None:
                x[1].held -= 1
                x[1].release()
        while len(self.root.after) == 1 and not self.root.held:
            self.root = self.root.after[0]
            self._emit(self.root)
            self.root.up = None

    def _emit(self, e: Edit) -> None:
        self.audit.append(e.letter)
        if e.letter != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{e.role}:{e.text}".encode("utf-8", "surrogatepass"))
            self.lines += 1
        e.text = ""

    def row(self, role: str, text: str, fault: int) -> None:
        picks: list = [None] * 4
        for q, x in enumerate(self.best):
            if x is not None:
                picks[q] = self._better(picks[q], (x[0] + DELETE, x[1], "D", "", ""))
        if fault not in (BLANK, REPEATED):
            extra = TRUNCATED if fault == CUT else 0
            for initial, (froms, to) in MOVES.items():
                if role[:1] == initial:
                    letter, name, cost = "K", role, KEEP + extra
                elif initial == "s":
                    continue
                else:
                    letter, name, cost = "R", USER if initial == "u" else ASSISTANT, REROLE + extra
                for q in froms:
                    if self.best[q] is not None:
                        picks[to] = self._better(picks[to], (self.best[q][0] + cost, self.best[q][1], letter, name, text))
        self._turn(self._hopeful(self._inserted([None if p is None else (p[0], Edit(*p[1:])) for p in picks])))

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and checksum."""
        last = None
        for q in (NONE, A):
            x = self.best[q]
            if x is not None and (last is None or x[0] < last[0] or x[0] == last[0] and less(x[1], "", last[1], "")):
                last = x
        rest, e = [], last[1]
        while e is not self.root:
            rest.append(e)
            e = e.up
        for e in reversed(rest):
            self._emit(e)
        return last[0], "".join(self.audit), self.sha.hexdigest()


class _Conversation:
    def __init__(self, conv):
        self.conv, self.repair = conv, Repair()
        self.n = [0, 0, 0, 0]
        self.illegal, self.last, self.turns, self.low, self.high = 0, None, 0, None, None

    def row(self, turn, role, text, fault) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        self.n[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, sha = self.repair.end()
        return self.conv, gaps, *self.n[1:], self.illegal, cost, audit, sha


SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now, out, kind = ["conv_id", *(x.split()[0] for x in SCHEMA.split(", "))], None, [], pa.int64()

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for b in slices(batches, 1024):
        kind = b.schema.field(0).type
        for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv)
            if fault is not None:
                now.row(turn, role, text, fault)
        if len(out) > 1000:
            yield rows()
            out = []
    if now is not None:
        out.append(now.result())
    yield rows()


def repaired(rows: DataFrame) -> DataFrame:
    """The repair of every conversation. rows: conv_id, turn, role, text, and ``gone``: rows that only say that the conversation exists."""
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone").repartition("conv_id")
    kind = d.schema["conv_id"].dataType.simpleString()
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(F.col("gone"), None).when(~word, BLANK).when(seen, REPEATED).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    d = d.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    return d.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == REPEATED).mapInArrow(_stream, f"conv_id {kind}, {SCHEMA}")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text), damaged by the checksum of conversation and turn: ``gone``, without text, without ends of sentences, twice, or with another role."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    d = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("time", F.explode(times)).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


def op12_survivor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


_NEVER = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"


def _sql_then(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"


def _sql_least(*xs: str) -> str:
    return f"list_min([{', '.join(xs)}])"


def _sql_write(froms: tuple[str, ...], initial: str, name: str) -> str:
    """The least way to write the row as a turn of that initial."""
    line = "chr(10) || {} || ':' || text"
    own = [_sql_then(q, "extra", "K", line.format("role")) for q in froms]
    other = [_sql_then(q, "3 + extra", "R", line.format(f"'{name}'")) for q in froms]
    return f"CASE WHEN must THEN {_NEVER} WHEN role[1] = '{initial}' THEN {_sql_least(*own)} ELSE {_sql_least(*other)} END"


_SQL_USER, _SQL_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"


def _sql_inserted(q0: str, q1: str, q2: str, q3: str) -> str:
    """The four states with insertions, of a relation with the columns x0 to x3."""
    u = _sql_least(q2, *(_sql_then(q, "3", "I", _SQL_USER) for q in (q0, q1, q3)))
    return f"{q0} AS s0, {q1} AS s1, {u} AS s2, {_sql_least(q3, _sql_then(u, '3', 'I', _SQL_ASSISTANT))} AS s3"


OP12_SQL = f"""
WITH RECURSIVE {SQL_CRC},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM k)),
f AS (SELECT conv_id, turn, role, text, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM d),
r AS (SELECT *, row_number() OVER w AS rn, lag(role[1]) OVER w || role[1] AS pair, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
walk AS (
  SELECT conv_id, 0::BIGINT AS rn, {_sql_inserted("x0", "x1", "x1", "x1")} FROM (SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS x0, {_NEVER} AS x1 FROM conversations)
  UNION ALL
  SELECT conv_id, rn, {_sql_inserted("x0", "x1", "x2", "x3")} FROM (
    SELECT w.conv_id, r.rn, {_sql_then("s0", "4", "D")} AS x0,
      {_sql_least(_sql_then("s1", "4", "D"), f"CASE WHEN must OR role[1] <> 's' THEN {_NEVER} ELSE {_sql_then('s0', 'extra', 'K', 'chr(10) || role || chr(58) || text')} END")} AS x1,
      {_sql_least(_sql_then("s2", "4", "D"), _sql_write(("s0", "s1", "s3"), "u", "user"))} AS x2,
      {_sql_least(_sql_then("s3", "4", "D"), _sql_write(("s2",), "a", "assistant"))} AS x3
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.rn + 1)
),
done AS (SELECT conv_id, {_sql_least("s0", "s3")} AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) AS back FROM walk) WHERE back = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  s.c AS cost, s.a AS audit, sha256(substr(s.r, 2)) AS repaired_sha256
FROM done LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id
"""
