import hashlib
import random
import re
import zlib

from assetloom.llm.repair import Repair, damaged, repaired

LEGAL = re.compile(r"(s?(ua)+)?\Z")
BEGINS = re.compile(r"(s?(ua)*u?)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute(rows):
    """All edits that may give the roles, with at most two insertions in a place."""
    done = [(0, "", "", ())]
    for row, fault in [*zip(rows, faults(rows)), (None, None)]:
        more = []
        for cost, audit, roles, lines in done:
            for put in ("", "u", "a", "ua", "au"):
                to = roles + put
                if BEGINS.match(to):
                    at = (cost + 3 * len(put), audit + "I" * len(put), to, lines + tuple({"u": "user:", "a": "assistant:"}[x] for x in put))
                    if row is None:
                        more.append(at)
                        continue
                    cost2, audit2, _, lines2 = at
                    more.append((cost2 + 4, audit2 + "D", to, lines2))
                    if fault in (1, 2):
                        continue
                    extra = 3 * (fault == 3)
                    if BEGINS.match(to + (row[1][:1] or "-")):
                        more.append((cost2 + extra, audit2 + "K", to + row[1][:1], lines2 + (f"{row[1]}:{row[2]}",)))
                    for role in ("user", "assistant"):
                        if BEGINS.match(to + role[0]):
                            more.append((cost2 + 3 + extra, audit2 + "R", to + role[0], lines2 + (f"{role}:{row[2]}",)))
        least = {}
        for x in more:  # of the ways to the same roles so far, which has no bearing on what follows
            key = x[2][-1:] if x[2] else ""
            least.setdefault(key, []).append(x)
        done = [x for v in least.values() for x in v if x[0] <= min(y[0] for y in v)]
    cost, audit, _, lines = min((x for x in done if LEGAL.match(x[2])), key=lambda x: (x[0], x[1]))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(rng, n):
    return [(t, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "u"]), rng.choice(["Yes.", "No!", "", " ", "and then", f"Word {t}.", "Why?\n"])) for t in range(n)]


def test_against_all_edits():
    rng = random.Random(7)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(0, 7))
        r = Repair()
        for (_, role, text), fault in zip(rows, faults(rows)):
            r.row(role, text, fault)
        assert r.end() == brute(rows), rows


def test_settled_edits_leave_memory():
    """A long conversation holds only what isn't settled, with many ties on the way."""
    r, held = Repair(), 0
    for t in range(20_000):
        r.row(("user", "assistant", "user", "tool")[t % 4] if t % 7 else "system", f"t{t}.", 1 if t % 1000 > 900 else 0)
        held = max(held, max(x[1].at for x in r.best if x) - r.root.at)
    cost, audit, _ = r.end()
    assert held < 250 and len(audit) > 20_000 and cost > 0


def test_over_frames(spark):
    rng = random.Random(8)
    rows = [(c if c else None, t if rng.random() > 0.1 else None, rng.choice([role, None]), rng.choice([text, None, text])) for c in range(40) for t, role, text in random_rows(rng, rng.randint(1, 12))]
    rows += [(50, 1, "user", "Twice."), (50, 1, "user", "Twice."), (50, 1, "assistant", "A.")]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Nothing is left."))
    got = {r.conv_id: r for r in repaired(damaged(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string"))).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    for conv in got:
        after = []
        for c, t, role, text in rows:
            if c == conv:
                role, text = " " if role is None else role, " " if text is None else text
                k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
                text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
                after += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        f, turns = faults(after), {x[0] for x in after if x[0] is not None}
        r = got[conv]
        assert (r.blank, r.duplicate, r.truncated) == (f.count(1), f.count(2), f.count(3))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        if len(after) <= 9:
            assert (r.cost, r.audit, r.repaired_sha256) == brute(after), after
    assert got[gone].audit == "" and got[gone].repaired_sha256 == hashlib.sha256(b"").hexdigest() and got[gone].cost == 0
    assert repaired(damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
