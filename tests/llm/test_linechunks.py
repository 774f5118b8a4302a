import random

from assetloom.llm.linechunks import chunk_bounds, chunks_of, dedup_lines, dedup_passages, outside, passage_chunks, windows_of


def brute(rows):
    """Keep the first of equal chunks, by id and position."""
    docs = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=repr)
    docs.sort(key=lambda x: (x[0], x[1] or 0))
    seen, out = set(), {}
    for _, i, t in docs:
        lines, bounds, own, kept = t.split("\n"), None, {a for a, _, _ in chunks_of(t)}, []
        bounds = chunk_bounds(lines)
        for a, z in zip(bounds, bounds[1:]):
            body = "\n".join(lines[a:z])
            if a in own and body in seen:
                continue
            if a in own:
                seen.add(body)
            kept += lines[a:z]
        out[i, t] = "\n".join(kept)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(2, 9)))
    shared = [line() for _ in range(12)]
    rows = []
    for i in range(60):
        own = [line() for _ in range(rng.randint(0, 8))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (shared if i % 3 else []) + own[at:])))
    rows += [(60, rows[5][1]), (61, rows[6][1]), (7, rows[7][1]), (62, None), (63, ""), (None, rows[9][1]), (64, "\n\n\n"), (65, "x\n" * 500)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted((r.doc is None, r.doc or 0, r.text) for r in got if r.text is not None) == sorted((i is None, i or 0, want[i, t]) for i, t in rows if t is not None)
    assert [r.text for r in got if r.doc == 62] == [None]
    assert sum(r.n_removed > 0 for r in got) > 30


def test_bounds_resist_shifts():
    rng = random.Random(5)
    body = [str(rng.random()) for _ in range(200)]
    base = set(chunk_bounds(body))
    moved = {x - 3 for x in chunk_bounds(["p", "q", "r", *body])}
    assert len(base ^ moved) <= 6
    assert all(b - a <= 32 for a, b in zip(sorted(base), sorted(base)[1:]))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rev long, first int")
    assert dedup_lines(empty, keep_cols=("rev", "first")).count() == 0
    one = spark.createDataFrame([(1, "a b\nc d\ne f", 9, 8)], "doc_id long, text string, rev long, first int")
    assert dedup_lines(one, keep_cols=("rev", "first")).collect()[0].asDict() == {"doc": 1, "text": "a b\nc d\ne f", "n_removed": 0, "rev": 9, "first": 8}


def lines_that_stay(rows):
    """Lines of each document that are in no earlier pair of neighbouring lines and, with ten words or more, stand nowhere before."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines)):
            for body in ([lines[k]] if len(lines[k].split()) >= 10 else []) + (["\n".join(lines[k : k + 2])] if k + 1 < len(lines) else []):
                if body in seen:
                    gone |= set(range(k, k + 1 + ("\n" in body)))
                seen.add(body)
        out[i] = [x for k, x in enumerate(lines) if k not in gone]
    return out


def test_short_passages_are_removed_whole(spark):
    rng = random.Random(11)
    line = lambda a, z: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(a, z)))
    rows, planted = [], {}
    for i in range(1, 7):
        for k in range(8):
            passage = [line(52, 60) if i == 1 else line(9, 20) for _ in range(i)]
            for copy in range(3):
                own = [[line(3, 30) for _ in range(rng.randint(1, 5))] for _ in range(2)]
                rows.append((len(rows), "\n".join(own[0] + passage + own[1])))
                if copy:
                    planted[len(rows) - 1] = own[0] + own[1]
    rng.shuffle(rows)
    got = {r.doc: (r.text, r.n_removed) for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: t.split("\n") for i, (t, _) in got.items()} == lines_that_stay(rows)
    assert all(got[i][0].split("\n") == x for i, x in planted.items())
    assert all(got[i] == (t, 0) for i, t in rows if i not in planted)


def test_passages_of_long_lines(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    whole, within, a, b = words(300), words(200), words(90), words(90)
    rows = [(1, f"head\n{whole}\ntail"), (2, f"other\n{whole}\nend"), (3, f"{a} {within} {b}"), (4, f"{words(40)} {within} {words(70)}"), (5, "ha " * 400), (6, f"{a}\n\n{b}\n"), (7, f"{a}\n\n{b}\n"), (7, f"{a}\n\n{b}\n"), (8, None), (9, "")]
    got = [(r.doc, r.text, r.n_removed) for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc").collect()]
    t = {i: x for i, x, _ in got}
    assert t[1] == rows[0][1] and t[2] == "other\nend" and t[3] == rows[2][1] and t[5] == rows[4][1] and t[8] is None and t[9] == ""
    left = set(t[4].split()) & set(within.split())
    assert len(left) < 80 and set(rows[3][1].split()) - set(within.split()) <= set(t[4].split()) and got[3][2] == 1
    assert [(x, n > 0) for i, x, n in got if i == 7] == [("", True)] * 2


def test_chunks_go_first_and_windows_extend_them(spark):
    """Of a copy with other lines around, chunks take the most, and few windows are left to lay; the result is that of windows everywhere."""
    rng = random.Random(21)
    line = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 14)))
    body = [line() if rng.random() < 0.9 else "" for _ in range(60)]
    rows = [(i, "\n".join([line(), line(), *body, line()] if i % 2 else [line(), *body[i : i + 9], line()])) for i in range(12)]
    one, two = rows[1][1].encode(), rows[3][1].encode()
    before = {one[a:z] for a, z in zip(*passage_chunks(one))}
    gone = [(a, z) for a, z in zip(*passage_chunks(two)) if two[a:z] in before]
    assert len(gone) > 8
    assert len(outside(*windows_of(two), gone)[0]) < len(windows_of(two)[0]) / 2
    got = {r.doc: [x for x in r.text.split("\n") if x] for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = lines_that_stay([(i, "\n".join(x for x in t.split("\n") if x)) for i, t in rows])
    assert got == {i: x for i, x in want.items()}
