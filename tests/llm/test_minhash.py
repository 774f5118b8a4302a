import random
import re

import numpy as np

from assetloom.llm.minhash import LONGS, MinMax, WordHashes, _bitmap, linked, near_duplicates, shingles, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def sets(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """(id, n, component) of every row; ids are distinct."""
    s = [(i, sets(t)) for i, t in rows]
    up = {i: i for i, _ in s}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(s):
        for j, b in s[:x]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(a), top(i)) for i, a in s)


def corpus(seed=2, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    bases, out = [text(rng.randint(8, 90)) for _ in range(25)], []
    hot = text(12)
    for i in range(n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        t = " ".join(w) if i % 3 else f"{hot}\n{text(rng.randint(0, 40))}"
        out.append((i * 7 % 1009, t.upper() if i % 11 == 0 else t))
    return out + [(2000, None), (2001, ""), (2002, " \n "), (2003, "a b"), (2004, "A  b"), (2005, "a b c"), (2006, text(4000)), (2007, "漢 字 É é x\x1cy")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, key string")
    for small in (12, 1):
        got = near_duplicates(df, small_bucket=small).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_and_nulls(spark):
    t = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (5, t), (9, t), (None, t), (3, None), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 26, 5, True), (5, 26, 5, True), (9, 26, 5, False), (0, 26, None, True), (3, 0, 3, True), (3, 0, 3, True)], key=str)
    assert near_duplicates(df.where("false")).count() == 0


def test_several_texts_of_an_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    df = spark.createDataFrame([(3, t, "a"), (5, t + " more", "b"), (5, u, "c"), (5, u, "c"), (8, None, "d"), (None, t, "e")], "doc_id long, text string, rev string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect() if r.doc_id)
    assert got == [(3, 26, 3, True), (5, 26, 3, False), (5, 26, 3, False), (5, 27, 3, False), (8, 0, 8, True)]
    assert sorted(r.rev for r in without_near_duplicates(df).collect()) == ["a", "d", "e"]


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    h, m = WordHashes(), MinMax()
    for _ in range(60):
        n = int(rng.integers(5, 900))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        keep = a[rng.random(len(a)) < rng.choice([0.7, 0.85, 0.97])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, max(1, n // 20)).astype(np.uint64)]))
        if linked(a, b):
            apart = int(np.bitwise_count((_bitmap(a) ^ _bitmap(b)).view(np.uint64)).sum())
            assert 175 * apart <= 25 * (len(a) + len(b))
    assert len(_bitmap(a)) == LONGS and len(m.bands(shingles(b"a b c d e f", h))) == 32


def test_minimum_and_maximum_estimate_similarity():
    rng = np.random.default_rng(5)
    m = MinMax(permutations=400)
    x = np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    a, b = x[:500], x[100:]
    estimate = (m.signature(a) == m.signature(b)).mean()
    assert abs(estimate - len(np.intersect1d(a, b)) / len(x)) < 0.06
