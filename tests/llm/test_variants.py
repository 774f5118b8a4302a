import random
import re
import zlib
from collections import Counter

from assetloom.llm.common import Scratch
from assetloom.llm.variants import neighbours, roots, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if k > 1 and len(w) > 6}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(rng):
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "x×÷ÿÀÈx"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(30):
            w = rng.choice(stems[: rng.choice([8, 66])])
            at = rng.randrange(len(w) + 1)
            kind = rng.random()
            words.append(w if kind < 0.7 else w[:at] + w[at + 1 :] if kind < 0.8 else w[:at] + rng.choice("abcé") + w[at:] if kind < 0.9 else w[:at] + rng.choice("abcé") + w[at + 1 :])
        rows.append((i if i else None, rng.choice([" ", "-", ", ", "\n"]).join(words).title() if i % 9 == 0 else " ".join(words)))
    return rows + [(5, "short words are no words"), (6, None), (7, ""), (8, "z" * 30_000 + " " + "z" * 30_000 + " " + "z" * 29_999 + "y"), (9, "z" * 29_999 + "y")]


def test_against_all_pairs(spark):
    rows = texts(random.Random(2))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    want = brute(rows)
    assert got(spelling_variants(df)) == want
    assert sum(r[4] for r in want) > 200 and sum(r[1] is not None for r in want) > 10
    assert spelling_variants(df.where("false")).count() == 0


def test_every_pair_of_a_dense_vocabulary(spark):
    """All words over two letters: the most neighbours there can be."""
    words = ["".join("ab"[i >> k & 1] for k in range(size)) for size in (7, 8) for i in range(1 << size)]
    df = spark.createDataFrame([(i, w, i + 2) for i, w in enumerate(words)], "id long, word string, n long")
    pairs = neighbours(df, Scratch(spark)).collect()
    assert sorted((r.word, r.near) for r in pairs) == sorted((a, b) for a in words for b in words if one_edit(a, b))
    n = {w: i + 2 for i, w in enumerate(words)}
    assert all(r.near_n == n[r.near] for r in pairs)


def test_a_base_that_confuses_words_is_replaced(spark):
    """With base 1, prefixes of the same letters share a number."""
    words = ["abcdefgh", "abcdefhg", "bacdefgh", "abcdefgx"]
    df = spark.createDataFrame([(i, w, 2) for i, w in enumerate(words)], "id long, word string, n long")
    assert sorted((r.word, r.near) for r in neighbours(df, Scratch(spark), base=1).collect()) == [("abcdefgh", "abcdefgx"), ("abcdefgx", "abcdefgh")]


def test_roots_of_long_chains(spark):
    df = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(100)] + [("v", "w050")], "word string, form string")
    assert {r.word: r.root for r in roots(df).collect()} == {**{f"w{i:03}": "w100" for i in range(100)}, "v": "w100"}
