import random

from assetloom.llm.decontam import RADIUS, contaminated, remove_contaminated


def bag(w):
    out, seen = set(), {}
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def brute(docs, items):
    """(doc, item) with any window of the item's length that is similar enough."""
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            if len(v) < 5:
                continue
            n, b = min(len(v), len(w)), bag(v)
            for s in range(len(w) - n + 1):
                a = bag(w[s : s + n])
                if len(a & b) >= 0.75 * len(a | b) and a:
                    out.add((d, i))
                    break
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, text(rng.randint(6, 50))) for i in range(25)] + [(90, "one two three"), (91, None), (92, ""), (93, "r r r r r r r r r")]
    docs = []
    for d in range(90):
        body = text(rng.randint(0, 120)).split()
        if d % 2:
            w = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 3])):
                w[rng.randrange(len(w))] = "odd"
            if d % 5 == 0:
                w.insert(len(w) // 2, "more")
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() for x in w] if d % 7 == 0 else w
        docs.append((d, ("\n" if d % 3 else " ").join(body)))
    for k in range(25):  # halves that have changed places, a part moved to the end, and a copy of the item's end at the end of the text
        w = items[k][1].split()
        half, third = len(w) // 2, len(w) // 3
        docs += [(300 + k, text(20) + " " + " ".join(w[half:] + w[:half]) + " " + text(20)), (400 + k, " ".join(w[:third] + w[2 * third :] + w[third : 2 * third])), (500 + k, text(9) + " " + " ".join(w[1:]))]
    docs += [(200, None), (201, ""), (202, "  "), (203, items[4][1]), (204, " ".join(items[5][1].split()[:-1])), (205, "r " * 30)]
    a = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, size int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, size int")
    got = contaminated(a, b).collect()
    want = brute(docs, items)
    assert {(r.doc, r.item) for r in got} == want and len(got) == len(want) > 20
    assert all(r.similarity >= 0.75 and r.hamming <= RADIUS for r in got)
    kept = remove_contaminated(a, b)
    assert kept.columns == a.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert contaminated(a.where("false"), b).count() == 0 and contaminated(a, b.where("false")).count() == 0


def test_swapped_halves_of_a_long_item(spark):
    item = [f"k{i}" for i in range(60)]
    rng = random.Random(1)
    other = lambda: " ".join(f"o{rng.randrange(999)}" for _ in range(50))
    docs = [(1, f"{other()} {' '.join(item[30:] + item[:30])} {other()}"), (2, f"{other()} {' '.join(item[:25])} {other()}")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc, r.item, r.start, r.n_words, round(r.similarity, 4)) for r in got] == [(1, 7, 50, 60, round(52 / 60, 4))]


def test_repeated_rows_and_null_ids(spark):
    item = " ".join(f"k{i}" for i in range(20))
    a = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (1, "clean words here only now"), (None, item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    assert sorted(((r.doc, r.item, r.start) for r in contaminated(a, b).collect()), key=str) == sorted([(1, 1, 1), (1, 2, 1), (None, 1, 0), (None, 2, 0)], key=str)
    assert [r.text for r in remove_contaminated(a, b).collect()] == ["clean words here only now"]


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    from pyspark.sql import functions as F

    from assetloom.llm.decontam import _blocks, _probes

    rng = random.Random(3)
    pairs = []
    for i in range(400):
        a = b = rng.getrandbits(63)
        for bit in rng.sample(range(63), i % 16):
            b ^= 1 << bit
        pairs.append((i, a, b))
    df = spark.createDataFrame(pairs, "i long, a long, b long")
    left = df.select("i", F.col("a").alias("bits")).select("i", _blocks().alias("x")).select("i", "x.no", "x.block")
    right = df.select("i", F.col("b").alias("bits")).select("i", _blocks().alias("x")).select("i", "x.no", "x.block").select("i", "no", _probes(RADIUS).alias("block"))
    met = {r.i for r in left.join(right, ["i", "no", "block"]).select("i").distinct().collect()}
    assert {i for i, a, b in pairs if (a ^ b).bit_count() <= RADIUS} <= met


def test_bags_number_repeated_shingles(spark):
    from assetloom.llm.decontam import _bag

    texts = ["r r r r r r r r r", "a b c d e", "a b a b a b a b a b a b"]
    df = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")
    for r in df.select("w", _bag("w").alias("bag")).collect():
        assert {tuple(x.rsplit(" ", 1)) for x in r.bag} == {(" ".join(g), str(n)) for g, n in bag(r.w)} and len(r.bag) == len(r.w) - 4
