import hashlib
import random

from assetloom.llm.recipes import LEAST, MOST, chunk_ends, chunks, exact_duplicates, xxh


def brute(rows):
    groups = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(low, []).append(i)
    out = []
    for low, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(low.encode()).hexdigest()
        once = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and once, sha))
            once = once and i != keep
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def texts(rng):
    words = ["".join(rng.choice("abcdeÀéZ") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    long = [" ".join(rng.choice(words) for _ in range(n)) for n in (3000, 3000, 20000)]
    rows = [(i, t) for i, t in enumerate(long)]
    rows += [(10, long[0].upper().replace("É", "é").replace("À", "À")), (11, long[1][:-1] + "!"), (12, "x" + long[1]), (13, long[2])]
    rows += [(14, None), (15, ""), (16, ""), (None, "a b"), (None, "A b"), (17, "a B"), (None, "only null"), (None, "Only null"), (18, "É"), (19, "é"), (20, "same"), (20, "same"), (20, "SAME")]
    return rows + [(100 + i, "copied " * 300) for i in range(400)] + [(1000 + i, rng.choice(words)) for i in range(300)]


def test_against_brute_force(spark):
    rows = texts(random.Random(4))
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, group_size int, kept boolean").repartition(5)
    assert got(exact_duplicates(df)) == brute(rows)
    assert exact_duplicates(df.where("false")).count() == 0


def test_equal_hashes_of_other_chunks(spark):
    """With a digest of two bits nearly all chunks share their hash: their contents tell them apart."""
    rows = texts(random.Random(5))
    assert got(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: xxh(c) & 3)) == brute(rows)


def test_chunks():
    rng = random.Random(1)
    text = rng.randbytes(3_000_000)
    ends = chunk_ends(text)
    sizes = [z - a for a, z in zip([0, *ends], ends)]
    assert b"".join(chunks(text)) == text and all(LEAST <= s <= MOST for s in sizes[:-1]) and 3000 < sum(sizes) / len(sizes) < 7000
    moved = set(chunks(b"put before" + text)) & set(chunks(text))
    assert len(moved) > 0.99 * len(ends)  # boundaries follow the content
    assert chunk_ends(b"") == [] and chunk_ends(b"a") == [1] and chunk_ends(b"a" * 50_000)[-1] == 50_000
