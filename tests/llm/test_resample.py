import math
import random

import numpy as np
import xxhash

from assetloom.llm.resample import importance_resample, sortable


def test_order_of_doubles():
    x = np.array([-np.inf, -3.5, -0.0, 0.0, 1e-300, 2.0, np.inf])
    assert (np.diff(sortable(x).astype(object)) >= 0).all()


def test_selection(spark):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(40))) for i in range(400)] + [(1000, None), (1001, ""), (None, "g1 g2")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ord int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400) if i % 4 and i % 3 == 0] + [(4, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for share in (0.5, 0.75, 1.0):
        got = importance_resample(docs, labels, share=share).collect()
        k = -(-int(share * 100) * len(rows) // 100)
        keys = sorted((r.gumbel_key for r in got), reverse=True)
        assert {r.gumbel_key for r in got if r.kept} == set(keys[:k]) and sum(r.kept for r in got) == k
    got = importance_resample(docs, labels, share=0.75).collect()
    assert sum(r.kept for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0) <= 3
    assert {r.log_weight for r in got if r.doc_id in (1000, 1001)} == {0.0}
    assert importance_resample(docs.where("false"), labels).count() == 0
    assert {r.log_weight for r in importance_resample(docs, labels.where("false")).collect()} == {0.0}


def test_weights_against_brute_force(spark):
    """Every log weight is computed again with plain integers and dictionaries; ties and repeated rows get equal keys."""
    rng, buckets, m = random.Random(8), 512, (1 << 64) - 1
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "GAMMA", "delta\n", "é", "x"]) for _ in range(rng.choice([0, 1, 2, 30, 3000])))) for i in range(40)]
    rows += [(40, None), (41, " \n"), (3, rows[3][1]), (3, rows[3][1])]
    good = {i for i in range(0, 40, 3)}
    labels = spark.createDataFrame([(i, 1, 0) for i in sorted(good)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")

    def grams(t):
        w = [xxhash.xxh64_intdigest(bytes(x)) for x in (t or "").encode().lower().split()]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) * 0x9E3779B97F4A7C15) & m for a, b in zip(w, w[1:])]
        return [x % buckets for x in w] + [(x ^ (x >> 31)) % buckets for x in pairs]

    raw, target = [1] * buckets, [1] * buckets
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    want = {(i, t): math.fsum(math.log(target[g] / sum(target)) - math.log(raw[g] / sum(raw)) for g in grams(t)) for i, t in rows}
    got = importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=0.5, buckets=buckets).collect()
    assert len(got) == len(rows)
    assert np.allclose(sorted(r.log_weight for r in got), sorted(want[i, t] for i, t in rows), atol=1e-9)
    by_id = {r.doc_id: r.log_weight for r in got}
    assert all(math.isclose(by_id[i], want[i, t], abs_tol=1e-9) for i, t in rows)
    assert len({r.gumbel_key for r in got if r.doc_id == 3}) == 1 and len({r.kept for r in got if r.doc_id == 3}) == 1
    assert {r.kept for r in importance_resample(spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string"), labels, share=0.4).collect()} == {True}  # ties with the last are kept
