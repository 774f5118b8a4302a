import random
import zlib
from collections import Counter

from assetloom.llm.sharding import shard_documents


def test_slots_sizes_and_growth(spark):
    rng = random.Random(1)
    rows = [(i * 3, "é" * rng.randint(0, 5)) for i in range(3000)] + [(None, None), (1, ""), (3, "x"), (3, "x"), (3, "y")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, shard int, block string")
    got = shard_documents(df, [1.0] * 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) if i != 0 else (-1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 250 < len(slots) < 510
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {8} and 200 < len(moved) < 480
    assert len({r.shard for r in got if r.doc_id == 3}) == 1 and {r.law for r in got} == {"key"}
    assert shard_documents(df.where("false"), [1.0, 2.0]).count() == 0


def test_weights(spark):
    df = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text")
    n = Counter(r.shard for r in shard_documents(df, [1.0, 2.0, 5.0]).collect())
    assert abs(n[0] / 8000 - 1 / 8) < 0.02 and abs(n[2] / 8000 - 5 / 8) < 0.02
