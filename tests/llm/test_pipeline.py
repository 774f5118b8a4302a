import os
import random

import pytest

import corpus_pipeline
from assetloom.llm.fertility import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


WORDS = "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day".split()


def para(tag, n):
    rng = random.Random(tag)
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(14)) for _ in range(n))


def test_stages(spark, tmp_path):
    item = "they had the question " + " ".join(f"benchmark{i}" for i in range(20))
    rows = [
        (1, para("red", 8)),
        (2, para("blue", 8)),
        (3, "bad bad bad " * 40),
        (4, para("green", 8) + "\n" + item),
        (5, para("white", 8).replace("\n", " ")),
        (6, para("white", 8).replace("\n", " ") + " one ending"),
        (7, para("red", 8)),
        (8, None),
        (9, ""),
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert left == [[1, 2, 4, 5, 6, 7], [1, 2, 4, 5, 6], [1, 2, 4, 5], [1, 2, 5], [1, 2, 5]]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in whole) == [1, 2, 5]
    assert {r.doc_id: r.decoded_bytes for r in whole}[1] == len(para("red", 8).encode())


def test_nulls_repeated_rows_and_giants(spark, tmp_path):
    """Every stage is held against what it should keep; the long text is of more than one chunk of the encoder."""
    giant, plain, other = para("giant", 900), para("plain", 8), para("other", 8)
    rows = [(1, plain), (1, plain), (1, other), (None, para("none", 8)), (None, None), (2, giant), (3, giant + "\n" + para("tail", 2))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rev string, key string"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        kept.append(sorted((r.doc_id is None, r.doc_id or 0) for r in at.select("doc_id").collect()))
        assert name == "encoding" or at.columns == corpus_pipeline.COLUMNS
    every = [(False, 1), (False, 1), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert kept[:2] == [every, every]
    assert kept[2:] == [every] * 3  # of document 3 line_dedup has left the tail, which is no copy
    sizes = sorted(r.decoded_bytes for r in at.collect())
    assert sizes[-1] == len(giant.encode()) > 32_768
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
