import os
import random
import zlib

import pytest

from assetloom.llm.pieces import WordTable
from assetloom.llm.spm_scan import MODEL, OPEN, Vocabulary, backtrace, decode_documents, encode_documents, normalise, path, times, transfer

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")


def test_a_chunk_of_many_words():
    v, sp = Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = " ".join(f"word{i}" for i in range(3000))
    s = normalise(t)
    for words in (v.table(), WordTable(None, most=100, model=v.model)):
        assert transfer(v, words, s, 0, len(s), True, True) == {(OPEN, OPEN): len(sp.encode(t))}
        assert backtrace(v, words, s, 0, len(s), OPEN, OPEN).tolist() == sp.encode(t)


def test_a_table_that_forgets_gives_the_same_ids():
    v, sp = Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words, rng = WordTable(None, most=20, longest=6, model=v.model), random.Random(7)
    for _ in range(60):
        t = "".join(rng.choice(["the", " a", "\n", " of", "\n\nx", " 漢字é", " internationalisation", "\t"]) for _ in range(rng.randint(1, 40))).strip(" ")
        got = v.packed_all([t, None, "", t + " x"], words)
        assert [None if x is None else x.tolist() for x in got] == [sp.encode(t), None, [], sp.encode(t + " x")], t


def texts():
    rng = random.Random(4)
    bits = ["the ", "and", " ", "  ", "\n", "tion", "é", "漢字", "😀", "x" * 9, "hello world ", "0.123", "▁", "ß", "     ", "Über", "\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["", " ", "a", " a", "a ", "▁x", " " * 70 + "z", "naïve café " * 30]


def test_words_equal_the_library():
    v, sp = Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts():
        assert v.encode(t) == sp.encode(t), t
        assert v.decode(v.encode(t)) == t.replace("▁", " ")


def test_product_is_associative_and_finds_the_path():
    v, sp = Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    s = normalise("internationalisation" * 40 + " of the " + "supercalifragilistic" * 40)
    at = [0, 170, 400, 610, 1000, len(s)]
    ms = [transfer(v, v.table(), s, a, z, a == 0, z == len(s)) for a, z in zip(at, at[1:])]
    left, right = ms[0], ms[-1]
    for m in ms[1:]:
        left = times(left, m)
    for m in ms[-2::-1]:
        right = times(m, right)
    assert left == right == {(OPEN, OPEN): len(sp.encode(s[1:].replace("▁", " ")))}
    assert len(path(ms, OPEN, OPEN)) == len(at)


def test_documents_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(9)
    long_ = ["".join(rng.choice(["thing", "er", " ", "of", "ß", "\n", "ing "]) for _ in range(400)) for _ in range(8)] + ["abcdefghij" * 150, " " * 900, "漢" * 700]
    rows = list(enumerate(texts() + long_ + [None])) + [(3, long_[0]), (3, long_[0]), (None, long_[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = encode_documents(df.selectExpr("*", "1 AS no", "text AS body"), chunk=100, block=3)
    out = decode_documents(got).collect()
    assert len(out) == len(rows)
    want = sorted((i is None, i or 0, None if t is None else sp.encode(t)) for i, t in rows if t is not None)
    assert sorted((r.doc is None, r.doc or 0, r.ids) for r in out if r.ids is not None) == want
    assert sorted(r.text for r in out if r.text is not None) == sorted(t.replace("▁", " ") for _, t in rows if t is not None)
    assert encode_documents(df.where("false"), chunk=100).count() == 0
    checked = encode_documents(df, chunk=100, block=3, check=True).collect()
    assert sorted((r.ids, r.n_ids) for r in checked if r.ids is not None) == sorted((x, len(x)) for _, _, x in want)
    plain = [("" if t is None else t.replace("▁", " ")).encode() for _, t in rows]
    assert sorted((r.decoded_bytes, r.decoded_crc32) for r in checked) == sorted((len(t), zlib.crc32(t)) for t in plain)
