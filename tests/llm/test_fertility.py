import collections
import os
import random
import re

import pytest

from assetloom.llm.fertility import BANDS, SCRIPT_BANDS, VOCABULARY, WordTable, accepted, fertility, judge, repeated_words, script

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
WORDS = "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day".split()
GOOD = " ".join(random.Random(7).choices(WORDS, k=300))
TEXTS = [GOOD, "", None, "a b c " * 60, "one two\n\none two\n \none two", "x" * 5000, "漢字 かな " * 60, "a ▁b c▁ d", "# * $ % & | < >" * 9, "\x1c\x85  word", GOOD + " \n" + GOOD]


def test_counts_against_brute_force():
    t = WordTable(VOCABULARY)
    for text in TEXTS:
        row = judge(text, "en", t, BANDS, SCRIPT_BANDS)
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        tokens = [x for y in t.model.encode(w) for x in y]
        assert row[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))
        assert row[5] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and row[7] == len(tokens)
        if tokens:
            assert row[8] == pytest.approx(sum(map(len, w)) / len(tokens)) and row[9] == pytest.approx(sum(t.model.is_byte(x) for x in tokens) / len(tokens))


def test_table_forgets_and_widths():
    import numpy as np

    t = WordTable(VOCABULARY, most=3)
    for text in ("a b c d e", "f g", "a b"):
        n = t.numbers(text.split())
        assert t.tokens(n).tolist() == [x for y in t.model.encode(text.split()) for x in y]
    assert repeated_words(np.array([1, 2, 3, 1, 2, 3])) == 6 and repeated_words(np.array([1 << 40, 2, 3, 1 << 40, 2, 3, 9])) == 6
    assert script("Слово word слово") == "CYRILLIC" and script("12") == "?"


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(TEXTS)] + [(0, GOOD, None, 1)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in fertility(df).collect()}
    assert [i for i, r in sorted(got.items()) if r.kept] == [0] and fertility(df).count() == len(TEXTS) + 1
    assert accepted(df).columns == df.columns and accepted(df).count() == 2
    assert fertility(df.where("false")).count() == 0


def test_bands_reject_what_counts_pass():
    t, rng = WordTable(VOCABULARY), random.Random(5)
    word = lambda: "".join(rng.choice("wh nt on ha he re th er in an".split()) for _ in range(3))
    junk = " ".join(word() + rng.choice(["***", "$$$", "&&&", ""]) for _ in range(300))
    menu = " | ".join(word().title() for _ in range(300))
    for text in (junk, menu):
        for lang in ("en", "de"):
            row = judge(text, lang, t, BANDS, SCRIPT_BANDS)
            assert not row[5] and not row[6]
    assert judge(GOOD, "en", t, BANDS, SCRIPT_BANDS)[6]
