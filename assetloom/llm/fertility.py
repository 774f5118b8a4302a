"""Quality rules from tokeniser fertility.

Every word of a text is segmented, as a word after a space, with a public SentencePiece vocabulary.
Three figures judge the text: characters per token, the share of tokens that are fallback bytes, and
the entropy of its tokens in bits, as a share of the most that so many tokens could have. Each
language has a band of accepted figures; languages without one are judged by the script of most of
their letters, and scripts without one by the widest band. Texts that fail plain counts of words and
repeats are rejected before that.

Words repeat, so each task segments a word once and keeps the result in a table of bounded size.
Whole texts are read; nothing is shuffled.

Cases: a null or empty text has no words and is rejected; figures of a text without tokens are
null; very long words are segmented without being kept in the table; repeated rows are judged each
on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, slices, table
from .pieces import WordTable

#: (least, most characters per token; most byte-fallback share; least entropy share)
Band = tuple[float, float, float, float]
#: Least characters per token: the 1st percentile of the sf0.1 documents labelled good that pass the counts, rounded down to
#: hundredths. The most, and the entropy, are left wide: ordinary words of these languages have more characters per token than
#: those documents, and the entropy share falls with a text's length, so that a percentile of it would reject the longest texts.
BANDS: dict[str, Band] = {
    "en": (2.09, 6.0, 0.02, 0.45),
    "de": (2.11, 6.0, 0.02, 0.45),
    "fr": (1.85, 6.0, 0.02, 0.45),
    "es": (1.82, 6.0, 0.02, 0.45),
}
SCRIPT_BANDS: dict[str, Band] = {
    "LATIN": (1.5, 6.5, 0.05, 0.40),
    "CYRILLIC": (1.2, 6.5, 0.05, 0.40),
    "GREEK": (0.9, 6.5, 0.10, 0.35),
    "CJK": (0.5, 4.0, 0.80, 0.30),
    "HIRAGANA": (0.5, 4.0, 0.60, 0.30),
    "HANGUL": (0.4, 4.0, 0.90, 0.30),
    "ARABIC": (0.6, 6.0, 0.50, 0.30),
}
WIDEST: Band = (0.25, 8.0, 1.0, 0.25)
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double"

_word = re.compile(WORD)


def repeated_words(numbers: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    top = int(numbers.max()) + 1
    key = numbers[:n]
    for k in range(1, width):
        if top ** (k + 1) >= 1 << 63:  # ranks stay below n, so that the product fits
            key, numbers = np.unique(key, return_inverse=True)[1], np.unique(numbers, return_inverse=True)[1]
        key = key * (int(numbers.max()) + 1) + numbers[k : k + n]
    order = np.argsort(key, kind="stable")
    twin = np.zeros(n + 1, bool)
    twin[1:n] = key[order[1:]] == key[order[:-1]]
    hit = order[twin[:-1] | twin[1:]]
    edge = np.zeros(len(numbers) + 1, np.int64)
    edge[hit] += 1
    edge[hit + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def script(text: str) -> str:
    """The script of most letters among the distinct characters of a text, weighted by their counts."""
    votes: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = unicodedata.name(c, "?").split(" ", 1)[0]
            votes[name] = votes.get(name, 0) + text.count(c)
    return max(sorted(votes), key=votes.get, default="?")


def judge(text: str | None, lang: str | None, words_of: WordTable, bands: dict[str, Band], script_bands: dict[str, Band]) -> tuple:
    """The row of a text, without its id."""
    text = text or ""
    words = _word.findall(text)
    n, chars = len(words), sum(map(len, words))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _word.search(line):
            seen.add(line)
    numbers = words_of.numbers(words)
    repeat = repeated_words(numbers)
    failed = n < 50 or 100 * repeat > 50 * n
    tokens = words_of.tokens(numbers)
    per_token = share = entropy = None
    kept = False
    if m := len(tokens):
        per_token, share = chars / m, float(words_of.is_byte[tokens].mean())
        tokens.sort()
        p = np.diff(np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))) / m
        entropy = float(-(p * np.log2(p)).sum())
        low, high, most_bytes, least = bands.get(lang or "") or script_bands.get(script(text), WIDEST)
        kept = not failed and low <= per_token <= high and share <= most_bytes and entropy >= least * np.log2(min(m, len(words_of.is_byte)))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, bool(kept), m, per_token, share, entropy


def fertility(docs: DataFrame, vocabulary: str = VOCABULARY, bands: dict[str, Band] = BANDS, script_bands: dict[str, Band] = SCRIPT_BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, fertility figures and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, names = WordTable(vocabulary), None
        for b in slices(batches):
            ids, texts, langs = b.columns
            rows = [judge(t.as_py(), g.as_py(), words_of, bands, script_bands) for t, g in zip(texts, langs, strict=True)]
            names = names or [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, vocabulary: str = VOCABULARY, bands: dict[str, Band] = BANDS, script_bands: dict[str, Band] = SCRIPT_BANDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordTable(vocabulary)
        for b in slices(batches):
            keep = [judge(t.as_py(), g.as_py(), words_of, bands, script_bands)[6] for t, g in zip(b.column(at), b.column(lang_at), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility(table(spark, sf_dir, "documents"))
