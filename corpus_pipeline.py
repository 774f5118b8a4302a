"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents, and no others. Rows rejected by a stage are gone from then on.

Cases, for all stages: a row without text or words is rejected by the first stage; an id may be null, or come with several texts,
each of which is a document of its own; rows that agree in id and text are one document, which stays or goes with all its rows; an empty
table gives an empty one; texts may have any length. Ties are broken by the smallest id (null last), then by a hash of the text.

The stages have no SQL: fertility, chunk boundaries and token ids can't be expressed in it. They
are tested against brute-force versions.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from assetloom.llm import decontam, fertility, linechunks, minhash, spm_scan  # noqa: E402
from assetloom.llm.common import saved, ship, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules accept, judged row by row: repeated rows get equal verdicts, null languages are judged by script."""
    ship(spark)
    return fertility.accepted(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand elsewhere before them; documents of which nothing is left go. Lines aren't divided, so that near_dedup sees near copies whole.

    The first place of a passage is that of the smallest id, null ids coming last. ``n_chars`` is counted anew where a text has lost something."""
    ship(spark)
    out = linechunks.dedup_passages(docs, keep_cols=("lang", "source", "n_chars"), divide=False)
    left = F.col("n_removed") == 0
    size = F.when(left, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    out = out.where(left | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    return out.select(F.col("doc").alias("doc_id"), "text", "lang", "source", size.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id. Rows go by id and text; rows without id or words stay, and so do all repeated rows of a document that stays."""
    ship(spark)
    return minhash.without_near_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, by id and text: null ids are compared as equal. Without items all stay."""
    return decontam.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, and size and checksum of what the ids decode to, a row for each row of ``docs``."""
    ship(spark)
    return spm_scan.encoded_and_checked(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
