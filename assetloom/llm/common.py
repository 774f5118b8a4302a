"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.plans.durable import Scratch, cut, saved, shared_dir  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package when it isn't installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if ROOT not in sys.path:
        sys.path.insert(0, ROOT)


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on columns that both sides have."""
    cond = F.lit(True)
    for i, n in enumerate(names):
        cond = left[n].eqNullSafe(right[n]) if not i else cond & left[n].eqNullSafe(right[n])
    return cond


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: DuckDB has no CRC-32: a relation ``crc`` (l) with the table of 256 entries, built from the polynomial. Needs WITH RECURSIVE.
SQL_CRC = """bit(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bit WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS l FROM bit WHERE k = 8)"""


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8, where ``crc`` is joined."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(a >> 8, l[xor(a & 255, b) + 1])), 4294967295::BIGINT)"
