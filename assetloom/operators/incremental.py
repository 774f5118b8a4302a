"""Incremental maintenance of a catalog by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_plan(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): unchanged, changed or new."""
    old = snapshot.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return current.join(old, "path", "left").select("path", status.alias("status"))


def stale_assets(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    return snapshot.join(current.select("path"), "path", "left_anti")


def stale_symbols(symbols: DataFrame, stale: DataFrame) -> DataFrame:
    return symbols.join(stale.select("path"), "path", "left_semi")


def reuse_or_extract(plan: DataFrame, cached: DataFrame, current: DataFrame, extract) -> DataFrame:
    """Cached rows of unchanged assets and ``extract(assets)`` of the others."""
    same = plan.where("status = 'unchanged'").select("path")
    fresh = extract(current.join(plan.where("status <> 'unchanged'").select("path"), "path", "left_semi"))
    return cached.join(same, "path", "left_semi").unionByName(fresh)


def upsert_assets(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot with the batch's rows inserted or put in place of those with their path."""
    return snapshot.join(batch.select("path"), "path", "left_anti").unionByName(batch.select(*snapshot.columns))


def index_summary(plan: DataFrame, **counted: DataFrame) -> DataFrame:
    """One row: assets, reused, parsed, and the counts of further frames."""
    out = plan.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("status") == "unchanged").alias("reused"), F.count_if(F.col("status") != "unchanged").alias("parsed"))
    for name, f in counted.items():
        out = out.crossJoin(f.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return out


def duplicate_content(assets: DataFrame) -> DataFrame:
    """Hashes that several assets have: hash, n, first path."""
    return assets.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


def replace_edges(edges: DataFrame, path: str) -> None:
    """Edges are rewritten as a whole, by type."""
    edges.write.mode("overwrite").partitionBy("type").parquet(path)
