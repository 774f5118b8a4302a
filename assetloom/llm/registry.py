"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, extract, fertility, linechunks, minhash, recipes, repair, resample, sharding, spm_scan, variants, warc
from .common import ship


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    k: _shipped(f)
    for k, f in {
        "pipeline": corpus_pipeline.run,
        "op1_warc_derivatives": warc.op1_warc_derivatives,
        "op9_host_suffix_array": extract.op9_host_suffix_array,
        "op8_sentencepiece_scan": spm_scan.op8_sentencepiece_scan,
        "op7_importance_resampling": resample.op7_importance_resampling,
        "op3_simhash_decontamination": decontam.op3_simhash_decontamination,
        "op10_minmax_near_duplicates": minhash.op10_minmax_near_duplicates,
        "op2_line_chunks": linechunks.op2_line_chunks,
        "op4_chat_snapshots": chat.op4_chat_snapshots,
        "op5_rendezvous_shards": sharding.op5_rendezvous_shards,
        "op6_tokeniser_fertility": fertility.op6_tokeniser_fertility,
        "op11_chunk_recipes": recipes.op11_chunk_recipes,
        "op12_survivor_repair": repair.op12_survivor_repair,
        "op13_trie_frontier": variants.op13_trie_frontier,
    }.items()
}
ORACLE_SQL = {"op3_simhash_decontamination": decontam.OP3_SQL, "op10_minmax_near_duplicates": minhash.OP10_SQL, "op4_chat_snapshots": chat.OP4_SQL, "op5_rendezvous_shards": sharding.OP5_SQL}
ORACLE_SQL |= {"op11_chunk_recipes": recipes.OP11_SQL, "op12_survivor_repair": repair.OP12_SQL, "op13_trie_frontier": variants.OP13_SQL}
