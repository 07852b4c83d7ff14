"""Queries of the training-data operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import (
    exact_dedup,
    langid,
    licenses,
    line_dedup,
    mixing,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
)
from glyphmill.llm._tables import documents

_BY_NAME = {
    "op1_kk_sharding": sharding.query,
    "op2_digest_index_dedup": exact_dedup.query,
    "op3_language_id": langid.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_concat_cut_packing": packing.query,
    "op6_hierarchical_mixing": mixing.query,
    "op7_host_quality_rules": quality.query,
    "op8_zstd_novelty_secrets": secrets.query,
    "op9_patience_line_dedup": line_dedup.query,
    "op10_winnowed_licenses": licenses.query,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(documents(spark, sf_dir))) for name, f in _BY_NAME.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_digest_index_dedup": exact_dedup.ORACLE_SQL,
        "op7_host_quality_rules": quality.ORACLE_SQL,
    }
