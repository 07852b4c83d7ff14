"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import exact_dedup, mixing, packing, quality, simhash
from glyphmill.llm._tables import documents
from glyphmill.sources.scratch import drop, materialise, scope, scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MIX = mixing.Mix(share=1.0)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their base rules and whose host passes."""
    return quality.passing(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id``."""
    return exact_dedup.surviving(docs, exact_dedup.exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component its first row."""
    return simhash.surviving(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target weights, once per epoch."""
    return mixing.mixed(docs, MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of windows of 4096 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SimHash components and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables go when its rows are written, and those when the next stage's are."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), path=path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
