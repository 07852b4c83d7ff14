"""Streams of text: row operators as they are, running counts with state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.normalize import Step
from glyphmill.functions.tokenize import Tokenizer
from glyphmill.operators.corpus import exploded, inlined, no_nulls, term_counts


def tokenized_stream(stream: DataFrame, text: str, tokenizer: Tokenizer, pipeline: Step | None = None) -> DataFrame:
    """Normalised, tokenized rows; the same projection as in batch."""
    c = F.col(text)
    return stream.withColumn("tokens", tokenizer(pipeline(c) if pipeline else c))


def running_term_counts(stream: DataFrame) -> DataFrame:
    """``term, cf, df`` so far, for update or complete mode."""
    each = inlined(stream, term_counts(F.col("tokens")))
    return each.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def windowed_term_counts(stream: DataFrame, ts: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """``window, term, cf`` with a watermark, for append mode."""
    return (
        exploded(stream.withWatermark(ts, late), no_nulls(F.col("tokens")), "term", ts)
        .groupBy(F.window(ts, width).alias("window"), "term")
        .agg(F.count(F.lit(1)).alias("cf"))
    )
