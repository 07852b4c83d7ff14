"""Similarities of token sets and bags, inside a row and between relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.corpus import let, term_counts


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets; two empty ones are at 0."""
    return set_jaccard(F.array_distinct(a), F.array_distinct(b))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of arrays without copies."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return set_overlap(F.array_distinct(a), F.array_distinct(b))


def set_overlap(a: Column, b: Column) -> Column:
    """Of arrays without copies."""
    least = F.when(a.isNotNull() & b.isNotNull(), F.least(F.size(a), F.size(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def _square(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["v"] * e["v"])


def entries_dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of ``struct<k, v double>`` with distinct keys.

    Both are sorted together; equal keys are then neighbours.
    """

    def products(both: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            after = F.get(both, i + 1)
            return F.when(after["k"] == x["k"], x["v"] * after["v"]).otherwise(F.lit(0.0))

        return F.aggregate(F.transform(both, step), F.lit(0.0), lambda s, v: s + v)

    return let(F.sort_array(F.concat(a, b)), products)


def entries_cosine(a: Column, b: Column) -> Column:
    """Zero norms and undefined quotients are at 0."""
    norms = F.sqrt(_square(a)) * F.sqrt(_square(b))
    return F.coalesce(F.nanvl(F.when(norms > 0, entries_dot(a, b) / norms), F.lit(0.0)), F.lit(0.0))


def _map_entries(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def map_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(a), F.lit(0.0), lambda x, y: x + y * y))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from any key to double."""
    return let(_map_entries(a), lambda x: let(_map_entries(b), lambda y: entries_cosine(x, y)))


def bag(tokens: Column) -> Column:
    return F.transform(term_counts(tokens), lambda x: F.struct(x["term"].alias("k"), x["tf"].cast("double").alias("v")))


def cosine_bags(a: Column, b: Column) -> Column:
    return let(bag(a), lambda x: let(bag(b), lambda y: entries_cosine(x, y)))


def cosine_rows(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, cosine`` of two columns of counts, ``array<struct<k, v double>>`` with distinct keys.

    In Arrow batches, where the keys of many rows are numbered and matched at
    once: sorting arrays in lambdas costs many times as much. Zero norms are at 0.
    """

    def entries(part: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys, their rows and values."""
        lengths = pc.fill_null(pc.list_value_length(part.column(i)), 0).to_numpy(zero_copy_only=False)
        values = pc.list_flatten(part.column(i + 1)).to_numpy(zero_copy_only=False)
        return pc.list_flatten(part.column(i)), np.repeat(np.arange(len(lengths)), lengths), values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                n = part.num_rows
                (ka, ra, va), (kb, rb, vb) = entries(part, 1), entries(part, 3)
                numbered = pa.concat_arrays([ka, kb]).dictionary_encode()
                codes = pc.fill_null(numbered.indices, -1).to_numpy(zero_copy_only=False).astype("int64")
                size = len(numbered.dictionary) + 1
                own, other = ra * size + codes[: len(ka)], rb * size + codes[len(ka) :]
                order = np.argsort(own)
                at = np.searchsorted(own[order], other)
                found = (at < len(own)) & (codes[len(ka) :] >= 0)
                found[found] = own[order[at[found]]] == other[found]
                dots = np.bincount(rb[found], va[order[at[found]]] * vb[found], n)
                norms = np.sqrt(np.bincount(ra, va * va, n)) * np.sqrt(np.bincount(rb, vb * vb, n))
                out = np.divide(dots, norms, out=np.zeros(n), where=norms > 0)
                yield pa.record_batch([part.column(0), pa.array(out, pa.float64())], [key, "cosine"])

    columns = [F.col(f"{c}.{x}").alias(f"{x}{i}") for i, c in enumerate((a, b)) for x in "kv"]
    return rows.select(F.col(key).cast("long"), *columns).mapInArrow(run, f"{key} long, cosine double")


def gram_keys(tokens: Column, n: int) -> Column:
    """n-grams as strings that keep token boundaries, which sets of arrays would compare one by one.

    The tokens are followed by their lengths, and so can be told apart whatever they hold.
    """

    def key(i: Column) -> Column:
        own = [F.get(tokens, i + k) for k in range(n)]
        sizes = [F.coalesce(F.octet_length(t), F.lit(-1)).cast("string") for t in own]
        return F.concat_ws("\x1f", *[F.coalesce(t, F.lit("")) for t in own], *sizes)

    none = F.array().cast("array<string>")
    if n <= 0:
        return F.when(tokens.isNotNull(), none)
    keys = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), key)
    return F.when(F.size(tokens) >= n, keys).when(tokens.isNotNull(), none)


def ngram_cosine(a: Column, b: Column, n: int) -> Column:
    return cosine_bags(gram_keys(a, n), gram_keys(b, n))


def ngram_jaccard(a: Column, b: Column, n: int) -> Column:
    return jaccard(gram_keys(a, n), gram_keys(b, n))


def cosine_between(left: DataFrame, right: DataFrame, left_id: str, right_id: str, slices: int | None = None) -> DataFrame:
    """``left_id, right_id, cosine`` of the pairs that share a term.

    Both sides are ``(id, term, tf)``. Only pairs with a common term meet, on
    the term; norms are joined to the pairs that remain. With ``slices`` the
    left side's rows that have such a term are dealt out by id before they are
    paired, so that a task holds the pairs of one slice.
    """
    def normed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(name))

    a = left.select(left_id, "term", F.col("tf").alias("_a"))
    b = right.select(right_id, "term", F.col("tf").alias("_b"))
    if slices:
        a = a.join(b.select("term").distinct(), "term", "left_semi").repartition(slices, left_id)
    dots = a.join(b, "term").groupBy(left_id, right_id).agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))
    return (
        dots.join(normed(left, left_id, "_na"), left_id)
        .join(normed(right, right_id, "_nb"), right_id)
        .select(left_id, right_id, (F.col("dot") / (F.col("_na") * F.col("_nb"))).alias("cosine"))
    )
