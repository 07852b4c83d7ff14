"""String distances by code points: native, but for Jaro's Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.tokenize import char_ngrams


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(longest == 0, F.lit(1.0))
        .when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0))
        .when(longest.isNotNull(), 1 - F.levenshtein(a, b) / longest)
    )


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity; half transpositions count."""
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free: list[str | None] = list(b)
    met = []
    for i, x in enumerate(a):
        try:
            at = free.index(x, max(0, i - reach), min(len(b), i + reach + 1))
        except ValueError:
            continue
        free[at] = None
        met.append(x)
    if not met:
        return 0.0
    other = [y for y, left in zip(b, free, strict=True) if left is None]
    odd = sum(x != y for x, y in zip(met, other, strict=True)) / 2.0
    m = float(len(met))
    return (m / len(a) + m / len(b) + (m - odd) / m) / 3.0


@F.pandas_udf(T.DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"
    )


def jaro(a: Column, b: Column) -> Column:
    return _jaro(a, b)


def jaro_winkler(a: Column, b: Column, prefix_weight: float = 0.1, max_prefix: int = 4) -> Column:
    """Jaro raised by the common prefix, without a threshold; over 1 for weights above a quarter."""
    if prefix_weight < 0:
        raise ValueError("prefix_weight must not be negative")
    if max_prefix < 0:
        raise ValueError("max_prefix must not be negative")
    j = jaro(a, b)
    shared = F.lit(0)
    for n in range(1, max_prefix + 1):
        alike = (F.length(a) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)) & (F.length(b) >= n)
        shared = shared + alike.cast("int")
    return j + shared * F.lit(float(prefix_weight)) * (1 - j)


def ngram_distance(a: Column, b: Column, n: int = 2) -> Column:
    """One minus the Jaccard similarity of character n-gram sets; equal strings are at 0."""
    x, y = char_ngrams(a, n, lower=False), char_ngrams(b, n, lower=False)
    union = F.size(F.array_union(x, y))
    apart = F.when(union == 0, F.lit(1.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)
    return F.when(a == b, F.lit(0.0)).otherwise(apart)
