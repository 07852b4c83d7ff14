"""Stopword tests and filters for four languages, native."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import lexicon

STOPWORDS = {
    "en": lexicon.ENGLISH,
    "es": lexicon.SPANISH,
    "fr": lexicon.FRENCH,
    "de": lexicon.GERMAN,
}
_CODES = {"english": "en", "spanish": "es", "french": "fr", "german": "de"} | {k: k for k in STOPWORDS}


def language_code(language: str | Column) -> Column:
    """Two-letter code of a language's name or code in any case; null if unknown."""
    if isinstance(language, str):
        return F.lit(_CODES.get(language.lower())).cast("string")
    table = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.try_element_at(table, F.lower(language))


def is_stop_word(word: Column, language: str | Column) -> Column:
    code, low = language_code(language), F.lower(word)
    out = F.lit(False)
    for k, words in STOPWORDS.items():
        out = F.when(code == k, low.isin(*sorted(words))).otherwise(out)
    return out


def _not_in(words: list[str]) -> Callable[[Column], Column]:
    return lambda t: ~F.lower(t).isin(*words)


def remove_stop_words(tokens: Column, language: str | Column | None = None, stopwords: Iterable[str] | None = None) -> Column:
    """Drop stopwords and keep the others' case.

    By language, one per call or a column with one per row, of which unknown
    ones drop nothing; or by an own set, which lower-cased tokens are held
    against as it stands.
    """
    if stopwords is not None:
        own = sorted(set(stopwords))
        return F.filter(tokens, _not_in(own)) if own else tokens
    code = language_code(language)
    out = tokens
    for k, words in STOPWORDS.items():
        out = F.when(code == k, F.filter(tokens, _not_in(sorted(words)))).otherwise(out)
    return out


def stopword_table(spark: SparkSession) -> DataFrame:
    """``(lang, word)``."""
    rows = [(k, w) for k, words in STOPWORDS.items() for w in sorted(words)]
    return spark.createDataFrame(rows, "lang string, word string")
