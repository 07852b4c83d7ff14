"""The row operators as SQL functions of a session.

Native ones are SQL-bodied temporary functions, which Catalyst inlines; the
stemmers and Jaro are registered Arrow functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from glyphmill.functions import normalize, stopwords
from glyphmill.functions.distance import _jaro
from glyphmill.functions.stem import _porter, _porter_all, _smart, _smart_all


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_ACCENTS = f"{_text(normalize.ACCENTED + normalize.COMBINING)}, {_text(normalize.BARE)}"
_BLANKS = _text(f"[{normalize.BLANK}]+")

#: A replacement that stands for itself.
_LITERAL = r"replace(replace(to, '\\', '\\\\'), '$', '\\$')"


def _is_stop_word(word: str) -> str:
    """By the language's name or code, in any case; false for other languages."""
    names = {code: [n for n, c in stopwords._CODES.items() if c == code] for code in stopwords.STOPWORDS}
    tests = [
        f"(lower(lang) IN ({', '.join(map(_text, names[code]))}) AND lower({word}) IN ({', '.join(map(_text, sorted(words)))}))"
        for code, words in stopwords.STOPWORDS.items()
    ]
    return f"coalesce({' OR '.join(tests)}, false)"


#: In the order of creation: a body may name those before it.
FUNCTIONS = {
    "token_bag(a ARRAY<STRING>) RETURNS ARRAY<STRUCT<term: STRING, tf: DOUBLE>>": (
        "CASE WHEN size(a) > 0 THEN element_at(transform(array(sort_array(a)), s -> element_at(transform(array("
        "filter(sequence(1, size(s)), i -> i = size(s) OR get(s, i) <> get(s, i - 1))), e -> transform(e, (x, k) -> "
        "named_struct('term', get(s, x - 1), 'tf', CAST(x - CASE WHEN k > 0 THEN get(e, k - 1) ELSE 0 END AS DOUBLE)))), 1)), 1) "
        "ELSE CAST(array() AS ARRAY<STRUCT<term: STRING, tf: DOUBLE>>) END"
    ),
    "strip_accents(x STRING) RETURNS STRING": f"translate(x, {_ACCENTS})",
    "strip_punctuation(x STRING) RETURNS STRING": f"translate(x, {_text(normalize.PUNCTUATION)}, '')",
    "normalize_whitespace(x STRING) RETURNS STRING": f"trim(regexp_replace(x, {_BLANKS}, ' '))",
    "remove_numbers(x STRING) RETURNS STRING": "regexp_replace(x, '[0-9]+', '')",
    "word_tokens(x STRING) RETURNS ARRAY<STRING>": "transform(regexp_extract_all(x, '([A-Za-z0-9]+)', 1), t -> lower(t))",
    "word_ngrams(a ARRAY<STRING>, n INT) RETURNS ARRAY<ARRAY<STRING>>": (
        "CASE WHEN n > 0 AND size(a) >= n THEN transform(sequence(1, size(a) - n + 1), i -> slice(a, i, n)) "
        "WHEN a IS NOT NULL THEN CAST(array() AS ARRAY<ARRAY<STRING>>) END"
    ),
    "token_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": (
        "CASE WHEN size(array_union(a, b)) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END"
    ),
    "token_overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": (
        "CASE WHEN least(size(array_distinct(a)), size(array_distinct(b))) > 0 THEN size(array_intersect(a, b)) "
        "/ least(size(array_distinct(a)), size(array_distinct(b))) ELSE 0D END"
    ),
    "token_cosine(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": (
        # equal terms of both bags are neighbours once these are sorted together
        "coalesce(element_at(transform(array(named_struct('x', token_bag(a), 'y', token_bag(b))), p -> "
        "element_at(transform(array(sort_array(concat(p.x, p.y))), s -> aggregate(transform(s, (e, i) -> "
        "CASE WHEN get(s, i + 1).term = e.term THEN e.tf * get(s, i + 1).tf ELSE 0D END), 0D, (t, v) -> t + v)), 1) "
        "/ nullif(sqrt(aggregate(p.x, 0D, (t, e) -> t + e.tf * e.tf) * aggregate(p.y, 0D, (t, e) -> t + e.tf * e.tf)), 0D)), 1), 0D)"
    ),
    "strip_html(x STRING) RETURNS STRING": f"regexp_replace(x, {_text(normalize.TAG)}, '')",
    "replace_urls(x STRING, to STRING) RETURNS STRING": f"regexp_replace(x, {_text(normalize.URL)}, {_LITERAL})",
    "replace_emails(x STRING, to STRING) RETURNS STRING": f"regexp_replace(x, {_text(normalize.EMAIL)}, {_LITERAL})",
    "whitespace_tokens(x STRING) RETURNS ARRAY<STRING>": (
        f"transform(regexp_extract_all(x, {_text(f'([^{normalize.BLANK}]+)')}, 1), t -> lower(t))"
    ),
    "char_ngrams(x STRING, n INT) RETURNS ARRAY<STRING>": (
        "CASE WHEN n > 0 AND length(x) >= n THEN transform(sequence(1, length(x) - n + 1), i -> substring(lower(x), i, n)) "
        "WHEN x IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END"
    ),
    "sentence_list(x STRING) RETURNS ARRAY<STRING>": (
        f"filter(transform(split(x, {_text(f'(?<=[.!?])(?=[{normalize.BLANK}]|' + chr(92) + 'z)')}), "
        f"s -> btrim(s, {_text(chr(32) + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))})), s -> s <> '')"
    ),
    "is_stop_word(x STRING, lang STRING) RETURNS BOOLEAN": _is_stop_word("x"),
    "remove_stop_words(a ARRAY<STRING>, lang STRING) RETURNS ARRAY<STRING>": f"filter(a, t -> NOT {_is_stop_word('t')})",
    "levenshtein_similarity(a STRING, b STRING) RETURNS DOUBLE": (
        "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in ``spark``'s session; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    python = {"porter_stem": _porter, "smart_stem": _smart, "porter_stems": _porter_all, "smart_stems": _smart_all, "jaro": _jaro}
    for name, fn in python.items():
        spark.udf.register(name, fn)
    return [s.split("(")[0] for s in FUNCTIONS] + list(python)
