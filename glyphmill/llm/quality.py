"""Quality rules with host-level verdicts (native: DataFrame operations only).

A document fails its base rules when it has too few words or too many of its
words lie in repeated windows. Failures are counted per host, each host's rate
is shrunk towards the corpus by a beta prior whose two parameters are fitted to
the hosts' rates by moments, and a host whose shrunk rate exceeds
``max_host_rate`` takes all of its documents with it.

Everything of a document is computed where it lies; only ``(host, failed)``
counts and narrow rows are shuffled.

Defined results: null and empty texts have no words and fail; a null host has
no verdict, so that its documents stand by their own rules; repeated rows are
judged alike; an empty table gives an empty result; further columns of the
input, whatever their names, are ignored by verdicts and kept by ``passing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._tables import boxed, lookup, materialise, unboxed
from glyphmill.operators.corpus import let

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_HOST_RATE = 0.6
HOSTS = 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes within one text. Only texts in which
    some hash repeats are sorted; a sorted pass then finds the repeated
    windows' positions, whose union of spans is summed from neighbours' gaps.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1

        def again(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"])
            return before | ((k < last) & (F.get(sorted_, k + 1)["h"] == x["h"]))

        at = F.array_sort(F.transform(F.filter(sorted_, again), lambda x: x["i"]))
        return let(
            at,
            lambda p: F.aggregate(
                F.transform(p, lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda a, v: a + v,
            ),
        )

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(let(hashes, repeats))


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with the base measures and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    per_row = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    rows = docs.select(
        *columns,
        per_row.alias("_m"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    rows = rows.select(
        *columns, "_m.n_words", "_m.word_chars", "n_symbols", "n_dup_lines", "_m.n_repeat_words"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n, rate, host_ok`` from rows with ``base_failed``.

    ``rate`` is ``(failures + a) / (n + a + b)`` with ``a`` and ``b`` fitted to
    mean and variance of the hosts' rates; without spread between hosts the
    prior weighs as one document at the mean.
    """
    hosts = (
        rows.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    )
    hosts = hosts.withColumn("raw", F.col("bad") / F.col("n"))
    fit = hosts.agg(F.avg("raw").alias("m"), F.coalesce(F.var_samp("raw"), F.lit(0.0)).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.lit(1.0)).alias("w")
    )
    rate = (F.col("bad") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    # the prior is one row
    return hosts.join(F.broadcast(fit), F.lit(True)).select(
        host, "n", rate.alias("rate"), (rate <= max_rate).alias("host_ok")
    )


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id``, measures, ``base_failed``, ``host_rate`` and ``kept`` for every row."""
    rows = materialise(measured(docs, ["doc_id", host]), "quality")
    verdicts = materialise(host_verdicts(rows, host, max_rate), "quality-hosts")
    out = lookup(rows, verdicts, host, ["rate", "host_ok"], "n", rows.count())
    kept = ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))
    return out.select("doc_id", *MEASURES, "base_failed", F.col("rate").alias("host_rate"), kept.alias("kept"))


def passing(
    docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, hosts: int = HOSTS
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows are written once with their verdict, as the hosts' rates are needed
    before any row can pass and the measures cost more than the copy. Rejected
    hosts meet them in a broadcast while there are at most ``HOSTS`` of them,
    else hot hosts are broadcast and the rest joined by host.
    """
    held = boxed(docs, "doc_id", "text", host).withColumnRenamed(host, "host")
    rows = materialise(
        measured(held, ["own", "doc_id", "host"]).select("own", "doc_id", "host", "n_words", "base_failed"),
        "quality-docs",
    )
    verdicts = materialise(host_verdicts(rows, "host", max_rate), "quality-hosts")
    rejected = verdicts.where(~F.col("host_ok"))
    left = rows.where(~F.col("base_failed"))
    if rejected.count() <= hosts:
        names = F.broadcast(rejected.select("host"))  # at most ``hosts`` rows
        return unboxed(left.join(names, "host", "left_anti"), docs)
    total = verdicts.agg(F.sum("n")).first()[0]
    judged = lookup(left, verdicts, "host", ["host_ok"], "n", total, salted_by=["doc_id", "n_words"])
    return unboxed(judged.where(F.coalesce(F.col("host_ok"), F.lit(True))), docs)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i:i + 7] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(t, chr(10))) AS x)
          WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad, sum(base_failed::INT) / count(*) AS raw
      FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(raw) AS mean,
             CASE WHEN coalesce(var_samp(raw), 0) > 0
                  THEN greatest(1.0, avg(raw) * (1 - avg(raw)) / var_samp(raw) - 1) ELSE 1.0 END AS w FROM h),
v AS (SELECT source, (bad + mean * w) / (n + w) <= 0.6 AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN v USING (source)
"""


def query(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept")
