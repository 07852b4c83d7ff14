"""Corpus relations and aggregations.

A corpus is ``docs(doc_id, tokens array<string>)``, one row a document; null
tokens count as none. A document's own term counts are computed inside its row,
by sorting its tokens and measuring runs, so that postings need no shuffle;
only per-term and corpus-wide figures do, after map-side combining.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from glyphmill.functions.tokenize import windows
from glyphmill.sources.scratch import materialise

_NO_COUNTS = "array<struct<term:string,tf:bigint>>"
BLOCK = 1 << 15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row even if named in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_nulls(tokens: Column) -> Column:
    return F.coalesce(tokens, F.array().cast("array<string>"))


def sorted_runs(ordered: Column, kind: str = _NO_COUNTS) -> Column:
    """``array<struct<term, tf>>`` of equal neighbours."""
    n = F.size(ordered)

    def at_end(i: Column) -> Column:
        return (i == n) | (F.get(ordered, i) != F.get(ordered, i - 1))

    def counted(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda e, k: F.struct(
                F.get(ordered, e - 1).alias("term"),
                (e - F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0))).cast("long").alias("tf"),
            ),
        )

    return F.when(n > 0, let(F.filter(F.sequence(F.lit(1), n), at_end), counted)).otherwise(F.array().cast(kind))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, in byte order of the terms."""
    return let(F.sort_array(no_nulls(tokens)), lambda t: sorted_runs(t))


def count_items(rows: DataFrame, key: str, name: str = "cnt") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def inlined(rows: DataFrame, counts: Column, *columns: str | Column) -> DataFrame:
    """``columns`` beside each entry of an array of ``struct<term, tf>``.

    An inner generator would have Catalyst filter empty arrays out below it, and
    so compute the array a second time; the outer one's rows without an entry
    are filtered out above instead.
    """
    return rows.select(*columns, F.inline_outer(counts)).where("tf IS NOT NULL")


def exploded(rows: DataFrame, items: Column, name: str, *columns: str | Column) -> DataFrame:
    """``columns`` beside each item of an array, which is computed once as in ``inlined``."""
    kept = rows.select(*columns, F.posexplode_outer(items).alias("_pos", name)).where("_pos IS NOT NULL")
    return kept.drop("_pos")


def placed(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, term`` of every token."""
    places = F.posexplode_outer(no_nulls(F.col("tokens"))).alias("pos", "term")
    return docs.select("doc_id", places).where("pos IS NOT NULL")


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``doc_id, term, tf``."""
    return inlined(docs, term_counts(F.col("tokens")), "doc_id")


def with_counts(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` with ``_counts`` and ``max_tf`` of each row's tokens.

    Both come out of one struct made per row: an expression left above an
    explode would be computed again for every exploded row.
    """
    top = let(
        term_counts(F.col("tokens")),
        lambda c: F.struct(c.alias("counts"), F.array_max(F.transform(c, lambda x: x["tf"])).alias("top")),
    )
    held = docs.select(*columns, top.alias("_held"))
    rest = [c for c in held.columns if c != "_held"]
    return held.select(*rest, F.col("_held.top").alias("max_tf"), F.col("_held.counts").alias("_counts"))


def postings(docs: DataFrame) -> DataFrame:
    """``doc_id, doc_len, max_tf, term, tf``, without a shuffle."""
    size = F.size(no_nulls(F.col("tokens"))).cast("long").alias("doc_len")
    return inlined(with_counts(docs, "doc_id", size), F.col("_counts"), "doc_id", "doc_len", "max_tf")


def document_frequency(docs: DataFrame) -> DataFrame:
    """``term, df``."""
    return count_items(exploded(docs, F.array_distinct(no_nulls(F.col("tokens"))), "term"), "term", "df")


def term_stats(posted: DataFrame) -> DataFrame:
    """``term, df, cf`` of postings."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: ``num_docs, avg_len``; empty documents count."""
    size = F.size(no_nulls(F.col("tokens")))
    return docs.agg(
        F.count(F.lit(1)).alias("num_docs"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len")
    )


def idf_smoothed(df: Column, num_docs: Column) -> Column:
    """``ln(1 + N / df)``, zero where no document has the term."""
    return F.when(df > 0, F.log1p(F.try_divide(num_docs.cast("double"), df))).otherwise(F.lit(0.0))


def idf(docs: DataFrame) -> DataFrame:
    """``term, df, idf``."""
    stats = F.broadcast(corpus_stats(docs).select("num_docs"))  # one row
    return (
        document_frequency(docs)
        .join(stats, F.lit(True))
        .select("term", "df", idf_smoothed(F.col("df"), F.col("num_docs")).alias("idf"))
    )


def sorted_terms(freqs: DataFrame, count: str = "cnt") -> DataFrame:
    """Frequency first, then byte order of the term."""
    return freqs.orderBy(F.desc(count), F.asc("term"))


def unique_terms(docs: DataFrame) -> DataFrame:
    return exploded(docs, no_nulls(F.col("tokens")), "term").distinct()


def with_previous(rows: DataFrame, key: str, item: str) -> DataFrame:
    """``key, item, other``: each row beside the ``item`` of the row whose whole-number ``key`` is one less.

    Rows are shuffled once, by slices of 1,024 keys, and the last key of a
    slice goes to the next slice as well; a join would make, shuffle and sort them twice.
    """
    own = F.shiftright(key, 10)
    last = F.col(key).bitwiseAND(F.lit(1023)) == 1023
    slices = F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own)))
    sent = rows.where(F.col(key).isNotNull()).select(key, item, slices.alias("_slice"))
    before = F.collect_list(F.struct(F.col(item).alias("other"))).over(Window.partitionBy("_slice").orderBy(key).rangeBetween(-1, -1))
    held = sent.withColumn("_before", before).where(own == F.col("_slice"))
    return held.select(key, item, F.inline("_before"))


def vocabulary_first_seen(docs: DataFrame) -> DataFrame:
    """``term, first_doc, first_pos``: where each term occurs first, by document and position.

    A place is one decimal: the least of structs would have all tokens sorted.
    """
    at = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")
    first = placed(docs).select("term", at.cast("decimal(38,0)").alias("at")).groupBy("term").agg(F.min("at").alias("at"))
    pos = F.pmod("at", F.lit(1 << 31).cast("decimal(38,0)"))
    return first.select(
        "term", F.floor((F.col("at") - pos) / F.lit(1 << 31)).cast("long").alias("first_doc"), pos.cast("int").alias("first_pos")
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    """``term, term_id``: ids by first occurrence, from 0.

    First occurrences are ranked inside slices of 1,024 document numbers, and
    the slices' totals are summed in two steps, inside blocks of ``BLOCK``
    slices and over the blocks, so that a task holds a block and never a table.
    """
    first = vocabulary_first_seen(docs)
    inside = Window.partitionBy("slice").orderBy("first_doc", "first_pos")
    ranked = first.withColumn("slice", F.shiftright("first_doc", 10)).withColumn("rank", F.row_number().over(inside))
    totals = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.expr(f"slice div {BLOCK}"))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    before = blocks.select("block", F.coalesce(F.sum("n").over(_ahead(Window.orderBy("block"))), F.lit(0)).alias("base"))
    within = _ahead(Window.partitionBy("block").orderBy("slice"))
    starts = totals.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(before, "block")
    starts = starts.select("slice", (F.col("base") + F.col("own")).alias("start"))
    return ranked.join(starts, "slice").select("term", (F.col("start") + F.col("rank") - 1).alias("term_id"))


def _ahead(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def extend_vocabulary(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """``vocab`` with the terms of further documents, numbered on by first occurrence."""
    vocab = materialise(vocab.select("term", "term_id"), "vocabulary")  # it is read three times
    new = placed(docs).join(vocab.select("term"), "term", "left_anti")
    held = new.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    own = held.select("doc_id", F.transform("t", lambda x: x["term"]).alias("tokens"))
    size = F.broadcast(vocab.agg((F.coalesce(F.max("term_id"), F.lit(-1)) + 1).alias("size")))  # one row
    added = vocabulary(own).join(size, F.lit(True)).select("term", (F.col("term_id") + F.col("size")).alias("term_id"))
    return vocab.select("term", "term_id").unionByName(added)


def lookup_terms(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """``ids (term_id)`` with ``term``, empty for unknown ones."""
    return ids.join(vocab, "term_id", "left").withColumn("term", F.coalesce("term", F.lit("")))


def contains_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``terms`` with ``known``."""
    return terms.join(vocab.select("term", F.lit(True).alias("known")), "term", "left").fillna(False, ["known"])


def contains_ids(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """``ids`` with ``known``."""
    return ids.join(vocab.select("term_id", F.lit(True).alias("known")), "term_id", "left").fillna(False, ["known"])


def lookup_ids(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``terms`` with ``term_id``, -1 for unknown ones."""
    return terms.join(vocab, "term", "left").withColumn("term_id", F.coalesce("term_id", F.lit(-1)).cast("long"))


def text_stats(docs: DataFrame) -> DataFrame:
    """Token statistics of each document, computed inside its row."""
    tokens = no_nulls(F.col("tokens"))

    def stats(counts: Column) -> Column:
        n, size = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["tf"]), F.size(counts)
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["tf"] * F.octet_length(x["term"]))
        # the first in byte order of those with the most occurrences
        best = F.aggregate(
            counts,
            F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")),
            lambda a, x: F.when(x["tf"] > a["tf"], x).otherwise(a),
        )
        return F.struct(
            n.alias("num_tokens"),
            size.cast("long").alias("num_unique_terms"),
            F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("avg_token_length"),
            F.coalesce(F.try_divide(size, n), F.lit(0.0)).alias("vocabulary_richness"),
            F.size(F.filter(counts, lambda x: x["tf"] == 1)).cast("long").alias("hapax_legomena"),
            best["term"].alias("top_term"),
        )

    return docs.select("doc_id", let(term_counts(tokens), stats).alias("_stats")).select("doc_id", "_stats.*")


def keyword_scores(docs: DataFrame, method: str = "tfidf", by: list[str] | None = None) -> DataFrame:
    """``[by,] term, score`` of every term of the corpus, or of each group of ``by``."""
    by = by or []
    if method.lower() == "freq":
        terms = exploded(docs, no_nulls(F.col("tokens")), "term", *by)
        return terms.groupBy(*by, "term").agg(F.count(F.lit(1)).cast("double").alias("score"))
    if method.lower() != "tfidf":
        return docs.select(*by, F.lit("").alias("term"), F.lit(0.0).alias("score")).limit(0)
    posted = inlined(with_counts(docs, *by), F.col("_counts"), *by, "max_tf")
    weight = 0.5 + 0.5 * F.try_divide(F.col("tf").cast("double"), F.col("max_tf"))
    # the idf is the same for all of a term's documents: one aggregation has both
    sums = posted.groupBy(*by, "term").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("df"))
    sizes = F.broadcast(docs.agg(F.count(F.lit(1)).alias("num_docs"))) if not by else docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_docs")
    )
    joined = sums.join(sizes, by) if by else sums.join(sizes, F.lit(True))
    return joined.select(*by, "term", (F.col("weight") * idf_smoothed(F.col("df"), F.col("num_docs"))).alias("score"))


def top_scored(scores: DataFrame, n: int, key: str = "term", by: list[str] | None = None) -> DataFrame:
    """The ``n`` best by ``score``, then by key; per group of ``by`` if given."""
    if n <= 0:
        return scores.limit(0)
    if not by:
        return scores.orderBy(F.desc("score"), F.asc(key)).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def extract_keywords(docs: DataFrame, top_n: int = 10, method: str = "tfidf", by: list[str] | None = None) -> DataFrame:
    return top_scored(keyword_scores(docs, method, by), top_n, "term", by)


def ngram_frequencies(docs: DataFrame, n: int) -> DataFrame:
    """``gram array<string>, cnt`` over the corpus."""
    return count_items(exploded(docs, windows(F.col("tokens"), n), "gram"), "gram")


def joined_ngram_frequencies(docs: DataFrame, n: int, sep: str = " ") -> DataFrame:
    """``gram string, cnt``: as ``ngram_frequencies`` where no token is null or has ``sep``; strings are grouped faster than arrays."""
    if n <= 0:
        return docs.select(F.lit("").alias("gram"), F.lit(0).cast("long").alias("cnt")).limit(0)
    many = F.greatest(F.size("tokens") - (n - 1), F.lit(0))
    # columns of tokens, which are joined behind the generator: in compiled code, and not in a lambda
    parts = [F.slice("tokens", k + 1, many).alias(f"_{k}") for k in range(n)]
    grams = docs.select(F.inline_outer(F.arrays_zip(*parts))).toDF(*[f"_{k}" for k in range(n)]).where("_0 IS NOT NULL")
    return count_items(grams.select(F.concat_ws(sep, *grams.columns).alias("gram")), "gram")


def top_ngrams(docs: DataFrame, n: int, k: int = 10) -> DataFrame:
    """Most frequent n-grams; ties go by the tokens joined with a unit separator."""
    if k <= 0:
        return ngram_frequencies(docs, n).limit(0)
    return ngram_frequencies(docs, n).orderBy(F.desc("cnt"), F.array_join("gram", "\x1f")).limit(k)


def document_ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, term, tf`` where a term is an n-gram joined with a unit separator."""
    grams = F.transform(windows(F.col("tokens"), n), lambda g: F.array_join(g, "\x1f"))
    return term_frequencies(docs.select("doc_id", grams.alias("tokens")))
