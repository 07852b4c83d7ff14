"""Topic coherence from document-level co-occurrence.

Only pairs of candidate terms are counted: documents are first cut down to the
candidates, which are a few per topic, and pairs are then formed inside each
document's row. Pairs that never meet come from the candidate pairs and count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators import corpus
from glyphmill.operators.topics import LdaModel
from glyphmill.sources.scratch import materialise

TINY = 1e-12
FLOOR = -10.0


def sorted_pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def held_candidates(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``doc_id, terms``: the candidates (column ``term``) of the documents that hold any, sorted."""
    wanted = candidates.select("term").distinct()
    terms = corpus.exploded(docs, F.array_distinct(corpus.no_nulls(F.col("tokens"))), "term", "doc_id")
    met = terms.join(wanted, "term", "left_semi")
    return met.groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def document_frequencies(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``term, df`` of the candidates."""
    return _frequencies(held_candidates(docs, candidates))


def cooccurrence(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``a, b, co`` with ``a < b``: documents that hold both of two candidates."""
    return _cooccurrence(held_candidates(docs, candidates))


def _frequencies(held: DataFrame) -> DataFrame:
    return corpus.count_items(held.select(F.explode("terms").alias("term")), "term", "df")


def _cooccurrence(held: DataFrame) -> DataFrame:
    pairs = F.flatten(
        F.transform(
            "terms",
            lambda x, i: F.transform(
                F.slice("terms", i + 2, F.size("terms")), lambda y: F.struct(x.alias("a"), y.alias("b"))
            ),
        )
    )
    return held.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("co"))


def pmi(co: Column, df_a: Column, df_b: Column, docs: Column) -> Column:
    """Pointwise mutual information, floored where a probability vanishes."""
    n = F.greatest(docs, F.lit(1)).cast("double")
    ab, a, b = co / n, df_a / n, df_b / n
    return F.when(F.least(ab, a, b) <= TINY, F.lit(FLOOR)).otherwise(F.log(ab / (a * b)))


def umass(co: Column, df_j: Column, eps: float = TINY) -> Column:
    return F.log((co + eps) / F.greatest(F.lit(eps), df_j.cast("double")))


def _scored_pairs(terms: DataFrame, dfs: DataFrame, cos: DataFrame) -> DataFrame:
    """Ordered pairs of each topic's ``terms (topic, rank, term)`` with their counts.

    ``i`` is the lower-ranked term, ``j`` the higher-ranked.
    """
    i = terms.select("topic", F.col("rank").alias("i_rank"), F.col("term").alias("i"))
    j = terms.select("topic", F.col("rank").alias("j_rank"), F.col("term").alias("j"))
    both = i.join(j, "topic").where("i_rank > j_rank")
    both = both.withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j"))
    named = dfs.select(F.col("term").alias("i"), F.col("df").alias("df_i"))
    other = dfs.select(F.col("term").alias("j"), F.col("df").alias("df_j"))
    return (
        both.join(cos, ["a", "b"], "left")
        .join(named, "i", "left")
        .join(other, "j", "left")
        .fillna(0, ["co", "df_i", "df_j"])
    )


def pair_scores(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """``topic, i, j, co, df_i, df_j, pmi, umass`` for ``terms (topic, rank, term)``.

    The terms and the documents' candidates are written once, so that the
    texts are read once for both counts.
    """
    size = F.broadcast(docs.agg(F.count(F.lit(1)).alias("num_docs")))  # one row
    terms = materialise(terms, "topic-terms")
    held = materialise(held_candidates(docs, terms), "topic-candidates")
    pairs = _scored_pairs(terms, _frequencies(held), _cooccurrence(held))
    return pairs.join(size, F.lit(True)).select(
        "topic", "i", "j", "i_rank", "j_rank", "co", "df_i", "df_j",
        pmi(F.col("co"), F.col("df_i"), F.col("df_j"), F.col("num_docs")).alias("pmi"),
        umass(F.col("co"), F.col("df_j")).alias("umass"),
    )


def mean_pmi(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``topic, term, mean_pmi`` to each other term of the topic; 0 if alone."""
    each = pairs.select("topic", F.explode(F.array("i", "j")).alias("term"), "pmi")
    means = each.groupBy("topic", "term").agg(F.avg("pmi").alias("mean_pmi"))
    return terms.join(means, ["topic", "term"], "left").withColumn("mean_pmi", F.coalesce("mean_pmi", F.lit(0.0)))


def mean_pairwise_pmi(pairs: DataFrame) -> DataFrame:
    """``topic, pmi``."""
    return pairs.groupBy("topic").agg(F.avg("pmi").alias("pmi"))


def normalize_unit(scores: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Min-max to [0, 1] in each group of ``by``; a constant group is at a half."""
    w = Window.partitionBy(*by)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return scores.withColumn(name, F.when(span <= TINY, F.lit(0.5)).otherwise((F.col(value) - low) / span))


def top_terms_by_pmi(model: LdaModel, docs: DataFrame, n: int = 10, pool: int = 20, digits: int | None = None) -> DataFrame:
    """``topic, rank, term, p``: a pool of the best terms, ranked anew by half weight and half PMI."""
    best = materialise(model.top_terms(max(n, pool), digits), "topic-pool")
    if n <= 0 or docs.isEmpty():
        return best.where(F.col("rank") <= n)
    scored = normalize_unit(mean_pmi(best, pair_scores(best, docs)), "mean_pmi", ["topic"], "unit")
    blend = 0.5 * F.col("p") + 0.5 * F.col("unit")
    blend = F.round(blend, digits) if digits is not None else blend
    w = Window.partitionBy("topic").orderBy(F.desc("blend"), F.asc("term"))
    ranked = scored.withColumn("blend", blend).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n).select("topic", "rank", "term", "p")


def coherence_umass(model: LdaModel, docs: DataFrame, top_n: int = 10, digits: int | None = None) -> DataFrame:
    """One row: the mean over all pairs of all topics."""
    pairs = pair_scores(model.top_terms(top_n, digits), docs)
    return pairs.agg(F.coalesce(F.avg("umass"), F.lit(0.0)).alias("coherence"))


def coherence_cv(model: LdaModel, docs: DataFrame, top_n: int = 10, digits: int | None = None) -> DataFrame:
    """One row: the mean over topics of their mean pairwise PMI."""
    pairs = pair_scores(model.top_terms(top_n, digits), docs)
    return mean_pairwise_pmi(pairs).agg(F.coalesce(F.avg("pmi"), F.lit(0.0)).alias("coherence"))
