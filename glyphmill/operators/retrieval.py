"""Ranked retrieval over postings: raw counts, TF-IDF and BM25.

``fit`` reads the texts once and writes the model's relations to the shared
scratch folder: ``postings (doc_id, doc_len, max_tf, term, tf)``, each file in
the order of its terms, ``terms (term, df, cf, idf)`` and, for cosine models,
``norms (doc_id, norm)``. No posting is shuffled for that unless the terms
outgrow a broadcast; norms look common terms up in a broadcast of bounded size,
so that only the postings of rare terms are shuffled. A model fitted with
``search=False`` has terms alone, which is all that ``transform`` needs. A search joins the query's terms to the postings, so that
documents without any of them are never touched, sums by document and ranks. A
single query's terms are literals that reach the postings' Parquet scan as an
``IN`` filter, which row groups and pages outside their range pass; a table of
queries is joined by term, broadcast by Spark when it is small.

A batch has about as many pairs of queries and documents as both multiply to,
which are neither shuffled nor grouped by Spark: the postings of its terms go to
slices of documents, a slice's pairs are summed in arrays of bounded size, and
each slice gives its best documents for each query, of which the ranks are made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators import corpus
from glyphmill.sources.scratch import materialise
from glyphmill.sources.tables import load_relations, load_settings, save_relations, save_settings

K1, B = 1.2, 0.75
HALF = 0.5
#: Postings that are sorted at once, and terms of a broadcast at most.
RUN, HEAVY = 500_000, 65_536
#: Queries and their terms in a block of a batch, postings of a slice of documents, and pairs that are summed at once.
ASKED, ASKED_TERMS, SLICE, PAIRS = 1024, 65_536, 250_000, 2_000_000
RESULT = "qid long, rank int, doc_id long, score double"


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, q_max, term, qf`` of ``queries (qid, tokens)``."""
    posted = corpus.postings(queries.select(F.col("qid").alias("doc_id"), "tokens"))
    return posted.select(F.col("doc_id").alias("qid"), F.col("max_tf").alias("q_max"), "term", F.col("tf").alias("qf"))


def rank(scores: DataFrame, top_k: int | None, digits: int | None = None) -> DataFrame:
    """``qid, rank, doc_id, score``: positive scores, best first, ties by ``doc_id``.

    With ``digits`` scores are rounded before they are ranked.
    """
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    scores = scores.where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select("qid", "rank", "doc_id", "score")


class _Model:
    """What the three models share."""

    relations: ClassVar[tuple[str, ...]]
    postings: DataFrame
    terms: DataFrame
    num_docs: int

    def _settings(self) -> dict:
        return {"num_docs": self.num_docs}

    def _searchable(self) -> None:
        if self.postings is None:
            raise ValueError("the model was fitted without postings; fit it with search=True")

    def save(self, path: str) -> None:
        self._searchable()
        save_relations(path, **{name: getattr(self, name) for name in self.relations})
        save_settings(self.postings.sparkSession, path, self._settings())

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        return cls(**load_relations(spark, path, *cls.relations), **load_settings(spark, path))

    def scores(self, queries: DataFrame) -> DataFrame:
        """``qid, doc_id, score`` of every pair that shares a term."""
        raise NotImplementedError

    def _asked(self, queries: DataFrame) -> DataFrame:
        """``qid, term, df, w`` of the queries' known terms, with ``idf`` where the postings' weight has it."""
        raise NotImplementedError

    def _weight(self) -> Column:
        """A posting's factor of a score, beside the ``idf`` of its term; the query's factor is ``w``."""
        raise NotImplementedError

    def _idle(self, top_k: int | None) -> bool:
        return (top_k is not None and top_k <= 0) or self.num_docs == 0

    def search_batch(self, queries: DataFrame, top_k: int | None = 5, digits: int | None = None) -> DataFrame:
        """Ranked hits for each row of ``queries (qid, tokens)``."""
        self._searchable()
        if self._idle(top_k):
            return self.postings.sparkSession.createDataFrame([], RESULT)
        norms = getattr(self, "norms", None)
        best = _best_by_slice(self._asked(queries), self.postings, self._weight(), norms, top_k, digits)
        return rank(best, top_k, digits)

    def search(self, tokens: list[str], top_k: int | None = 5, digits: int | None = None) -> DataFrame:
        """Ranked hits for one query: ``rank, doc_id, score``."""
        self._searchable()
        spark = self.postings.sparkSession
        queries = spark.createDataFrame([(0, list(tokens))], "qid long, tokens array<string>")
        if self._idle(top_k):
            return spark.createDataFrame([], RESULT).drop("qid")
        return rank(self._narrowed(sorted(set(tokens))).scores(queries), top_k, digits).drop("qid")

    def _narrowed(self, terms: list[str]):
        """The model with only the postings of some terms, for the scan's filter."""
        own = {field.name: getattr(self, field.name) for field in fields(self)}
        if not terms:
            return self
        return type(self)(**own | {"postings": self.postings.where(F.col("term").isin(*terms))})


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``RUN``, each sorted by term."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN:
            yield from pa.Table.from_batches(held).sort_by("term").to_batches(max_chunksize=50_000)
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).sort_by("term").to_batches(max_chunksize=50_000)


def written_postings(docs: DataFrame) -> DataFrame:
    """The postings of ``docs``, in a table whose files hold runs sorted by term.

    A page of a run covers few terms, as a page of a sorted file does, and no
    task sorts, and so spills, all of its postings.
    """
    posted = corpus.postings(docs)
    return materialise(posted.mapInArrow(_in_runs, posted.schema), "postings")


def _fitted_postings(docs: DataFrame, search: bool) -> tuple[DataFrame | None, DataFrame]:
    """Written postings if they are to be searched, and those to count terms from."""
    written = written_postings(docs) if search else None
    return written, written if search else corpus.term_frequencies(docs)


def _cosine_scores(query: DataFrame, postings: DataFrame, weight: Column, norms: DataFrame) -> DataFrame:
    """``query (qid, term, w, ...)`` against ``postings`` that weigh ``weight``."""
    query = materialise(query, "query")  # of known size, so that a small one is broadcast and no posting shuffled
    q_norms = query.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    dots = query.join(postings, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * weight).alias("dot"))
    return (
        dots.join(q_norms, "qid")
        .join(norms, "doc_id")
        .select("qid", "doc_id", F.try_divide("dot", F.col("q_norm") * F.col("norm")).alias("score"))
    )


def _bounds(scores: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """What ``scores`` are at least and at most when Spark has rounded them, in units of the last digit.

    Both are the same but for scores so near the middle of two that their decimal form decides.
    """
    if digits is None:
        return scores, scores
    scaled = scores * 10.0**digits
    low = np.floor(scaled)
    part = scaled - low
    unsure = (np.abs(part - 0.5) < 1e-3) | (np.abs(scaled) > 1e11)
    return low + ((part > 0.5) & ~unsure), low + ((part > 0.5) | unsure)


class _Held:
    """The candidates for each query's ``top_k`` so far; all of them if that is None."""

    def __init__(self, queries: int, top_k: int | None, digits: int | None) -> None:
        self.top_k, self.digits, self.bar = top_k, digits, np.zeros(queries)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row for each of ``docs`` and a column for each query."""
        low, high = _bounds(scores, self.digits)
        if self.top_k is not None and self.top_k <= len(docs):
            at = len(docs) - self.top_k
            self.bar = np.maximum(self.bar, np.partition(low, at, axis=0)[at])
        row, query = np.nonzero((high >= self.bar) & (high > 0))
        self.parts.append((query, docs[row], scores[row, query], low[row, query], high[row, query]))
        self.size += len(row)
        if self.size > PAIRS:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """The candidates, less those that ``top_k`` others surely precede."""
        query, doc, score, low, high = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keep = np.ones(len(query), "bool")
        if self.top_k is not None:
            sure = np.flatnonzero(low == high)
            order = sure[np.lexsort((doc[sure], -low[sure], query[sure]))]
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
            keep[order] = place < self.top_k
            last = order[place == self.top_k - 1]
            self.bar[query[last]] = np.maximum(self.bar[query[last]], low[last])
            keep &= high >= self.bar[query]
        self.parts = [(query[keep], doc[keep], score[keep], low[keep], high[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _best_of_slice(top_k: int | None, digits: int | None, cosine: bool):
    """A slice's postings ``(doc_id, no, w)`` and a block's queries ``(qid, no, w)``, to ``qid, doc_id, score``.

    Numbers below zero stand for no term: such a row has the document's norm.
    """
    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(_: tuple, postings: pa.Table, asked: pa.Table) -> pa.Table:
        doc, no, w = (postings.column(c).to_numpy() for c in ("doc_id", "no", "w"))
        of_term = no >= 0
        if not of_term.any() or not asked.num_rows:
            return schema.empty_table()
        ids, at = np.unique(doc[of_term], return_inverse=True)
        norm_of, norm = doc[~of_term], w[~of_term]
        # in the order of the terms, so that equal documents get equal sums
        order = np.lexsort((no[of_term], at))
        at, no, w = at[order], no[of_term][order], w[of_term][order]
        qids, query = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
        asked_no, asked_w = asked.column("no").to_numpy(), asked.column("w").to_numpy()
        q_norm = np.sqrt(np.bincount(query, asked_w * asked_w))
        order = np.lexsort((query, asked_no))
        query, asked_no, asked_w = query[order], asked_no[order], asked_w[order]
        begins = np.searchsorted(asked_no, np.arange(int(no.max()) + 2))
        times, begins = np.diff(begins)[no], begins[no]
        rows = np.searchsorted(at, np.arange(len(ids) + 1))
        pairs = np.concatenate([[0], np.cumsum(times)])[rows]
        if cosine:
            order = np.argsort(norm_of)
            norm_of, norm = norm_of[order], norm[order]
            place = np.minimum(np.searchsorted(norm_of, ids), max(len(norm_of) - 1, 0))
            own_norm = np.where(norm_of[place] == ids, norm[place], 0.0) if len(norm_of) else np.zeros(len(ids))
        held, begin = _Held(len(qids), top_k, digits), 0
        while begin < len(ids):
            end = int(np.searchsorted(pairs, pairs[begin] + PAIRS, side="right")) - 1
            end = max(begin + 1, min(end, begin + PAIRS // len(qids)))
            part = slice(rows[begin], rows[end])
            n = times[part]
            which = np.repeat(np.arange(part.start, part.stop), n)
            of_query = np.arange(len(which)) + np.repeat(begins[part] - np.cumsum(n) + n, n)
            cell = (at[which] - begin) * len(qids) + query[of_query]
            scores = np.bincount(cell, w[which] * asked_w[of_query], (end - begin) * len(qids)).reshape(-1, len(qids))
            if cosine:
                over = own_norm[begin:end, None] * q_norm
                scores = np.divide(scores, over, out=np.zeros_like(scores), where=over > 0)
            held.add(ids[begin:end], scores)
            begin = end
        query, doc, score, _low, _high = held.prune()
        return pa.table([pa.array(qids[query]), pa.array(doc), pa.array(score)], schema=schema)

    return run


def _best_by_slice(
    asked: DataFrame, postings: DataFrame, weight: Column, norms: DataFrame | None, top_k: int | None, digits: int | None
) -> DataFrame:
    """``qid, doc_id, score``: all that may be among the ``top_k`` of its query.

    Queries are in blocks, and each block has slices of documents enough that one
    has about ``SLICE`` postings of the block's terms.
    """
    spark = postings.sparkSession
    asked = materialise(asked, "query")
    queries, terms = asked.agg(F.count_distinct("qid"), F.count(F.lit(1))).first()
    blocks = max(1, -(-queries // ASKED), -(-terms // ASKED_TERMS))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    no = F.dense_rank().over(Window.partitionBy("block").orderBy("term")) - 1
    asked = asked.withColumn("block", block).withColumn("no", no)
    whole = F.sum("df").over(Window.partitionBy("block"))
    idf = [c for c in asked.columns if c == "idf"]
    needed = asked.select("block", "no", "term", "df", *idf).distinct()
    needed = needed.withColumn("slices", F.ceil(whole / F.lit(SLICE)).cast("int")).drop("df")
    needed = materialise(needed, "asked")  # of known size, so that a small one is broadcast and no posting shuffled
    sizes = needed.select("block", "slices").distinct()
    cells = sizes.agg(F.sum("slices")).first()[0]
    if not cells:
        return spark.createDataFrame([], "qid long, doc_id long, score double")
    own = F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int").alias("slice")
    rows = postings.where("doc_id IS NOT NULL").join(needed, "term").select("block", own, "doc_id", "no", weight.alias("w"))
    if norms is not None:
        beside = norms.where("doc_id IS NOT NULL").join(F.broadcast(sizes), F.lit(True))  # a row a block
        rows = rows.unionByName(beside.select("block", own, "doc_id", F.lit(-1).alias("no"), F.col("norm").alias("w")))
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("of_slice")
    beside = asked.join(F.broadcast(sizes), "block").select(F.col("block").alias("of_block"), each, "qid", "no", "w")
    # a slice is much work for its bytes: a partition each, up to 4,096, which adaptive execution leaves as they are
    parts = min(4096, cells)
    left, right = rows.repartition(parts, "block", "slice"), beside.repartition(parts, "of_block", "of_slice")
    grouped = left.groupBy("block", "slice").cogroup(right.groupBy("of_block", "of_slice"))
    return grouped.applyInArrow(_best_of_slice(top_k, digits, norms is not None), "qid long, doc_id long, score double")


def _with_idf(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``postings`` with the ``idf`` of their terms.

    The commonest terms, by powers of two of ``df`` and ``HEAVY`` at most, are
    broadcast; the postings of the others are joined by term.
    """
    power = F.floor(F.log2(F.col("df").cast("double"))).cast("int")
    powers = terms.groupBy(power.alias("power")).count().collect()  # one row for each power of two
    held, least = 0, 64
    for row in sorted(powers, key=lambda r: -r["power"]):
        held += row["count"]
        if held > HEAVY:
            break
        least = row["power"]
    idf = terms.select("term", "idf")
    common, rare = (idf.where((power >= least) if heavy else (power < least)) for heavy in (True, False))
    marked = postings.join(F.broadcast(common), "term", "left")
    rest = marked.where("idf IS NULL").drop("idf").join(rare, "term")
    return marked.where("idf IS NOT NULL").unionByName(rest)


def _norms(postings: DataFrame, weight: Column) -> DataFrame:
    return materialise(postings.groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm")), "norms")


@dataclass
class CountModel(_Model):
    """Bag-of-words counts with cosine search."""

    relations: ClassVar[tuple[str, ...]] = ("postings", "terms", "norms")
    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    num_docs: int

    @classmethod
    def fit(cls, docs: DataFrame, search: bool = True) -> CountModel:
        written, posted = _fitted_postings(docs, search)
        terms = materialise(corpus.term_stats(posted), "terms")
        norms = _norms(written, F.col("tf").cast("double")) if search else None
        return cls(written, terms, norms, docs.count())

    def transform(self, docs: DataFrame) -> DataFrame:
        """``doc_id, term, weight``: counts of the terms that the model knows."""
        return (
            corpus.term_frequencies(docs)
            .join(self.terms.select("term"), "term", "left_semi")
            .select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
        )

    def _asked(self, queries: DataFrame) -> DataFrame:
        known = query_terms(queries).join(self.terms.select("term", "df"), "term")
        return known.select("qid", "term", "df", F.col("qf").cast("double").alias("w"))

    def _weight(self) -> Column:
        return F.col("tf").cast("double")

    def scores(self, queries: DataFrame) -> DataFrame:
        return _cosine_scores(self._asked(queries), self.postings, self._weight(), self.norms)


def augmented_weight(tf: Column, max_tf: Column, idf: Column) -> Column:
    return (0.5 + 0.5 * (tf.cast("double") / max_tf)) * idf


@dataclass
class TfidfModel(_Model):
    """Augmented term frequency times smoothed idf, with cosine search."""

    relations: ClassVar[tuple[str, ...]] = ("postings", "terms", "norms")
    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    num_docs: int

    @classmethod
    def fit(cls, docs: DataFrame, search: bool = True) -> TfidfModel:
        n = docs.count()
        written, posted = _fitted_postings(docs, search)
        terms = corpus.term_stats(posted).withColumn("idf", corpus.idf_smoothed(F.col("df"), F.lit(n)))
        terms = materialise(terms, "terms")
        weight = augmented_weight(F.col("tf"), F.col("max_tf"), F.col("idf"))
        return cls(written, terms, _norms(_with_idf(written, terms), weight) if search else None, n)

    def _weighted(self, rows: DataFrame, tf: str, top: str) -> DataFrame:
        weight = augmented_weight(F.col(tf), F.col(top), F.col("idf"))
        return rows.join(self.terms.select("term", "df", "idf"), "term").withColumn("w", weight)

    def transform(self, docs: DataFrame) -> DataFrame:
        """``doc_id, term, weight``; unknown terms count in a document's maximum only."""
        rows = self._weighted(corpus.postings(docs), "tf", "max_tf")
        return rows.select("doc_id", "term", F.col("w").alias("weight"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self._weighted(query_terms(queries), "qf", "q_max").select("qid", "term", "df", "idf", "w")

    def _weight(self) -> Column:
        return augmented_weight(F.col("tf"), F.col("max_tf"), F.col("idf"))

    def scores(self, queries: DataFrame) -> DataFrame:
        return _cosine_scores(self._asked(queries), self.postings, self._weight(), self.norms)


@dataclass
class Bm25Model(_Model):
    """BM25 with a positive idf and saturated query frequencies."""

    relations: ClassVar[tuple[str, ...]] = ("postings", "terms")
    postings: DataFrame
    terms: DataFrame
    num_docs: int
    avg_len: float
    k1: float = K1
    b: float = B

    @classmethod
    def fit(cls, docs: DataFrame) -> Bm25Model:
        """Empty documents count in the number of documents and in the mean length."""
        num_docs = docs.count()
        posted = written_postings(docs)
        n = F.lit(float(num_docs))
        d = F.least(F.col("df").cast("double"), n)
        with_it, without = d + HALF, n - d + HALF
        terms = materialise(corpus.term_stats(posted).withColumn("idf", F.log1p(without / with_it)), "terms")
        tokens = terms.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
        return cls(posted, terms, num_docs, tokens / num_docs if num_docs else 0.0)

    def _settings(self) -> dict:
        return {"num_docs": self.num_docs, "avg_len": self.avg_len}

    def with_parameters(self, k1: float = K1, b: float = B) -> Bm25Model:
        if not k1 >= 0 or not 0 <= b <= 1 or math.isinf(k1):
            raise ValueError("k1 must not be negative and b must be from 0 to 1")
        return Bm25Model(self.postings, self.terms, self.num_docs, self.avg_len, k1, b)

    def search(self, tokens, top_k=5, digits=None, k1=None, b=None) -> DataFrame:
        """As for the other models; nothing to search precedes the check of ``k1`` and ``b``."""
        idle = not tokens or (top_k is not None and top_k <= 0) or not self.num_docs or not self.avg_len
        if idle:
            return self.postings.sparkSession.createDataFrame([], RESULT).drop("qid")
        own = self.with_parameters(self.k1 if k1 is None else k1, self.b if b is None else b)
        return super(Bm25Model, own).search(tokens, top_k, digits)

    def _idle(self, top_k: int | None) -> bool:
        return super()._idle(top_k) or not self.avg_len

    def _asked(self, queries: DataFrame) -> DataFrame:
        qf, k1 = F.col("qf").cast("double"), F.lit(float(self.k1))
        known = query_terms(queries).join(self.terms.select("term", "df", "idf"), "term")
        return known.select("qid", "term", "df", "idf", ((qf * (k1 + 1)) / (qf + k1)).alias("w"))

    def _weight(self) -> Column:
        k1, b, tf = F.lit(float(self.k1)), F.lit(float(self.b)), F.col("tf").cast("double")
        length = 1 - b + b * (F.col("doc_len") / F.lit(self.avg_len))
        return F.col("idf") * (tf * (k1 + 1)) / (tf + k1 * length)

    def scores(self, queries: DataFrame) -> DataFrame:
        if not self.avg_len:
            return self.postings.sparkSession.createDataFrame([], "qid long, doc_id long, score double")
        query = materialise(self._asked(queries), "query")
        return (
            query.join(self.postings.select("doc_id", "doc_len", "term", "tf"), "term")
            .groupBy("qid", "doc_id")
            .agg(F.sum(self._weight() * F.col("w")).alias("score"))
        )
