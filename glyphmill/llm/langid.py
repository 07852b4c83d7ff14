"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are gathered by the executors from at most about
``sample`` labelled documents per language (a hash of the id decides); the
matrix of log-probabilities, buckets x languages, is broadcast. Scoring hashes
whole texts in numpy and sums the rows of the matrix that a text's n-grams
name, as a sparse product.

Defined results: null text, or text without a letter, is ``und`` with score 0;
ties go to the first language in byte order; texts of any length are scored in
slices; with no labelled document at all every prediction is ``und``; labels of
fewer than ``min_support`` documents are not learned, and more than
``MAX_LABELS`` others are refused, as the matrix grows with them; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = 3
SAMPLE = 3000
SLICE = 1 << 19
UNKNOWN = "und"
MAX_LABELS = 256


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(codes, first, doc)`` of bounded slices: ``first`` has where each piece begins.

    Each piece ends with up to ``ORDERS - 1`` characters of what follows it, or
    with zeros at the text's end, so that every n-gram is met exactly once.
    """
    held: list[np.ndarray] = []
    firsts: list[int] = []
    docs: list[int] = []
    size = 0
    for d, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        codes = np.concatenate([codes, np.zeros(ORDERS - 1, np.uint32)])
        for at in range(0, max(1, len(codes) - ORDERS + 1), SLICE):
            piece = codes[at : at + SLICE + ORDERS - 1]
            held.append(piece)
            firsts.append(size)
            docs.append(d)
            size += len(piece)
            if size >= SLICE:
                yield np.concatenate(held), np.asarray(firsts), np.asarray(docs)
                held, firsts, docs, size = [], [], [], 0
    if held:
        yield np.concatenate(held), np.asarray(firsts), np.asarray(docs)


def buckets_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket numbers, a row for each order; positions in a piece's overhang get -1."""
    x = codes * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    out = np.empty((ORDERS, len(codes)), np.int32)
    h = np.full(len(codes), 0x9747B28C, np.uint32)
    for k in range(ORDERS):
        nxt = np.zeros(len(codes), np.uint32)
        nxt[: len(codes) - k] = x[k:] if k else x
        h = (h ^ nxt) * np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        out[k] = h & np.uint32(BUCKETS - 1)
    ends = np.append(first[1:], len(codes))
    for k in range(1, ORDERS):
        out[:, ends - k] = -1
    return out


def _count(langs: list[str]):
    place = {v: i for i, v in enumerate(langs)}

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        for block in blocks:
            for at in range(0, block.num_rows, 1000):
                some = block.slice(at, 1000)
                of = np.asarray([place[v] for v in some.column(1).to_pylist()])
                for codes, first, doc in slices(some.column(0).to_pylist()):
                    hashed = buckets_of(codes, first)
                    owner = np.repeat(of[doc], np.diff(np.append(first, len(codes))))
                    for row in hashed:
                        seen = row >= 0
                        flat = owner[seen].astype(np.int64) * BUCKETS + row[seen]
                        sums += np.bincount(flat, minlength=sums.size).reshape(sums.shape)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    return run


class LanguageModel:
    """``langs`` in byte order and ``weights``, float64 of buckets x languages; ``prior`` by language."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.weights, self.prior = langs, weights, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.tile(self.prior, (len(texts), 1))
        for codes, first, doc in slices(texts):
            part = np.zeros((len(first), len(self.langs)))
            for row in buckets_of(codes, first):
                picked = self.weights[row]  # row -1 is the last, a row of zeros
                part += np.add.reduceat(picked, first, axis=0)
            np.add.at(total, doc, part)
        return total


def fit(labelled: DataFrame, sample: int = SAMPLE, alpha: float = 0.5, min_support: int = 1) -> LanguageModel:
    """Train on ``text`` and ``lang``; ``doc_id`` only decides which rows are sampled for grams; priors count all."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    support = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    counts = {r.lang: r.n for r in support.limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels; raise min_support to leave out rare ones")
    rows = rows.where(F.col("lang").isin(*counts))
    langs = sorted(counts, key=lambda v: v.encode())
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for v in langs for x in (v, min(1.0, sample / counts[v]))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003
    grams = (
        rows.where(drawn)
        .select("text", "lang")
        .mapInArrow(_count(langs), "lang int, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    sums = np.full((BUCKETS, len(langs)), alpha)
    sums[grams["bucket"].to_numpy(), grams["lang"].to_numpy()] += grams["n"].to_numpy()
    weights = np.zeros((BUCKETS + 1, len(langs)))
    weights[:BUCKETS] = np.log(sums) - np.log(sums.sum(axis=0))
    whole = np.asarray([counts[v] for v in langs], float)
    return LanguageModel(langs, weights, np.log(whole / whole.sum()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; reads ``text`` alone."""
    spread = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*spread.value)
        for block in blocks:
            for at in range(0, block.num_rows, 500):
                some = block.slice(at, 500)
                texts = some.column(1).to_pylist()
                known = np.asarray(some.column(2).to_pylist(), bool)
                if not own.langs:
                    known[:] = False
                pred = np.full(len(texts), UNKNOWN, object)
                score = np.zeros(len(texts))
                if known.any():
                    raw = own.scores([t for t, k in zip(texts, known, strict=True) if k])
                    best = raw.argmax(axis=1)
                    score[known] = 1.0 / np.exp(raw - raw.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[known] = np.asarray(own.langs, object)[best]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known")
    return docs.select("doc_id", "text", lettered).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
