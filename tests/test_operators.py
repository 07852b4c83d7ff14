import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import stem, tokenize
from glyphmill.operators import coherence, corpus, retrieval, similarity, topics, vectors


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_counts(corpus_of):
    docs = corpus_of(["b", "a", "b"], [], None, ["a"])
    assert rows(corpus.term_frequencies(docs), "doc_id", "term", "tf") == [(0, "a", 1), (0, "b", 2), (3, "a", 1)]
    assert rows(corpus.postings(docs), "doc_id", "doc_len", "max_tf", "term") == [
        (0, 3, 2, "a"), (0, 3, 2, "b"), (3, 1, 1, "a"),
    ]
    assert rows(corpus.document_frequency(docs), "term", "df") == [("a", 2), ("b", 1)]
    assert corpus.corpus_stats(docs).first() == (4, 1.0)
    assert dict(rows(corpus.idf(docs), "term", "idf"))["b"] == pytest.approx(math.log(5))
    assert rows(corpus.vocabulary(docs), "term_id", "term") == [(0, "b"), (1, "a")]
    known = corpus.lookup_ids(docs.select(F.lit("zz").alias("term")).limit(1), corpus.vocabulary(docs))
    assert known.first().term_id == -1


def test_text_stats(corpus_of):
    got = {r.doc_id: r for r in corpus.text_stats(corpus_of(["b", "a", "b", "a", "éé"], [])).collect()}
    r = got[0]
    assert (r.num_tokens, r.num_unique_terms, r.hapax_legomena, r.top_term) == (5, 3, 1, "a")
    assert r.avg_token_length == pytest.approx(8 / 5) and r.vocabulary_richness == pytest.approx(3 / 5)
    assert tuple(got[1])[1:] == (0, 0, 0.0, 0.0, 0, "")


def test_keywords(corpus_of):
    docs = corpus_of(["cat", "cat", "dog"], ["dog"], [])
    scores = dict(rows(corpus.keyword_scores(docs), "term", "score"))
    assert scores["cat"] == pytest.approx(math.log(4))
    assert scores["dog"] == pytest.approx((0.75 + 1.0) * math.log(2.5))
    assert [r.term for r in corpus.extract_keywords(docs, 1, "FREQ").collect()] == ["cat"]
    assert corpus.extract_keywords(docs, 0).count() == 0
    assert corpus.extract_keywords(docs, 5, "other").count() == 0


def test_ngram_ranking(corpus_of):
    docs = corpus_of("a b a b c".split())
    assert [tuple(r.gram) for r in corpus.top_ngrams(docs, 2, 2).collect()] == [("a", "b"), ("b", "a")]
    assert corpus.top_ngrams(docs, 2, 0).count() == 0


def test_similarities(apply2):
    kind = "array<string>"
    assert apply2(similarity.jaccard, ["a", "b"], ["b", "c"], kind) == pytest.approx(1 / 3)
    assert apply2(similarity.jaccard, [], [], kind) == 0.0
    assert apply2(similarity.overlap, ["a", "a"], ["a", "b"], kind) == 1.0
    assert apply2(similarity.cosine_bags, ["a", "a", "b"], ["a"], kind) == pytest.approx(2 / math.sqrt(5))
    assert apply2(similarity.cosine_bags, [], ["a"], kind) == 0.0
    assert apply2(lambda a, b: similarity.ngram_jaccard(a, b, 2), ["a b", "c"], ["a", "b c"], kind) == 0.0
    assert apply2(lambda a, b: similarity.ngram_cosine(a, b, 2), ["x", "y", "z"], ["x", "y", "z"], kind) == pytest.approx(1)


def test_vectors(spark):
    one = spark.range(1)
    v = vectors.sparse_vector({1: 2.0, 2: 0.0, -1: 3.0, 4: float("nan")})
    assert one.select(v).first()[0] == {1: 2.0}
    assert one.select(vectors.vector_set(v, F.lit(1), F.lit(0.0))).first()[0] == {}
    assert one.select(vectors.vector_set(v, F.lit(-2), F.lit(1.0))).first()[0] == {1: 2.0}
    assert one.select(vectors.vector_get(v, F.lit(9))).first()[0] == 0.0
    inf = vectors.sparse_vector({0: float("inf")})
    assert one.select(vectors.cosine_similarity(inf, inf)).first()[0] == 0.0
    assert one.select(vectors.cosine_similarity(v, v)).first()[0] == pytest.approx(1.0)


def test_hashing(corpus_of):
    docs = corpus_of(["cat", "dog", "cat"], [])
    assert rows(vectors.transform_hashing(docs, 1, signed=False), "bucket", "value") == [(0, 3.0)]
    sums = vectors.HashingVectorizer(64)
    by_row = {r.doc_id: r.v for r in docs.select("doc_id", sums.transform(F.col("tokens")).alias("v")).collect()}
    assert by_row[0] == {r.bucket: r.value for r in sums.entries(docs).collect()} and by_row[1] == {}
    for make in (lambda: vectors.HashingVectorizer(0), lambda: vectors.hash_bucket(F.lit("a"), -1)):
        with pytest.raises(ValueError):
            make()


def test_bm25_pins(corpus_of):
    model = retrieval.Bm25Model.fit(corpus_of(["a", "b"], ["b", "c"]))
    hits = model.search(["b"]).collect()
    assert [h.doc_id for h in hits] == [0, 1] and hits[0].score == pytest.approx(0.1823215567939546)
    assert model.search(["a"]).first().score == pytest.approx(0.6931471805599453)
    five = corpus_of(["zzz", "a"], ["b", "c"], ["d", "e"], ["f", "g"], ["h", "i"])
    assert retrieval.Bm25Model.fit(five).search(["zzz"]).first().score == pytest.approx(1.3862943611198906)
    assert model.search([], k1=-1).count() == 0 and model.search(["a"], 0, k1=-1).count() == 0
    for bad in ({"k1": -1}, {"b": 2}, {"k1": float("nan")}):
        with pytest.raises(ValueError):
            model.search(["a"], **bad)
    assert retrieval.Bm25Model.fit(corpus_of([], [])).search(["a"]).count() == 0


def test_cosine_models(corpus_of, spark, tmp_path):
    docs = corpus_of(["cat", "sat"], [], ["dog", "sat", "sat"])
    counts = retrieval.CountModel.fit(docs)
    assert counts.search(["dog"]).collect()[0][:2] == (1, 2)
    assert counts.search(["bird"]).count() == 0
    tfidf = retrieval.TfidfModel.fit(docs)
    hits = tfidf.search(["sat", "bird"], None).collect()
    assert [h.doc_id for h in hits] == [2, 0]
    tfidf.save(str(tmp_path / "m"))
    again = retrieval.TfidfModel.load(spark, str(tmp_path / "m")).search(["sat", "bird"], None).collect()
    assert again == hits
    weights = dict(rows(tfidf.transform(corpus_of(["sat", "bird", "bird"])), "term", "weight"))
    assert weights == {"sat": pytest.approx(0.75 * math.log(2.5))}


def test_ranking(spark):
    scores = spark.createDataFrame([(0, 5, 1.0), (0, 2, 1.0), (0, 9, 2.0), (0, 1, 0.0)], "qid long, doc_id long, score double")
    assert [r.doc_id for r in retrieval.rank(scores, 2).collect()] == [9, 2]


ANIMALS = [
    ["cat", "dog", "pet", "cat"], ["dog", "pet", "bone"], ["car", "road", "wheel"], ["wheel", "car", "engine", "car"], [],
]


@pytest.mark.parametrize("mode,sweeps", [("exact", 30), ("distributed", 3)])
def test_lda(corpus_of, mode, sweeps):
    docs = corpus_of(*ANIMALS)
    model = topics.fit_lda(docs, 2, sweeps, mode=mode)
    again = topics.fit_lda(docs.repartition(3), 2, sweeps, mode=mode)
    assert rows(model.assignments, "doc_id", "pos", "topic") == rows(again.assignments, "doc_id", "pos", "topic")
    assert model.assignments.count() == 14
    for r in model.phi().groupBy("topic").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1)
    theta = model.theta().groupBy("doc_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert len(theta) == 5 and all(r.s == pytest.approx(1) and r.n == 2 for r in theta)
    assert 1 < model.perplexity().first()[0] < 20
    assert model.top_terms(3).count() == 6
    folded = topics.fold_in(model, corpus_of(["cat", "dog"], ["unknown"], []), 10)
    shares = {(r.doc_id, r.topic): r.p for r in folded.collect()}
    assert shares[1, 0] == shares[2, 1] == 0.5 and shares[0, 0] + shares[0, 1] == pytest.approx(1)


def test_lda_limits(corpus_of):
    docs = corpus_of(*ANIMALS)
    empty = topics.fit_lda(docs, -3)
    assert empty.num_topics == 0 and empty.perplexity().first()[0] == 0.0
    for bad in ({"alpha": 0.0}, {"beta": float("nan")}, {"iterations": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            topics.fit_lda(docs, 2, **{"iterations": 1} | bad)


def test_pmi_formulas(spark):
    one = spark.range(1)
    value = one.select(coherence.pmi(F.lit(2), F.lit(2), F.lit(2), F.lit(3))).first()[0]
    assert value == pytest.approx(math.log(1.5))
    assert one.select(coherence.pmi(F.lit(0), F.lit(2), F.lit(2), F.lit(3))).first()[0] == -10.0
    assert one.select(coherence.umass(F.lit(0), F.lit(2))).first()[0] == pytest.approx(math.log(1e-12 / 2))


def test_coherence(spark, corpus_of):
    docs = corpus_of(["a", "b"], ["a", "b", "c"], ["c"])
    terms = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "topic int, rank int, term string")
    pairs = coherence.pair_scores(terms, docs)
    got = {(r.i, r.j): r.pmi for r in pairs.collect()}
    assert got == {
        ("b", "a"): pytest.approx(math.log(1.5)), ("c", "a"): pytest.approx(math.log(0.75)), ("c", "b"): pytest.approx(math.log(0.75)),
    }
    mean = coherence.mean_pairwise_pmi(pairs).first().pmi
    assert mean == pytest.approx((math.log(1.5) + 2 * math.log(0.75)) / 3)
    unit = coherence.normalize_unit(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", [], "u")
    assert [r.u for r in unit.collect()] == [0.5, 0.5]


def document_scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan


def test_search_reads_its_model_only(spark, tmp_path):
    texts = [(i, f"{'the ' * (i % 3)}w{i % 7} w{i % 5} x") for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    docs = spark.read.parquet(str(tmp_path / "texts")).select("doc_id", tokenize.word_tokens(F.col("text")).alias("tokens"))
    for kind in (retrieval.CountModel, retrieval.TfidfModel, retrieval.Bm25Model):
        model = kind.fit(docs)
        hits = model.search(["w1", "the"], 5)
        scans, plan = document_scans(hits)
        assert str(tmp_path) not in plan and scans <= 4
        assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[the,w1\]", plan), kind
        model.save(str(tmp_path / kind.__name__))
        again = kind.load(spark, str(tmp_path / kind.__name__)).search(["w1", "the"], 5)
        assert again.collect() == hits.collect() and hits.count() == 5


def test_coherence_reads_texts_once(spark, tmp_path):
    texts = [(i, f"a{i % 3} b{i % 4} c{i % 5} d") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    docs = spark.read.parquet(str(tmp_path / "texts")).select("doc_id", tokenize.word_tokens(F.col("text")).alias("tokens"))
    model = topics.LdaModel(docs, topics.deterministic_assignments(docs, 2), 2, 0.1, 0.01, 1, 0)
    scored = coherence.coherence_cv(model, docs, 4)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("tmp_path") == 0 and plan.count(str(tmp_path)) <= 1  # the number of documents
    assert scored.count() == 1


def test_vocabulary_grows_and_is_looked_up(corpus_of, spark):
    vocab = corpus.vocabulary(corpus_of(["b", "a"], ["c"]))
    more = corpus.extend_vocabulary(vocab, corpus_of(["d", "a"], [], ["e", "d"]))
    assert rows(more, "term_id", "term") == [(0, "b"), (1, "a"), (2, "c"), (3, "d"), (4, "e")]
    assert rows(corpus.extend_vocabulary(vocab.limit(0), corpus_of(["z"])), "term_id", "term") == [(0, "z")]
    ids = spark.createDataFrame([(1,), (9,)], "term_id long")
    assert rows(corpus.lookup_terms(ids, more), "term_id", "term") == [(1, "a"), (9, "")]
    assert rows(corpus.contains_ids(ids, more), "term_id", "known") == [(1, True), (9, False)]
    terms = spark.createDataFrame([("e",), ("f",)], "term string")
    assert rows(corpus.contains_terms(terms, more), "term", "known") == [("e", True), ("f", False)]


def test_vocabulary_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 2)
    docs = spark.createDataFrame([(1024 * i, [f"t{i}", f"u{i}", "t0"]) for i in range(9)], "doc_id long, tokens array<string>")
    got = dict(rows(corpus.vocabulary(docs), "term", "term_id"))
    assert got == {t: i for i, t in enumerate(["t0", "u0", *(f"{x}{i}" for i in range(1, 9) for x in "tu")])}


def test_hashed_row_of_many_tokens(spark):
    table = spark.createDataFrame([(0, [f"t{i % 9000}" for i in range(60_000)])], "doc_id long, tokens array<string>")
    sums = vectors.HashingVectorizer(4096)
    began = time.perf_counter()
    by_row = table.select(sums.transform(F.col("tokens")).alias("v")).first().v
    assert time.perf_counter() - began < 20
    assert by_row == {r.bucket: r.value for r in sums.entries(table).collect()}
    plus = vectors.HashingVectorizer(7, signed=False)
    assert sum(table.select(plus.transform(F.col("tokens")).alias("v")).first().v.values()) == 60_000


def test_topics_separate(corpus_of):
    pets, code = ["cat", "dog", "fish", "bird"], ["loop", "class", "type", "list"]
    docs = corpus_of(*[(pets if i % 2 else code) * 5 for i in range(12)])
    for mode, sweeps in (("exact", 60), ("distributed", 25)):
        model = topics.fit_lda(docs, 2, sweeps, seed=3, mode=mode)
        shares = {(r.doc_id, r.topic): r.p for r in model.theta().collect()}
        first = [max((0, 1), key=lambda k: shares[d, k]) for d in range(12)]
        assert first[:2] * 6 == first and first[0] != first[1], mode
        assert all(shares[d, first[d]] > 0.9 for d in range(12))
        folded = topics.fold_in(model, corpus_of(["cat", "bird", "zzz"], ["loop"] * 4, ["zzz"]), 40)
        p = {(r.doc_id, r.topic): r.p for r in folded.collect()}
        assert p[0, first[1]] > 0.9 and p[1, first[0]] > 0.9 and p[2, 0] == p[2, 1] == 0.5


def test_counts_are_computed_once(spark, tmp_path):
    spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "texts"))
    docs = spark.read.parquet(str(tmp_path / "texts")).select("doc_id", tokenize.word_tokens(F.col("text")).alias("tokens"))
    for made in (corpus.postings(docs), corpus.document_frequency(docs), corpus.placed(docs), corpus.term_frequencies(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
    assert rows(corpus.placed(docs), "doc_id", "pos", "term") == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]
    nulls = spark.createDataFrame([(1, ["a", None])], "doc_id long, tokens array<string>")
    assert corpus.placed(nulls).count() == 2 and corpus.unique_terms(nulls).count() == 2


def test_lda_in_blocks(spark, corpus_of, monkeypatch):
    docs = corpus_of(*[[f"w{(i * j) % 11}" for j in range(i % 9)] for i in range(40)], None, ["a"] * 50)

    def sampled():
        model = topics.fit_lda(docs, 3, 2, mode="distributed")
        folded = topics.fold_in(model, docs.select((F.col("doc_id") + 100).alias("doc_id"), "tokens"), 5)
        return rows(model.assignments, "doc_id", "pos", "term", "topic"), rows(folded, "doc_id", "topic", "p")

    whole = sampled()
    assert len(whole[0]) == sum(i % 9 for i in range(40)) + 50 and len(whole[1]) == 42 * 3
    # neither the blocks nor the way that a token is drawn matter
    for names in ({"BLOCK": 7, "FOLD_BLOCK": 5}, {"FEW": 1}, {"FEW": 1000}):
        for name, value in names.items():
            monkeypatch.setattr(topics, name, value)
        assert sampled() == whole


def test_steps_draw_what_single_tokens_draw(monkeypatch):
    rng = np.random.default_rng(4)
    offsets = np.concatenate([[0], np.cumsum([3, 0, 9, 1, 7, 12])])
    weight, words = rng.random((4, 3)), rng.integers(0, 4, offsets[-1])
    z, u = rng.integers(0, 3, offsets[-1]), rng.random(offsets[-1])
    expected = z.copy()
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        for t in range(begin, end):
            own = np.bincount(expected[begin:end], minlength=3) - np.eye(3)[expected[t]] + 0.5
            expected[t] = topics._draw((own * weight[words[t]]).tolist(), u[t])
    for few in (1, 3, 100):
        monkeypatch.setattr(topics, "FEW", few)
        steps = topics._Steps(offsets, 3, 0.5)
        drawn, of = z[steps.order], words[steps.order]
        mine = steps.counts(drawn)
        assert mine.shape == (3, 6)  # a row for each topic
        steps.sweep(
            drawn, u[steps.order], mine,
            lambda begin, end, own, m: m * weight.T[:, of[begin:end]],
            lambda t, own, m: [x * w for x, w in zip(m, weight[of[t]].tolist(), strict=True)],
        )
        assert (drawn == expected[steps.order]).all() and (mine == steps.counts(drawn)).all()


def test_no_token_is_joined_to_its_counts(spark, corpus_of):
    model = topics.fit_lda(corpus_of(*ANIMALS), 2, 1, mode="distributed")
    folded = topics.fold_in(model, corpus_of(*ANIMALS), 2)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan
    assert model.rows.count() == 5


def test_grams_are_grouped_as_strings(spark, corpus_of):
    docs = corpus_of("a b a b c".split(), ["a"], [], None, ["b", "a"])
    for n in (1, 2, 3, 0):
        made = corpus.joined_ngram_frequencies(docs, n)
        whole = corpus.ngram_frequencies(docs, n).select(F.array_join("gram", " ").alias("gram"), "cnt")
        assert rows(made, "gram", "cnt") == rows(whole, "gram", "cnt")
    assert dict(made.dtypes)["gram"] == "string"


def test_runs_of_postings_are_sorted(corpus_of, monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"term": list(t), "doc_id": list(range(len(t)))}) for t in ("cab", "zay", "b")]
    monkeypatch.setattr(retrieval, "RUN", 4)
    got = ["".join(b.column("term").to_pylist()) for b in retrieval._in_runs(iter(batches))]
    assert got == ["aabcyz", "b"]
    plan = retrieval.written_postings(corpus_of(["b", "a"]))
    assert rows(plan, "doc_id", "term") == [(0, "a"), (0, "b")]


@pytest.mark.parametrize("heavy", [0, 2, 65_536])
def test_norms_of_common_and_rare_terms(spark, corpus_of, monkeypatch, heavy):
    monkeypatch.setattr(retrieval, "HEAVY", heavy)
    docs = corpus_of(*[["the", *(["x"] if i % 2 else []), f"w{i}", f"w{i}"] for i in range(9)])
    model = retrieval.TfidfModel.fit(docs)
    idf = {r.term: r.idf for r in model.terms.collect()}
    expected = {}
    for r in model.postings.collect():
        w = (0.5 + 0.5 * r.tf / r.max_tf) * idf[r.term]
        expected[r.doc_id] = expected.get(r.doc_id, 0.0) + w * w
    assert {r.doc_id: r.norm for r in model.norms.collect()} == {d: pytest.approx(math.sqrt(s)) for d, s in expected.items()}


def test_transform_needs_terms_only(corpus_of, monkeypatch):
    docs, more = corpus_of(["cat", "sat"], [], ["dog", "sat", "sat"]), corpus_of(["sat", "bird", "bird"])
    whole = {kind: kind.fit(docs) for kind in (retrieval.CountModel, retrieval.TfidfModel)}
    monkeypatch.setattr(retrieval, "written_postings", None)
    for kind, model in whole.items():
        light = kind.fit(docs, search=False)
        assert light.postings is None and light.norms is None
        assert rows(light.transform(more), "doc_id", "term", "weight") == rows(model.transform(more), "doc_id", "term", "weight")
        with pytest.raises(ValueError):
            light.search(["cat"])


def test_no_posting_is_shuffled_for_a_small_table_of_queries(spark, corpus_of):
    model = retrieval.Bm25Model.fit(corpus_of(["a", "b"], ["b", "c"]))
    queries = spark.createDataFrame([(7, ["b", "a"])], "qid long, tokens array<string>")
    scores = model.scores(queries)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and plan.count("FileScan") == 2
    assert scores.count() == 2


BATCH = [(7, ["b", "a"]), (9, ["the", "w3", "w3", "x"]), (-2, ["zzz"]), (12, ["the"]), (30, ["x", "b", "the"])]


@pytest.mark.parametrize("kind", [retrieval.CountModel, retrieval.TfidfModel, retrieval.Bm25Model])
@pytest.mark.parametrize("small", [False, True])
def test_batches_by_slices_have_the_ranks_of_all_pairs(spark, corpus_of, monkeypatch, kind, small):
    if small:  # many slices and blocks, a few pairs at once
        for name, n in (("ASKED", 2), ("ASKED_TERMS", 3), ("SLICE", 5), ("PAIRS", 4)):
            monkeypatch.setattr(retrieval, name, n)
    docs = [["the", *(["x"] if i % 2 else []), *["b"] * (i % 4), f"w{i % 5}"] for i in range(40)]
    model = kind.fit(corpus_of(*docs, [], ["a"], *[["b", "the", "the"]] * 9))
    queries = spark.createDataFrame(BATCH, "qid long, tokens array<string>")
    columns = "qid", "rank", "doc_id", "score"
    for top_k, digits in ((3, 1), (None, 6)):
        every = rows(retrieval.rank(model.scores(queries), top_k, digits), *columns)
        assert rows(model.search_batch(queries, top_k, digits), *columns) == every
    ties = rows(model.search_batch(queries, 4), *columns[:3])
    assert ties == rows(retrieval.rank(model.scores(queries), 4, 12), *columns[:3])
    assert model.search_batch(queries.where("qid < 0"), 3).count() == 0
    assert model.search_batch(queries, 0).count() == 0


def test_a_batch_neither_shuffles_nor_groups_pairs(spark, corpus_of):
    queries = spark.createDataFrame(BATCH, "qid long, tokens array<string>")
    for kind in (retrieval.TfidfModel, retrieval.Bm25Model):
        hits = kind.fit(corpus_of(*[["the", "x", "b"]] * 50)).search_batch(queries, 2, 6)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate(keys=[qid" not in plan and "FlatMapCoGroupsInArrow" in plan
    # a slice gives no more than the best
    postings = pa.table({"doc_id": list(range(50)), "no": [0] * 50, "w": [1.0 + i % 5 for i in range(50)]})
    asked = pa.table({"qid": [3, 4], "no": [0, 0], "w": [1.0, 2.0]})
    best = retrieval._best_of_slice(2, 6, cosine=False)((), postings, asked).to_pylist()
    assert sorted(tuple(r.values()) for r in best) == [(3, 4, 5.0), (3, 9, 5.0), (4, 4, 10.0), (4, 9, 10.0)]


def test_bounds_of_rounded_scores(spark):
    scores = [0.0, 0.05, 0.15, 0.25, 0.349999, 0.35, 0.35000001, 1.005, 2.5, 7e12 + 0.05]
    made = spark.createDataFrame([(x,) for x in scores], "x double").select(F.round("x", 1)).collect()
    low, high = retrieval._bounds(np.asarray(scores), 1)
    assert all(a - 0.01 <= r[0] * 10 <= b + 0.01 for a, b, r in zip(low, high, made, strict=True))
    assert (low == high).sum() >= 3


def test_perplexity_inside_rows(corpus_of):
    docs = corpus_of(*ANIMALS)
    state = topics.deterministic_assignments(docs, 3)
    made = topics.deterministic_rows(docs, 3)
    assert rows(topics._exploded(made), "doc_id", "pos", "term", "topic") == rows(state, "doc_id", "pos", "term", "topic")
    by_row = topics.LdaModel(docs, state, 3, 0.1, 0.01, 1, 0, made)
    joined = topics.LdaModel(docs, state, 3, 0.1, 0.01, 1, 0)
    assert by_row.perplexity().first()[0] == pytest.approx(joined.perplexity().first()[0])
    assert "hashpartitioning(doc_id" not in by_row.perplexity()._jdf.queryExecution().executedPlan().toString()


def test_stem_counts_need_no_shuffle(corpus_of, monkeypatch):
    docs = corpus_of(["running", "runs", "cats", "runs"], [], ["cat", "cats"])
    posted = stem.stem_postings(corpus.term_frequencies(docs)).groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))
    for memo in (500_000, 1):
        monkeypatch.setattr(stem, "MEMO", memo)
        made = stem.stem_counts(docs.select("doc_id", corpus.term_counts(F.col("tokens")).alias("counts")))
        assert rows(made, "doc_id", "stem", "tf") == rows(posted, "doc_id", "stem", "tf")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_first_places_need_no_sort_and_large_keys_are_exact(spark):
    table = [(1 << 61, ["b", "a"]), (-5, ["c", "c", "a"]), (7, ["b", None])]
    docs = spark.createDataFrame(table, "doc_id long, tokens array<string>")
    first = corpus.vocabulary_first_seen(docs)
    assert rows(first.where("term IS NOT NULL"), "term", "first_doc", "first_pos") == [("a", -5, 2), ("b", 7, 0), ("c", -5, 0)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_pairs_are_made_in_slices(spark, corpus_of):
    left = corpus.term_frequencies(corpus_of(*[["a", f"w{i % 3}", "b"] for i in range(20)], ["zz"]))
    right = corpus.term_frequencies(corpus_of(["a", "w1"], ["q"], ["w2", "w2"])).withColumnRenamed("doc_id", "item_id")
    whole = similarity.cosine_between(left, right, "doc_id", "item_id")
    sliced = similarity.cosine_between(left, right, "doc_id", "item_id", 7)
    assert rows(sliced, "doc_id", "item_id", "cosine") == rows(whole, "doc_id", "item_id", "cosine")
    assert "REPARTITION_BY_NUM" in sliced._jdf.queryExecution().executedPlan().toString()


def test_rows_beside_the_ones_before(spark):
    keys = [-1025, -1024, -1, 0, 1, 1022, 1023, 1024, 1025, 2048, 5000]
    table = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(3, None), (4, "t4"), (None, "n")], "k long, t string")
    beside = corpus.with_previous(table, "k", "t")
    before = {k: t for k, t in table.collect() if k is not None}
    expected = [(k, t, before[k - 1]) for k, t in before.items() if k - 1 in before]
    key = lambda r: r[0]
    assert sorted(map(tuple, beside.collect()), key=key) == sorted(expected, key=key)
    assert "Join" not in beside._jdf.queryExecution().executedPlan().toString()


def test_cosine_of_rows(spark, corpus_of):
    table = [(1, ["a", "a", "b"], ["a"]), (2, [], ["a"]), (3, ["x", "y"], ["y", "x"]), (4, None, ["a"])]
    docs = spark.createDataFrame(table, "id long, a array<string>, b array<string>")
    bags = docs.select("id", *[similarity.bag(F.col(c)).alias(c) for c in "ab"])
    got = dict(rows(similarity.cosine_rows(bags, "id", "a", "b"), "id", "cosine"))
    assert got == {1: pytest.approx(2 / math.sqrt(5)), 2: 0.0, 3: pytest.approx(1.0), 4: 0.0}


def test_gram_keys_tell_tokens_apart(apply):
    made = apply(lambda t: similarity.gram_keys(t, 2), ["a\x1fb", "c", "a", "b\x1fc", None, "", "1\x1f1", "1"], "array<string>")
    assert len(set(made)) == len(made) == 7
    assert apply(lambda t: similarity.gram_keys(t, 2), ["a"], "array<string>") == []
