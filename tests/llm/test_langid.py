import random
import zlib

import numpy as np
import pytest

from glyphmill.llm import langid


def naive(model, text):
    total = model.prior.copy()
    codes = np.concatenate([np.frombuffer(text.lower().encode("utf-32-le"), np.uint32), np.zeros(2, np.uint32)])
    for i in range(len(codes) - 2):
        for row in langid.buckets_of(codes[i : i + 3], np.array([0])):
            total = total + model.weights[row[0]]
    return total


def test_slices_meet_each_gram_once(monkeypatch):
    model = langid.LanguageModel(["a", "b"], np.random.default_rng(0).random((langid.BUCKETS + 1, 2)), np.zeros(2))
    model.weights[-1] = 0
    texts = ["", "x", "hello wörld " * 9, "İstanbul"]
    whole = model.scores(texts)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert np.allclose(whole, model.scores(texts))
    assert np.allclose(whole, [naive(model, t) for t in texts])


def test_query(docs, rows, none, spark):
    got = langid.query(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        letters = text is not None and any(c.isalpha() for c in text)
        assert (r.lang_pred in ("en", "fr")) == letters and (letters or (r.lang_pred, r.score) == ("und", 0.0))
        assert 0 <= r.score <= 1
    assert langid.query(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.query(unlabelled).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    table = spark.read.parquet(sf)
    joined = langid.query(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in joined) >= 0.98 * len(joined) > 20


def test_prior_counts_all_rows(spark):
    rows = [(i, "one two", "en") for i in range(90)] + [(i, "eins zwei", "de") for i in range(90, 100)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    assert model.langs == ["de", "en"] and abs(np.exp(model.prior) - [0.1, 0.9]).max() < 1e-9


def test_fit_against_counts(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcé ß日", k=rng.randint(0, 40))), rng.choice(["de", "fr"])) for i in range(60)]
    rows += [(90, None, "de"), (91, "text", None), (92, "rare label", "xx")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, min_support=2)
    assert model.langs == ["de", "fr"]
    sums = np.full((langid.BUCKETS, 2), 0.5)
    whole = np.zeros(2)
    for _, text, lang in rows:
        if text is None or lang not in model.langs:
            continue
        k = model.langs.index(lang)
        whole[k] += 1
        codes = np.concatenate([np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(2, np.uint32)])
        for i in range(len(codes) - 2):
            for row in langid.buckets_of(codes[i : i + 3], np.array([0])):
                sums[row[0], k] += 1
    expected = np.log(sums) - np.log(sums.sum(axis=0))
    assert np.allclose(model.weights[: langid.BUCKETS], expected) and not model.weights[-1].any()
    assert np.allclose(model.prior, np.log(whole / whole.sum()))
    assert langid.fit(table).langs == ["de", "fr", "xx"]


def test_too_many_labels_are_refused(spark):
    rows = [(i, "text", f"l{i}") for i in range(langid.MAX_LABELS + 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="min_support"):
        langid.fit(table)
