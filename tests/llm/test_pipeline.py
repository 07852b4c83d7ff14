import pytest

from glyphmill.llm import packing, queries
from tests.llm.test_mixing import check
from tests.llm.test_quality import host_rates, naive
from tests.llm.test_simhash import naive_fingerprint, naive_roots

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, docs, rows, tmp_path):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    stage = dict(pipeline.STAGES)
    sf = str(tmp_path)

    def reread(df, name):
        df.write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    good = reread(stage["quality_rules"](spark, docs, sf), "good")
    rates = host_rates(rows)
    expected = [r for r in rows if not naive(r[1])[-1] and (r[3] is None or rates[r[3]] <= 0.6)]
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r[0]) for r in expected)

    exact = reread(stage["exact_dedup"](spark, good, sf), "exact")
    best = {}
    for r in expected:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    assert sorted(r.doc_id for r in exact.collect()) == sorted(best.values())

    near = reread(stage["simhash_near_dedup"](spark, exact, sf), "near")
    left = sorted((r.doc_id, r.text) for r in exact.collect())
    roots = naive_roots([naive_fingerprint(t) for _, t in left])
    assert sorted(r.doc_id for r in near.collect()) == [left[i][0] for i, root in enumerate(roots) if i == root]
    assert near.columns == docs.columns

    mixed = reread(stage["mixing"](spark, near, sf), "mixed")
    drawn = check(near, pipeline.MIX)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in drawn)

    pieces = stage["packing"](spark, mixed, sf)
    assert pieces.schema == packing.pack_documents(mixed, pipeline.TOKENIZER).schema
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in mixed.collect()}


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.agg({"length": "sum"}).first()[0] > 0


def test_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    assert all(isinstance(sql, str) for sql in queries.oracle_sql().values())
