import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import exact_dedup
from glyphmill.llm._tables import scratch_path


def test_against_brute_force(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    kept = defaultdict(int)
    got = exact_dedup.query(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        t = text[r.doc_id]
        ids = [i for i in groups[t] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids) if ids else None, len(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        kept[t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.query(none).count() == 0


def test_surviving_keeps_columns(docs, rows):
    left = exact_dedup.surviving(docs, exact_dedup.exact_dedup(docs))
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows})


def test_index_persists_and_appends(spark):
    path = scratch_path(spark, "test-index")
    kind = "doc_id long, text string"
    first = exact_dedup.DigestIndex(spark, path, 4).add(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], kind))
    assert {(r.doc_id, r.kept) for r in first.collect()} == {(1, False), (2, True), (3, True)}
    second = exact_dedup.DigestIndex(spark, path, 4)
    batch = second.add(spark.createDataFrame([(9, "a"), (8, "c"), (3, "b")], kind))
    assert {(r.doc_id, r.keep_id, r.kept) for r in batch.collect()} == {(9, 2, False), (8, 8, True), (3, 3, False)}
    assert second.read().count() == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_keeps_its_bucket_count(spark):
    path = scratch_path(spark, "test-index")
    kind = "doc_id long, text string"
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(200)], kind)
    assert exact_dedup.DigestIndex(spark, path, 8).add(texts).where("kept").count() == 200
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 8
        assert again.add(texts).where("kept").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="8 buckets"):
        exact_dedup.DigestIndex(spark, path, 4)
    assert exact_dedup.DigestIndex(spark, path + "-other", 4).read().count() == 0


def test_a_batch_can_be_added_again(spark, monkeypatch):
    path = scratch_path(spark, "test-index")
    kind = "doc_id long, text string"
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "b")], kind)
    two = spark.createDataFrame([(4, "b"), (5, "c")], kind)

    def kept(batch, name):
        rows = exact_dedup.DigestIndex(spark, path, 4).add(batch, name).collect()
        return sorted((r.doc_id, r.keep_id, r.kept) for r in rows)

    first = kept(one, "one")
    assert first == [(1, 2, False), (2, 2, True), (3, 3, False), (3, 3, True)]
    assert kept(two, "two") == [(4, 3, False), (5, 5, True)]
    # the driver was lost after the append and before the result was used
    assert kept(one, "one") == first
    # lost after the run was written and before the manifest named it
    commit = exact_dedup.DigestIndex._commit

    def fails(self, manifest):
        raise RuntimeError("lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "_commit", fails)
    three = spark.createDataFrame([(6, "d"), (7, "c")], kind)
    with pytest.raises(RuntimeError):
        kept(three, "three")
    monkeypatch.setattr(exact_dedup.DigestIndex, "_commit", commit)
    assert kept(three, "three") == [(6, 6, True), (7, 5, False)]
    assert exact_dedup.DigestIndex(spark, path).read().count() == 4


def test_runs_are_read_in_order_and_merged(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "test-index"), 4)
    kind = "doc_id long, text string"
    for i in range(3):
        index.add(spark.createDataFrame([(j, f"text {j}") for j in range(50 * i, 50 * i + 100)], kind), str(i))
    groups = spark.range(10).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    with index.in_stored_order():
        plan = plan_of(index.unseen(groups))
    assert plan.count("SortMergeJoin") == 3 and "LeftAnti" in plan
    # one exchange and one sort, both of the batch
    assert plan.count("Exchange") == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    assert len(index.manifest["runs"]) == 3
    index.compact()
    assert len(exact_dedup.DigestIndex(spark, index.path).runs()) == 1 and index.read().count() == 200
    again = index.add(spark.createDataFrame([(1, "text 1"), (500, "new")], kind), "late")
    assert {(r.doc_id, r.kept) for r in again.collect()} == {(1, False), (500, True)}
    assert {r.kept for r in index.add(spark.createDataFrame([(1, "text 1")], kind), "0").collect()} == {True}
