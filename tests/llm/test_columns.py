"""Stages carry any further column of their input untouched, whatever its name."""

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import exact_dedup, mixing, packing, quality, simhash

NAMES = [
    "_copy", "_row_key", "_row_name", "_row_text", "_m", "_bad_host", "_drawn_doc", "_hot", "_cold", "_salt", "_big",
    "own", "key", "name", "tkey", "copy", "row", "digest", "keep_id", "kept", "batch", "host", "host_ok", "base_failed",
    "n_words", "n", "c0", "c1", "fp", "first", "root", "domain", "drawn_doc", "drawn_lang", "leaf", "slice", "epoch",
    "n_tokens", "whole", "rest", "part", "ids", "local_start", "a.b", "a`b", "with space", "KEEP_ID", "Own", "_COPY",
]
NAMES = list({n.lower(): n for n in NAMES}.values())
STAGES = {
    "quality": quality.passing,
    "quality by lookup": lambda d: quality.passing(d, hosts=-1),
    "exact": lambda d: exact_dedup.surviving(d, exact_dedup.exact_dedup(d)),
    "near": simhash.surviving,
    "mixing": lambda d: mixing.mixed(d, mixing.Mix(share=1.0)),
}


@pytest.fixture(scope="module")
def wide(spark, docs, tmp_path_factory):
    base = docs.drop("digest", "kept", "n_words")
    value = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")
    own = [F.concat(F.lit(f"{i}:"), value).alias(n) for i, n in enumerate(NAMES)]
    extra = [F.create_map(value, F.lit(1)).alias("a map"), F.array(value).alias("an array")]
    at = str(tmp_path_factory.mktemp("wide") / "documents.parquet")
    base.select("*", *own, *extra).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


@pytest.mark.parametrize("stage", list(STAGES))
def test_columns_are_kept(wide, docs, stage):
    got = STAGES[stage](wide)
    assert got.columns == wide.columns and [f.dataType for f in got.schema] == [f.dataType for f in wide.schema]
    rows = [r.asDict(recursive=True) for r in got.collect()]
    assert rows
    for r in rows:
        value = str(-1 if r["doc_id"] is None else r["doc_id"])
        assert [r[n] for n in NAMES] == [f"{i}:{value}" for i in range(len(NAMES))]
        assert r["a map"] == {value: 1} and r["an array"] == [value]
    plain = sorted(str((r.doc_id, r.text)) for r in STAGES[stage](docs).collect())
    assert plain == sorted(str((r["doc_id"], r["text"])) for r in rows)


def test_packing_ignores_further_columns(wide, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    pack = lambda d: sorted(packing.pack_documents(d, pipeline.TOKENIZER).select("doc_id", "length").collect(), key=str)
    assert len(pack(wide)) >= docs.count()


def test_a_missing_column_is_named(docs):
    with pytest.raises(ValueError, match="'text'"):
        simhash.boxed(docs.drop("text"), "text")
