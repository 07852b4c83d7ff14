import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as driver
from glyphmill.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FAST = [
    "normalize_pipeline", "normalize_contractions", "sentences", "stopword_filter", "term_freq", "text_stats",
    "keywords_tfidf", "doc_cosine", "hash_signed", "bm25_search", "tfidf_batch", "lda_theta", "coherence_cv",
    "vocabulary_ids", "stream_term_counts",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names_agree():
    assert set(oracles.SQL) <= set(catalogue.QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@needs_data
def test_entry(spark):
    assert driver.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(oracles.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)

    def canonical(df):
        return sorted(tuple(map(repr, map(_plain, r))) for r in df[columns].itertuples(index=False))

    assert canonical(got) == canonical(expected)


def _plain(v):
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("missing", ["glyphmill.llm", "zstandard", "public_tokenizers"])
def test_import_without_subpackage_or_its_libraries(missing):
    present = driver.llm_queries is not None and driver.corpus_pipeline is not None
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e; assert 'bm25_search' in e.queries()\n"
        f"assert ('pipeline' in e.queries()) == ({present} and {missing!r} == 'zstandard')\n"
        f"assert ('op1_kk_sharding' in e.queries()) == ({present} and {missing!r} == 'public_tokenizers')"
    )
    root = os.path.dirname(os.path.abspath(driver.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_import_without_the_folders(tmp_path):
    root = os.path.dirname(os.path.abspath(driver.__file__))
    for name in ("glyphmill", "__spark_entry__.py"):
        source = os.path.join(root, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm")} if os.path.isdir(source) else {}))
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.catalogue.QUERIES) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
