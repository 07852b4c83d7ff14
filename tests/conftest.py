import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def apply(spark):
    """Evaluate a ``Column -> Column`` function on one value."""
    from pyspark.sql import functions as F

    def run(fn, value, kind="string"):
        return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c"))).first()[0]

    return run


@pytest.fixture
def apply2(spark):
    from pyspark.sql import functions as F

    def run(fn, a, b, kind="string"):
        return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(fn(F.col("a"), F.col("b"))).first()[0]

    return run


@pytest.fixture
def corpus_of(spark):
    def make(*docs):
        return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")

    return make
