"""Table sources and model storage: Parquet in, Parquet out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save_relations(path: str, **relations: DataFrame) -> None:
    """Write a model's relations as folders of Parquet below ``path``."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_relations(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Write a model's scalars as a one-line text table."""
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/settings"
    )


def load_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/settings").first()[0])
