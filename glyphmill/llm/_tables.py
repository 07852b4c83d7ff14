"""Plan pieces shared by the training-data operators.

* ``materialise`` cuts lineage with a Parquet table in the cluster's shared
  checkpoint folder, so a lost executor costs a re-read and not a re-run.
* ``lookup`` joins rows to a keyed table without sending a hot key to one task.
* ``boxed`` and ``unboxed`` carry a table's own columns past internal ones, whatever their names.
* ``running_offsets`` turns bounded per-bucket totals into global offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.sources.scratch import materialise, scratch_path  # noqa: F401

HOT_SHARE = 1024
"""A key is hot when it holds more than one row in so many; at most as many keys can be hot."""

SALTS = 4096


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """``own``, a struct of all columns of ``docs`` by place, beside the ``needed`` ones.

    Names are met exactly, then in any case, so that dots, internal names and
    twins that differ in case do no harm.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def place(name: str) -> Column:
        same = [i for i, c in enumerate(docs.columns) if c == name]
        alike = [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
        if not alike:
            raise ValueError(f"the table has no column {name!r}")
        return F.col(f"c{(same or alike)[0]}").alias(name)

    return plain.select(F.struct(*plain.columns).alias("own"), *[place(n) for n in needed])


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``own``."""
    return rows.select(*[F.col("own")[f"c{i}"].alias(name) for i, name in enumerate(docs.columns)])


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    values: list[str],
    count: str,
    total: int,
    salted_by: list[str] | None = None,
) -> DataFrame:
    """Left-join ``values`` of ``table`` (one row per ``key``) to ``rows``.

    ``count`` is the table's column with the rows that each key has in ``rows``
    and ``total`` their sum. Keys with over ``total / HOT_SHARE`` rows, which
    are at most ``HOT_SHARE`` by counting, are broadcast; their rows, and rows
    with a null key, get a salt, so that the shuffled join stays even. The salt
    is hashed with the key: a constant on one side would be folded away and the
    join dealt out by the key alone. ``salted_by`` names the columns that the salt
    hashes: those that tell a key's rows apart, all by default.
    """
    packed = F.struct(*[F.col(v) for v in values])
    hot = F.broadcast(
        table.where(F.col(count) * HOT_SHARE > F.lit(total)).select(
            F.col(key).alias("_hot_key"), packed.alias("_hot")
        )
    )
    cold = table.where(F.col(count) * HOT_SHARE <= F.lit(total)).select(
        F.col(key).alias("_cold_key"), F.xxhash64(key, F.lit(0)).alias("_cold_salt"), packed.alias("_cold")
    )
    salt = F.lit(1) + F.pmod(F.xxhash64(*[F.col(c) for c in salted_by or rows.columns]), F.lit(SALTS)).cast("int")
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    joined = (
        rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.xxhash64(key, F.when(spread, salt).otherwise(F.lit(0))))
        .join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def running_offsets(totals: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of each group.

    ``totals`` is a table of buckets, bounded by the caller, never one of documents.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def sha256(text: Column) -> Column:
    """32-byte SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
