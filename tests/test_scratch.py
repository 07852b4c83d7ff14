"""Scratch tables: written once, dropped at the end of their scope."""

import os

import pytest

from glyphmill.sources.scratch import drop, materialise, scope, scratch_path


def place(path):
    return path.removeprefix("file://")


def test_scope_drops_what_it_made(spark):
    kept = scratch_path(spark, "kept")
    with scope(spark):
        inner = scratch_path(spark, "inner")
        table = materialise(spark.range(5), path=inner)
        materialise(table.where("id > 2"), path=kept)
        assert os.path.isdir(place(inner))
    assert not os.path.exists(place(inner)) and spark.read.parquet(kept).count() == 2
    drop(spark, kept)
    assert not os.path.exists(place(kept))


def test_scope_drops_after_an_error(spark):
    made = []
    with pytest.raises(RuntimeError), scope(spark):
        made.append(scratch_path(spark, "failed"))
        materialise(spark.range(1), path=made[0])
        raise RuntimeError
    assert not os.path.exists(place(made[0]))


def test_outside_a_scope_tables_stay(spark):
    table = materialise(spark.range(3), "stays")
    assert table.count() == 3 and table.dtypes == spark.range(3).dtypes
