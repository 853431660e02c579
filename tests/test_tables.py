"""Scratch tables: where they are, and that none is left behind."""

import os

import pytest

from tidewatch.functions import tables


def folders(path):
    return sorted(os.listdir(path.removeprefix("file:"))) if os.path.isdir(path.removeprefix("file:")) else []


def test_a_workspace_is_removed_at_its_end(spark):
    base = f"{tables.shared_folder(spark)}/{spark.sparkContext.applicationId}"
    before = folders(base)
    with tables.workspace(spark, "run") as folder:
        inner = tables.materialise(spark.range(5), "inner")
        with tables.workspace(spark, "deeper") as deeper:
            assert deeper.startswith(folder)
            tables.materialise(spark.range(5), "gone")
        assert inner.count() == 5 and len(folders(folder)) == 1
        outside = tables.materialise(inner, "kept", f"{base}/kept-here")
    assert folders(base) == sorted([*before, "kept-here"]) and outside.count() == 5
    with pytest.raises(ZeroDivisionError), tables.workspace(spark, "fails"):
        tables.materialise(spark.range(5), "inner")
        raise ZeroDivisionError
    tables.release(outside)
    assert folders(base) == before
    assert tables.scratch(spark, "x").startswith(base)
