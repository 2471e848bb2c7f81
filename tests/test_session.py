"""Written tables: ownership, and measures gathered while writing."""

import os

import pytest
from pyspark.sql import functions as F

from riskweave.session import observed_table, owned_tables, written_table


def folder(table):
    return os.path.dirname(table.inputFiles()[0].removeprefix("file://").removeprefix("file:"))


def test_owned_tables_are_deleted_innermost_first(spark):
    free = folder(written_table(spark.range(5), "free"))
    with pytest.raises(KeyError):
        with owned_tables(spark):
            outer = folder(written_table(spark.range(5), "outer"))
            with owned_tables(spark):
                inner = folder(written_table(spark.range(5), "inner"))
            assert os.path.isdir(outer) and not os.path.isdir(inner)
            raise KeyError
    assert os.path.isdir(free) and not os.path.isdir(outer)


def test_measures_of_a_written_table(spark):
    table, got = observed_table(spark.range(10), "seen", {"n": F.count(F.lit(1)), "top": F.max("id")})
    assert (got["n"], got["top"], table.count()) == (10, 9, 10)
