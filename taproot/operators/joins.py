"""Joins of tables that are larger than Spark takes them for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles both, however small Spark takes it for.

    A table counts with the size of its packed files, and rows that are exploded from a row count as one, so that
    tables of many million rows would pass whole through the driver.
    """
    return df.hint("merge")
