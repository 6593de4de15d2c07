"""Filters on costly columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(rows: DataFrame, condition: Column, *columns: str | Column) -> DataFrame:
    """Rows that meet a condition on computed columns, without computing those again.

    Spark moves a plain filter below projections by copying the projected expressions into it, once
    for each mention, so that a parsed or normalised column would be worked out several times. A
    generator of one row or none does the same selection and stays where it is.
    """
    return rows.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))
