"""One-row aggregates next to every row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as scalar subqueries: no join is planned."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})
