"""Assertions and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job on a NULL in a column that must have a value.

    The check is part of the column itself, so pruning cannot drop one without the other.
    """
    strict = {
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in required column {c}"))).otherwise(F.col(c))
        for c in columns
    }
    return df.withColumns(strict)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row; empty if each names at most one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def at_most_one(df: DataFrame, what: str = "row") -> DataFrame:
    """The rows of `df`, or a failed job if there are two or more.

    The limit costs nothing in truth: two rows are enough to know.
    """
    n = df.limit(2).agg(F.count("*").alias("n")).scalar()
    return df.where(
        F.when(n > 1, F.raise_error(F.lit(f"more than one {what}"))).otherwise(F.lit(True)).cast("boolean")
    )


def reason_summary(rejects: DataFrame, reason: str = "reason") -> DataFrame:
    return rejects.groupBy(reason).agg(F.count("*").alias("n_items"))
