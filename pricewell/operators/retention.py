"""Age-based removal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from pricewell.operators.filters import kept_since
from pricewell.operators.joins import absent_rows


def prune_rows(rows: DataFrame, since: datetime, column: str = "last_updated") -> DataFrame:
    """Rows not older than `since`."""
    return rows.where(kept_since(column, since))


def expired_rows(rows: DataFrame, since: datetime, column: str = "last_updated") -> DataFrame:
    return rows.where(~kept_since(column, since))


def prune_stations(
    stations: DataFrame, prices: DataFrame, since: datetime, column: str = "last_updated",
    key: str = "node_id",
) -> tuple[DataFrame, DataFrame]:
    """Kept stations, and prices less those of the removed stations.

    Anti-joining the removed ids, rather than semi-joining the kept ones, makes the
    join side small in the usual case that few stations expire.
    """
    gone = expired_rows(stations, since, column)
    return prune_rows(stations, since, column), absent_rows(prices, gone, key)
