"""Row filters over stations and prices."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.functions import text
from pricewell.functions.times import OVERLAP_SECONDS, utc_literal
from pricewell.operators.joins import station_side


def stations_by_prefix(stations: DataFrame, prefix: str, column: str = "postcode") -> DataFrame:
    """Stations whose postcode starts with `prefix`; an empty prefix keeps them all.

    Stored stations carry the folded postcode, by which their files are ordered: a range of it skips row groups.
    """
    if not prefix:
        return stations.where(F.col(column).isNotNull())
    if column == "postcode" and schemas.POSTCODE_KEY in stations.columns:
        return stations.where(text.key_starts_with(F.col(schemas.POSTCODE_KEY), prefix))
    return stations.where(text.starts_with(F.col(column), prefix))


def station_by_id(stations: DataFrame, node_id: str, key: str = "node_id") -> DataFrame:
    """At most one row; a malformed id finds none. The bare equality reaches the scan."""
    return stations.where(F.col(key) == node_id.upper())


def rows_of_station(rows: DataFrame, node_id, key: str = "node_id") -> DataFrame:
    return rows.where(F.col(key) == (node_id.upper() if isinstance(node_id, str) else node_id))


def id_status(requests: DataFrame, stations: DataFrame, key: str = "node_id") -> DataFrame:
    """Adds `status`: `malformed` if no id at all, else `valid` or `absent`."""
    known = station_side(stations.withColumnRenamed(key, "_known"), "_known")
    joined = requests.join(known, F.upper(requests[key]) == F.col("_known"), "left")
    well_formed = F.coalesce(text.is_station_id(requests[key]), F.lit(False))
    status = (
        F.when(~well_formed, "malformed").when(F.col("_known").isNull(), "absent").otherwise("valid")
    )
    return joined.withColumn("status", status).drop("_known")


def changed_since(
    rows: DataFrame, cursor: datetime | None, column: str = "price_last_updated",
    overlap_seconds: int = OVERLAP_SECONDS,
) -> DataFrame:
    """Rows changed since `cursor`, less the overlap; every row when there is no cursor.

    `column` is compared bare, with a literal of its own type, so Parquet can skip
    row groups by its statistics.
    """
    if cursor is None:
        return rows
    start = cursor - timedelta(seconds=overlap_seconds)
    kind = rows.schema[column].dataType.typeName()
    return rows.where(F.col(column) >= utc_literal(start, kind))


def kept_since(column: str, since: datetime | Column) -> Column:
    """Retention predicate: survives unless strictly older than `since`."""
    return F.col(column) >= (since if isinstance(since, Column) else utc_literal(since))
