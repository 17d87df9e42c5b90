"""Price history as ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.functions.times import epoch_millis
from pricewell.operators import filters, groups, joins


def history_points(prices: DataFrame, fuel_types: DataFrame, node_id=None, key: str = "node_id") -> DataFrame:
    """`name`, `x` (effective time, epoch ms) and `y` (price), for one station or all."""
    return _named(_points(prices, node_id, key), fuel_types).select(key, "name", "x", "y")


def _points(prices: DataFrame, node_id, key: str) -> DataFrame:
    facts = prices if node_id is None else filters.rows_of_station(prices, node_id, key)
    return facts.select(
        key, "fuel_type_id", epoch_millis(F.col("price_change_effective_timestamp")).alias("x"), F.col("price").alias("y")
    )


def _named(rows: DataFrame, fuel_types: DataFrame) -> DataFrame:
    names = fuel_types.select("id", F.col("display_text").alias("name"))
    return joins.with_dimension(rows, names, "fuel_type_id")


def history_series(
    prices: DataFrame, fuel_types: DataFrame, node_id=None, key: str = "node_id", bucket: str = "MONTH",
    size: int = groups.POINTS_PER_CHUNK,
) -> DataFrame:
    """`name`, `data`: the points of each product in time order.

    A series longer than a calendar `bucket` or than `size` points goes over several
    rows; read in (`bucket`, `part`) order they give the whole.
    """
    points = _points(prices, node_id, key)
    when = F.date_trunc(bucket, F.timestamp_millis("x"))
    # by product id, which is short to sort and shuffle; the name comes after
    series = groups.bounded_arrays(points, [key, "fuel_type_id"], when, F.struct("x", "y"), "data", size)
    return _named(series, fuel_types).select(key, "name", "bucket", "part", "data")


def series_json(series: DataFrame, key: str = "node_id") -> DataFrame:
    """Each series row as `{"name": ..., "data": [{"x": ..., "y": ...}]}` text."""
    return series.select(key, "bucket", "part", F.to_json(F.struct("name", "data")).alias("series"))


def write_series(series: DataFrame, path: str, key: str = "node_id") -> None:
    """JSON lines, the rows of a station next to each other and in order."""
    ordered = series.repartitionByRange(key, "name", "bucket", "part").sortWithinPartitions(key, "name", "bucket", "part")
    ordered.write.mode("overwrite").json(path)
