"""Joins between prices, stations and the fuel-type dimension.

A side is broadcast only when its bytes were measured just before and are within a bound. A side beyond
the bound is joined by whatever Catalyst and AQE pick from its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of a side as measured in rows of an executor's memory, and of a dimension.
BROADCAST_BYTES = 128 << 20
DIMENSION_BYTES = 16 << 20
ROW_BYTES = 16


def side_bytes(side: DataFrame) -> Column:
    """Aggregate: bytes of the rows of `side`, texts by their length and every other column as eight."""
    width = F.lit(ROW_BYTES)
    for name, kind in side.dtypes:
        width = width + (F.coalesce(F.octet_length(F.col(name)), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    return F.coalesce(F.sum(width.cast("bigint")), F.lit(0))


def small_enough(side: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the rows of `side` take at most `max_bytes`, as measured over all of them.

    A plain sum: it adds up in the map tasks. A limit first would move that many rows
    of every task to a single one.
    """
    return side.agg(side_bytes(side)).first()[0] <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def dimension_side(dimension: DataFrame) -> DataFrame:
    """The dimension, broadcast if it is as small as one should be.

    Facts have few distinct dimension keys, so shuffling them by such a key would put
    a third of them in one task. That must not depend on an estimate.
    """
    return F.broadcast(dimension) if small_enough(dimension, DIMENSION_BYTES) else dimension


def station_side(stations: DataFrame, *columns: str) -> DataFrame:
    """Station columns to join to prices: broadcast if small, else left to AQE.

    Beyond the bound the join shuffles by station. AQE then splits the tasks of a
    station with very many prices, which it can do as long as the prices are the left
    side of an inner, semi, anti or left outer join. Each call measures; a job with several
    joins to one side asks once and hands the side on as `sized`.
    """
    side = stations.select(*columns)
    return F.broadcast(side) if small_enough(side) else side


def with_dimension(
    facts: DataFrame, dimension: DataFrame, fact_key: str, dim_key: str = "id"
) -> DataFrame:
    """Left outer: facts without a match keep NULL dimension columns."""
    lookup = dimension.withColumnRenamed(dim_key, "_dim_key")
    return facts.join(dimension_side(lookup), facts[fact_key] == F.col("_dim_key"), "left").drop("_dim_key")


def absent_rows(page: DataFrame, stations: DataFrame, key: str = "node_id", sized: bool = False) -> DataFrame:
    """Rows of the page whose station is unknown, duplicates kept."""
    return page.join(stations if sized else station_side(stations, key), key, "left_anti")


def present_rows(page: DataFrame, stations: DataFrame, key: str = "node_id", sized: bool = False) -> DataFrame:
    """Rows of the page whose station is known, duplicates kept."""
    return page.join(stations if sized else station_side(stations, key), key, "left_semi")


def resolve_dimension(
    facts: DataFrame, dimension: DataFrame, name: str, dim_name: str = "name", dim_id: str = "id",
    out: str = "fuel_type_id",
) -> DataFrame:
    """Replace a name by its id; a name the dimension lacks fails the job."""
    lookup = dimension.select(F.col(dim_name).alias("_name"), F.col(dim_id).alias("_id"))
    strict = F.when(
        F.col("_id").isNull(),
        F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(F.col(name), F.lit("NULL")))),
    ).otherwise(F.col("_id"))
    return (
        facts.join(dimension_side(lookup), facts[name] == F.col("_name"), "left")
        .withColumn(out, strict)
        .drop("_name", "_id", *([name] if name != out else []))
    )


def restrict_to(facts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop facts of other keys early, when that costs no shuffle of the facts.

    With few keys they are broadcast and the scan output shrinks at once. With many,
    the facts are left as they are: the caller aggregates them before its own join,
    which moves far fewer rows than a semi join of raw facts would.
    """
    wanted = keys.select(key)
    if small_enough(wanted):
        return facts.join(F.broadcast(wanted), key, "left_semi")
    return facts
