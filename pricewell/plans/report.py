"""Latest-price report and station detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.functions import text as tx
from pricewell.functions.times import date_label
from pricewell.operators import filters, groups, joins


def latest_prices(stations: DataFrame, prices: DataFrame, prefix: str = "", key: str = "node_id") -> DataFrame:
    """Newest price per product for the stations under `prefix`, stations without prices left out.

    Prices are reduced to one row per station and product before they meet the stations.
    """
    chosen = filters.stations_by_prefix(stations, prefix).select(key, "trading_name")
    facts = joins.restrict_to(prices, chosen, key) if prefix else prices
    return chosen.join(groups.latest_per_type(facts, key), key)


def latest_price_report(
    stations: DataFrame, prices: DataFrame, fuel_types: DataFrame, prefix: str = "",
    ranking: str = schemas.RANKING_FUEL, key: str = "node_id",
) -> DataFrame:
    """Rows of the report, stations in order of their latest `ranking` price, missing first.

    `name` is set on the first row of a station only. `rank_price` is the sort price.
    Stations with the same price are ordered by id, rows of a station by product id.
    """
    types = fuel_types.select("id", F.col("name").alias("_code"), "display_text")
    rows = joins.with_dimension(latest_prices(stations, prices, prefix, key), types, "fuel_type_id")
    rank_price = F.max(F.when(F.col("_code") == ranking, F.col("price"))).over(Window.partitionBy(key))
    return (
        rows.select(
            key,
            groups.first_row_label(F.col("trading_name"), [key], ["fuel_type_id"]).alias("name"),
            F.col("display_text").alias("fuel_type"),
            "price",
            date_label(F.col("price_change_effective_timestamp")).alias("effective_date"),
            rank_price.alias("rank_price"),
            "fuel_type_id",
        )
        .orderBy(F.col("rank_price").asc_nulls_first(), key, "fuel_type_id")
        .drop("fuel_type_id")
    )


def stations_by_price(
    stations: DataFrame, prices: DataFrame, fuel_types: DataFrame, prefix: str = "",
    ranking: str = schemas.RANKING_FUEL, key: str = "node_id",
) -> DataFrame:
    """Every station under `prefix` with its latest `ranking` price, missing first, then cheapest.

    Only prices of the ranking product are read on.
    """
    chosen = filters.stations_by_prefix(stations, prefix).select(key, "trading_name")
    wanted = fuel_types.where(F.col("name") == ranking).select("id")
    facts = prices.where(F.col("fuel_type_id") == wanted.scalar())
    if prefix:
        facts = joins.restrict_to(facts, chosen, key)
    latest = groups.latest_per_type(facts, key).select(key, F.col("price").alias("rank_price"))
    return chosen.join(latest, key, "left").orderBy(F.col("rank_price").asc_nulls_first(), key)


def stations_with_prices(
    stations: DataFrame, prices: DataFrame, fuel_types: DataFrame, prefix: str = "", key: str = "node_id",
    bucket: str = "MONTH", size: int = groups.POINTS_PER_CHUNK,
) -> DataFrame:
    """Stations with their price lists nested; a station without prices has one empty list.

    A long list comes in several rows (see `groups.bounded_arrays`), each a whole
    station row with the next stretch of `fuel_prices`.
    """
    chosen = filters.stations_by_prefix(stations, prefix).select(key, "trading_name")
    facts = joins.restrict_to(prices, chosen, key) if prefix else prices
    named = joins.with_dimension(facts, fuel_types.select("id", F.col("name").alias("fuel_type")), "fuel_type_id")
    element = F.struct("price_last_updated", "price_change_effective_timestamp", "fuel_type", "price")
    lists = groups.bounded_arrays(
        named, [key], F.date_trunc(bucket, "price_last_updated"), element, "fuel_prices", size
    )
    # two joins, not one outer join: AQE can split the lists of a busy station in an inner join
    listed = lists.join(joins.station_side(chosen, key, "trading_name"), key)
    unlisted = chosen.join(facts.select(key).distinct(), key, "left_anti").withColumns({
        "bucket": F.lit(None).cast("timestamp"), "part": F.lit(0).cast("bigint"),
        "fuel_prices": F.array().cast(lists.schema["fuel_prices"].dataType),
    })
    return listed.unionByName(unlisted).select(
        key, "trading_name", F.lit(None).cast("string").alias("public_phone_number"), "bucket", "part", "fuel_prices"
    )


def station_detail(stations: DataFrame) -> DataFrame:
    """What the station page shows."""
    return stations.select(
        "node_id", "trading_name",
        tx.full_address(*[F.col(c) for c in ("address_line_1", "address_line_2", "city", "postcode")]).alias("full_address"),
        "latitude", "longitude",
    )


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    report.write.mode("overwrite").format(fmt).option("header", "true").save(path)
