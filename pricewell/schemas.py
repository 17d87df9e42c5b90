"""Fixed schemas of the feed and the stored tables, and the fuel-type dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATION_FLAGS = (
    "is_same_trading_and_brand_name",
    "temporary_closure",
    "permanent_closure",
    "is_motorway_service_station",
    "is_supermarket_service_station",
)
LOCATION_FIELDS = (
    "address_line_1",
    "address_line_2",
    "city",
    "country",
    "county",
    "postcode",
    "latitude",
    "longitude",
)



def struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


TEXT, NUMBER, MOMENT = T.StringType(), T.DoubleType(), T.TimestampType()
LIST = T.ArrayType(TEXT)
# Who wrote a row: the load, then its page, item and price within it. Later writers compare greater.
WRITTEN = struct(load=T.LongType(), page=T.LongType(), idx=T.IntegerType(), price_idx=T.IntegerType())

STATIONS = struct(
    node_id=TEXT, trading_name=TEXT, brand_name=TEXT,
    **{flag: T.BooleanType() for flag in STATION_FLAGS},
    fuel_types=LIST, address_line_1=TEXT, address_line_2=TEXT, city=TEXT, country=TEXT, county=TEXT,
    postcode=TEXT, latitude=NUMBER, longitude=NUMBER, postcode_key=TEXT, written=WRITTEN, last_updated=MOMENT,
)
PRICES = struct(
    node_id=TEXT, price=NUMBER, fuel_type_id=T.ShortType(), price_last_updated=MOMENT,
    price_change_effective_timestamp=MOMENT, written=WRITTEN, last_updated=MOMENT,
)
# The newest price of a station and product, as the price table last said; `stamp` is when that price changed.
LATEST = struct(
    node_id=TEXT, fuel_type_id=T.ShortType(), moment=struct(price_last_updated=MOMENT, price_change_effective_timestamp=MOMENT),
    price=NUMBER, stamp=MOMENT, last_updated=MOMENT,
)
# Prices of stations not stored yet, by the day they came.
PARKED = T.StructType([*PRICES.fields, T.StructField("arrived", TEXT)])
CURSORS = struct(id=TEXT, last_update=MOMENT, last_updated=MOMENT)
FUEL_TYPE = struct(id=T.ShortType(), name=TEXT, display_text=TEXT)

STATION_KEY = ("node_id",)
PRICE_KEY = ("node_id", "fuel_type_id", "price_last_updated", "price_change_effective_timestamp")
LATEST_KEY = ("node_id", "fuel_type_id")

# Columns the reader may never find NULL; the others are optional.
STATION_REQUIRED = ("node_id", "trading_name", "brand_name", "city", "postcode", "latitude", "longitude", "fuel_types")
PRICE_REQUIRED = ("node_id", "price", "fuel_type_id", "price_last_updated", "price_change_effective_timestamp")

# Product codes, and the text shown for each. The ids are our own.
FUEL_TYPES = (
    (1, "B7_PREMIUM", "B7 premium"),
    (2, "B7_STANDARD", "B7 standard"),
    (3, "B10", "B10"),
    (4, "HVO", "HVO"),
    (5, "E10", "Petrol E10"),
    (6, "E5", "Petrol E5"),
)
RANKING_FUEL = "E10"
POSTCODE_KEY = "postcode_key"


def fuel_types(spark: SparkSession, rows=FUEL_TYPES) -> DataFrame:
    """The dimension as literal rows, whose exact size Catalyst knows."""
    marks = ", ".join(f"(CAST(:id{n} AS SMALLINT), :name{n}, :text{n})" for n in range(len(rows)))
    args = {f"{field}{n}": v for n, row in enumerate(rows) for field, v in zip(("id", "name", "text"), row)}
    return spark.sql(f"SELECT * FROM VALUES {marks} AS t(id, name, display_text)", args)
