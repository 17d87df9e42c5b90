"""The shared tables seen as stations, products, prices and feed pages.

| here                  | there                                                     |
|-----------------------|-----------------------------------------------------------|
| station               | `customer`, its postcode made of segment and nation       |
| product               | `event_type`, five fixed values                           |
| price                 | `events`: `value` at `ts` for `user_id`                   |
| station with many ties| `supplier`, priced by `lineitem` per return flag and date |

The station key stays the BIGINT of the source; `hex_id` makes a feed id of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.session import prepare

ITEMS_PER_PAGE = 500

# The products of the events, and of the line items.
EVENT_TYPES = (
    (1, "view", "View"),
    (2, "signup", "Sign-up"),
    (3, "error", "Error"),
    (4, "purchase", "Purchase"),
    (5, "click", "Click"),
)
RETURN_FLAGS = ((1, "A", "Accepted"), (2, "N", "None"), (3, "R", "Returned"))
# The feed's product code for each event type.
FEED_CODES = {"view": "E10", "signup": "E5", "error": "B7_STANDARD", "purchase": "HVO", "click": "B10"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def coded(c: Column, rows) -> Column:
    """Id of a name from a short fixed list, without a join."""
    out = F.lit(None)
    for number, name, _ in rows:
        out = F.when(c == name, number).otherwise(out)
    return out.cast("smallint")


def event_types(spark: SparkSession) -> DataFrame:
    return schemas.fuel_types(spark, EVENT_TYPES)


def return_flags(spark: SparkSession) -> DataFrame:
    return schemas.fuel_types(spark, RETURN_FLAGS)


def hex_id(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 64, "0"))


def digest_id(c: Column) -> Column:
    return F.upper(F.sha2(c.cast("string"), 256))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    bal = F.col("c_acctbal")
    return c.select(
        F.col("c_custkey").alias("node_id"),
        F.col("c_name").alias("trading_name"),
        F.col("c_mktsegment").alias("brand_name"),
        F.when(bal >= 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(" "), "c_mktsegment")).alias("address_line_1"),
        F.when(bal >= 5000, F.lit("")).when(bal >= 2000, F.lit("Unit 1")).alias("address_line_2"),
        F.concat(F.lit("CITY_"), F.col("c_nationkey").cast("string")).alias("city"),
        F.concat(F.substring("c_mktsegment", 1, 4), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("postcode"),
        (bal / 100).alias("latitude"),
        F.col("c_nationkey").cast("double").alias("longitude"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("node_id"),
        coded(F.col("event_type"), EVENT_TYPES).alias("fuel_type_id"),
        F.col("value").alias("price"),
        ts.alias("price_last_updated"),
        F.date_trunc("MINUTE", ts).alias("price_change_effective_timestamp"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("trading_name"),
        F.col("s_nationkey").cast("string").alias("postcode"),
    )


def line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many prices of one supplier, flag and date: ties on the time of change."""
    shipped = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("node_id"),
        coded(F.col("l_returnflag"), RETURN_FLAGS).alias("fuel_type_id"),
        F.col("l_extendedprice").alias("price"),
        shipped.alias("price_last_updated"),
        (shipped + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("price_change_effective_timestamp"),
    )


def pages_of(items: DataFrame, order: str, page: Column) -> DataFrame:
    """Page texts: the `item` JSON of each page as an array, in `order`. A page is small by design."""
    return (
        items.groupBy(page.alias("batch_number"))
        .agg(F.array_sort(F.collect_list(F.struct(order, "item"))).alias("_i"))
        .select("batch_number", F.concat(F.lit("["), F.array_join("_i.item", ","), F.lit("]")).alias("value"))
    )


def page_number(key: str) -> Column:
    return (F.floor(F.col(key) / ITEMS_PER_PAGE) + 1).cast("bigint")


def station_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a feed item; some carry a fault, told by their balance or segment."""
    s = stations(spark, sf_dir)
    low = F.col("latitude") < -5
    item = F.struct(
        hex_id(F.col("node_id")).alias("node_id"),
        F.when(~low, F.col("trading_name")).alias("trading_name"),
        "brand_name",
        F.lit(False).alias("temporary_closure"),
        F.lit(None).cast("boolean").alias("permanent_closure"),
        F.struct(
            "address_line_1", "address_line_2", "city", "postcode", "latitude",
            F.when(F.col("brand_name") == "MACHINERY", F.col("longitude").cast("string")).alias("longitude_text"),
            F.when(F.col("brand_name") != "MACHINERY", F.col("longitude")).alias("longitude"),
        ).alias("location"),
        F.array(F.lit("E10"), F.lit("E5")).alias("fuel_types"),
        F.lit("ignored").alias("opening_times"),
    )
    texts = s.select("node_id", F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))
    return pages_of(texts, "node_id", page_number("node_id"))


def price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a feed item of one price; purchases correct it at once by a second.

    Faults: no id on errors below 20, no name on sign-ups above 200, a price as text
    on clicks below 5.
    """
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    code = F.lit(None)
    for name, feed_code in FEED_CODES.items():
        code = F.when(kind == name, feed_code).otherwise(code)
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    since = F.date_format(F.date_trunc("MINUTE", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    number = F.to_json(F.struct(value.alias("v")))
    amount = F.regexp_extract(number, r":(.*)\}", 1)
    text = F.when((kind == "click") & (value < 5), F.concat(F.lit('"'), amount, F.lit('"'))).otherwise(amount)

    def price(price_text: Column) -> Column:
        return F.concat(
            F.lit('{"fuel_type":"'), code, F.lit('","price":'), price_text, F.lit(',"price_last_updated":"'), at,
            F.lit('","price_change_effective_timestamp":"'), since, F.lit('"}'),
        )

    second = F.when(kind == "purchase", F.concat(F.lit(","), price(F.lit("2.5")))).otherwise(F.lit(""))
    node = F.when((kind == "error") & (value < 20), F.lit("null")).otherwise(
        F.concat(F.lit('"'), hex_id(F.col("user_id")), F.lit('"'))
    )
    name = F.when((kind == "signup") & (value > 200), F.lit("")).otherwise(F.lit('"trading_name":"Garage",'))
    item = F.concat(
        F.lit('{"node_id":'), node, F.lit(","), name, F.lit('"public_phone_number":null,"fuel_prices":['),
        price(text), second, F.lit("]}"),
    )
    return pages_of(e.select("event_id", item.alias("item")), "event_id", page_number("event_id"))
