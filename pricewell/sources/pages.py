"""Landed feed pages: one JSON array per file, numbered from 1 in the file or folder name.

Decoding keeps every item. Each carries the names of its bad fields (`errors`), so one
pass over the text serves the good rows, the rejects and the page-level failures.

Pages may carry `load`, the number of the load they belong to, and `landed`, when they came; both go along with the items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.functions import text as tx
from pricewell.functions import variants as v

PAGE_NUMBER = r"(\d+)(?:\.json)?(?:/part-[^/]*)?$"
LOAD_NUMBER = r"/load=(\d+)/"
CARRIED = ("load", "landed")
EMPTY_PAGE = r"^\s*\[\s*\]\s*$"

# What is read of an item; other fields are ignored. Leaves stay VARIANT to show their type.
_FLAG_LEAVES = ", ".join(f"{flag}: variant" for flag in schemas.STATION_FLAGS)
_PLACE_LEAVES = ", ".join(f"{name}: variant" for name in schemas.LOCATION_FIELDS)
STATION_SHAPE = (
    f"struct<node_id: variant, trading_name: variant, brand_name: variant, {_FLAG_LEAVES}, "
    f"location: struct<{_PLACE_LEAVES}>, fuel_types: array<variant>>"
)
PRICE_SHAPE = (
    "struct<node_id: variant, trading_name: variant, public_phone_number: variant, "
    "fuel_prices: array<struct<fuel_type: variant, price: variant, price_last_updated: variant, "
    "price_change_effective_timestamp: variant>>>"
)
NOT_AN_ARRAY = "page is not a JSON array"
MALFORMED_ID = "malformed station id"


@dataclass(frozen=True)
class Feed:
    """Page texts (`batch_number`, `value`) and what is known of each page beforehand."""

    pages: DataFrame
    listing: DataFrame

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> "Feed":
        return cls.of(read_pages(spark, path))

    @classmethod
    def of(cls, pages: DataFrame) -> "Feed":
        return cls(pages, list_pages(pages))

    def usable(self) -> DataFrame:
        """The pages before the first gap."""
        return usable_pages(self.pages, self.listing)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """`batch_number`, `value`; a page is a bounded unit, so one row may hold it whole."""
    return with_page_number(spark.read.text(path, wholetext=True))


def stream_pages(spark: SparkSession, path: str, pages_per_trigger: int = 1000) -> DataFrame:
    return with_page_number(
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", pages_per_trigger)
        .load(path)
    )


def with_page_number(files: DataFrame) -> DataFrame:
    """Numbers from the path: the page, and its load if it lies in a folder `load=<number>`. `landed` is when the file was last written."""
    path = F.col("_metadata.file_path")
    number, of_load = F.regexp_extract(path, PAGE_NUMBER, 1), F.regexp_extract(path, LOAD_NUMBER, 1)
    return files.select(
        number.try_cast("bigint").alias("batch_number"), "value", of_load.try_cast("bigint").alias("load"),
        F.col("_metadata.file_modification_time").alias("landed"),
    )


def carried(rows: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in rows.columns]


def list_pages(pages: DataFrame) -> DataFrame:
    """`batch_number`, `filled` of each page: whether its array has items, whatever its length in bytes.

    A page that is filled is told at its first bytes; only blanks are read further.
    """
    return pages.select("batch_number", (~F.col("value").rlike(EMPTY_PAGE)).alias("filled"))


def first_gap(listing: DataFrame) -> DataFrame:
    """One row, `first_gap`: the lowest number from 1 up whose page is missing or empty.

    The successor of each page with items is a candidate; those that have items
    themselves drop out in an anti join, and the least of the rest ends the sequence.
    No window runs over the whole sequence.
    """
    filled = listing.where("filled").select("batch_number")
    start = listing.sparkSession.range(1, 2).toDF("batch_number")
    candidates = filled.select((F.col("batch_number") + 1).alias("batch_number")).union(start)
    return candidates.join(filled, "batch_number", "left_anti").agg(F.min("batch_number").alias("first_gap"))


def is_used(listing: DataFrame) -> Column:
    """Whether a page-by-page reader would have asked for this page and got items."""
    return (F.col("batch_number") >= 1) & (F.col("batch_number") < first_gap(listing).scalar())


def usable_pages(pages: DataFrame, listing: DataFrame) -> DataFrame:
    return pages.where(is_used(listing))


def page_items(pages: DataFrame, shape: str, typed=lambda leaf: leaf) -> DataFrame:
    """`batch_number`, `idx`, `item`, `leaf`, `page_error`; a malformed page gives one error row.

    `leaf` holds the fields of `shape` as VARIANT, in one pass over the item, given to
    `typed` to finish. It is made before the explode, so that a filter on the fields
    cannot make Spark take an item apart twice.
    """
    whole_page = F.from_json("value", "array<variant>")
    taken = F.transform(whole_page, lambda x: F.struct(x.alias("item"), F.try_variant_get(x, "$", shape).alias("leaf")))
    items = F.transform(taken, lambda i: F.struct(i["item"].alias("item"), typed(i["leaf"]).alias("leaf")))
    # A malformed page stands as one item of nothing; a JSON null is a VARIANT, so not NULL.
    # Asking the array itself after the explode would carry it along with every item.
    nothing = F.array(F.lit(None).cast("struct<item: variant>")["item"])
    nothing = F.transform(nothing, lambda x: F.struct(x.alias("item"), typed(F.try_variant_get(x, "$", shape)).alias("leaf")))
    return (
        pages.select("batch_number", *carried(pages), F.posexplode(F.coalesce(items, nothing)).alias("_pos", "_i"))
        .select("batch_number", *carried(pages), "_pos", "_i.item", "_i.leaf", F.col("_i.item").isNull().alias("_malformed"))
        .select(
            "batch_number", *carried(pages), F.when(F.col("_malformed"), -1).otherwise(F.col("_pos")).alias("idx"), "item", "leaf",
            F.when(F.col("_malformed"), NOT_AN_ARRAY).alias("page_error"),
        )
    )


def _errors(checks: dict[str, Column]) -> Column:
    """Names of the failed checks, "" if there are none, NULL for a malformed page."""
    named = [F.when(~ok, F.lit(name)) for name, ok in checks.items()]
    return F.when(F.col("page_error").isNull(), F.concat_ws(", ", *named))


def _with_raw(decoded: DataFrame) -> DataFrame:
    """Only a rejected item is worth keeping as text."""
    return decoded.withColumn("raw", F.when(F.col("errors") != "", F.to_json("item"))).drop("item")


def _id_check(node: Column, on_malformed: str, checks: dict[str, Column]) -> Column:
    """The page error of an item whose id is text, but no station id; as a failed check of the item with "quarantine"."""
    if on_malformed not in ("fail", "quarantine"):
        raise ValueError(f"on_malformed must be 'fail' or 'quarantine', not {on_malformed!r}")
    malformed = v.is_string(node) & ~F.coalesce(tx.is_station_id(v.value(node, "string")), F.lit(False))
    if on_malformed == "quarantine":
        checks["node_id"] = checks["node_id"] & ~malformed
        return F.col("page_error")
    return F.coalesce(F.col("page_error"), F.when(malformed, MALFORMED_ID))


def decode_stations(pages: DataFrame, on_malformed: str = "fail") -> DataFrame:
    """Typed station columns beside `errors`; values of a bad item are not to be used.

    An id that is no station id fails its page, or only the item when `on_malformed` is "quarantine".
    """
    leaf = F.col("leaf")
    place = leaf["location"]
    checks = {name: v.is_string(leaf[name]) for name in ("node_id", "trading_name", "brand_name")}
    page_error = _id_check(leaf["node_id"], on_malformed, checks)
    checks |= {name: v.is_optional(leaf[name], "BOOLEAN") for name in schemas.STATION_FLAGS}
    for name in ("address_line_1", "address_line_2", "country", "county"):
        checks[f"location.{name}"] = v.is_optional(place[name], "STRING")
    for name in ("city", "postcode"):
        checks[f"location.{name}"] = v.is_string(place[name])
    for name in ("latitude", "longitude"):
        checks[f"location.{name}"] = v.is_number(place[name])
    checks["fuel_types"] = v.all_strings(leaf["fuel_types"])

    kinds = {"latitude": "double", "longitude": "double"}
    location = F.struct(*[v.value(place[n], kinds.get(n, "string")).alias(n) for n in schemas.LOCATION_FIELDS])
    return _with_raw(page_items(pages, STATION_SHAPE).select(
        "batch_number", *carried(pages), "idx", "item", page_error.alias("page_error"),
        _errors(checks).alias("errors"),
        tx.normalise_id(v.value(leaf["node_id"], "string")).alias("node_id"),
        *[v.value(leaf[n], "string").alias(n) for n in ("trading_name", "brand_name")],
        *[v.value(leaf[n], "boolean").alias(n) for n in schemas.STATION_FLAGS],
        F.transform(leaf["fuel_types"], lambda x: v.value(x, "string")).alias("fuel_types"),
        location.alias("location"),
    ))


def decode_prices(pages: DataFrame, known_types=None, on_unknown: str = "fail", on_malformed: str = "fail") -> DataFrame:
    """One row per station item, its prices nested in `fuel_prices`, beside `errors`.

    A bad price makes the whole item bad. An unknown product code is graver: it fails
    the page (`page_error`), or only the item when `on_unknown` is "quarantine". So does, by `on_malformed`, an id that is no station id.
    """
    if on_unknown not in ("fail", "quarantine"):
        raise ValueError(f"on_unknown must be 'fail' or 'quarantine', not {on_unknown!r}")
    known = list(known_types or [name for _, name, _ in schemas.FUEL_TYPES])
    leaf = F.col("leaf")

    def price(p: Column) -> Column:
        return F.struct(
            F.when(v.is_string(p["fuel_type"]), v.value(p["fuel_type"], "string")).alias("fuel_type"),
            F.when(v.is_number(p["price"]), v.value(p["price"], "double")).alias("price"),
            *[v.instant(p[n]).alias(n) for n in ("price_last_updated", "price_change_effective_timestamp")],
        )

    def sound(p: Column) -> Column:
        return (
            p["fuel_type"].isNotNull() & p["price"].isNotNull()
            & p["price_last_updated"].isNotNull() & p["price_change_effective_timestamp"].isNotNull()
        )

    def typed(item: Column) -> Column:
        return F.struct(
            item["node_id"].alias("node_id"), item["trading_name"].alias("trading_name"),
            item["public_phone_number"].alias("public_phone_number"),
            F.transform(item["fuel_prices"], price).alias("fuel_prices"),
        )

    items = page_items(pages, PRICE_SHAPE, typed)
    prices = leaf["fuel_prices"]
    unknown = F.coalesce(F.exists(prices, lambda p: ~p["fuel_type"].isin(known)), F.lit(False))
    checks = {name: v.is_string(leaf[name]) for name in ("node_id", "trading_name")}
    checks["public_phone_number"] = v.is_optional(leaf["public_phone_number"], "STRING")
    checks["fuel_prices"] = F.coalesce(F.forall(prices, sound), F.lit(False))
    page_error = _id_check(leaf["node_id"], on_malformed, checks)
    if on_unknown == "quarantine":
        checks["fuel_type"] = ~unknown
    else:
        page_error = F.coalesce(page_error, F.when(unknown, "unknown fuel type"))
    return _with_raw(items.select(
        "batch_number", *carried(pages), "idx", "item", page_error.alias("page_error"),
        _errors(checks).alias("errors"),
        tx.normalise_id(v.value(leaf["node_id"], "string")).alias("node_id"),
        *[v.value(leaf[n], "string").alias(n) for n in ("trading_name", "public_phone_number")],
        prices.alias("fuel_prices"),
    ))


def fail_on_page_error(decoded: DataFrame) -> DataFrame:
    """Fail the job on the first page-level error met.

    The check sits inside `errors`, which every reader of the items filters on.
    """
    where = F.concat(F.lit("page "), F.col("batch_number").cast("string"), F.lit(": "), F.col("page_error"))
    failing = F.when(F.col("page_error").isNotNull(), F.raise_error(where)).otherwise(F.col("errors"))
    return decoded.withColumns({"errors": failing, "page_error": F.lit(None).cast("string")})


def good_items(decoded: DataFrame) -> DataFrame:
    return decoded.where("page_error is null and errors = ''").drop("page_error", "errors", "raw")


def rejects(decoded: DataFrame) -> DataFrame:
    """`batch_number`, `idx`, `reason`, `raw` of the items that failed a check, and what their pages carried."""
    return decoded.where("page_error is null and errors != ''").select(
        "batch_number", *carried(decoded), "idx", F.col("errors").alias("reason"), "raw"
    )


def station_rows(good: DataFrame) -> DataFrame:
    """Good station items with the nested location laid flat."""
    return good.select(
        "batch_number", *carried(good), "idx", "node_id", "trading_name", "brand_name", *schemas.STATION_FLAGS, "fuel_types", "location.*"
    )


def nest_location(stations: DataFrame) -> DataFrame:
    """The reverse: the eight location columns back in one struct."""
    rest = [c for c in stations.columns if c not in schemas.LOCATION_FIELDS]
    return stations.select(*rest, F.struct(*schemas.LOCATION_FIELDS).alias("location"))


def price_rows(good: DataFrame) -> DataFrame:
    """One row per price of the good items."""
    return good.select(
        "batch_number", *carried(good), "idx", "node_id", F.posexplode("fuel_prices").alias("price_idx", "_p")
    ).select(
        "batch_number", *carried(good), "idx", "price_idx", "node_id", "_p.fuel_type", "_p.price",
        "_p.price_last_updated", "_p.price_change_effective_timestamp",
    )
