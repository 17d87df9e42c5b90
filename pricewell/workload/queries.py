"""One query per operator or job, over the whole of the shared tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.functions import text as tx
from pricewell.functions import times as tm
from pricewell.functions.prices import repair_unit
from pricewell.operators import activity, checks, filters, groups, joins, retention
from pricewell.operators.upsert import ACTION, action_counts, upsert_rows
from pricewell.plans import history, latest, load, report, series
from pricewell.session import names_in, work_dir
from pricewell.sources import pages as pg
from pricewell.sources.keyed_table import prune_stations
from pricewell.streaming import ingest
from pricewell.streaming.activity import liveness_stream, session_stream, state_stream
from pricewell.workload import tables as wt

PREFIX = "auTo_1"
LOOKUP = sha256(b"42").hexdigest()
CURSOR = datetime(2024, 1, 16)
SINCE = datetime(2024, 1, 15)
STATION_SINCE = datetime(2001, 5, 1)
AS_OF = datetime(2024, 1, 30, 23, 59, 30)
BATCH_TS = datetime(2024, 2, 1)
SERIES_SIZE = 4
STORED_SIZE = 8
# Half literal, half wildcards.
STORED_PREFIX = "Au%1_"
PAGE_ROWS = "batch_number bigint, value string"


def micros(name: str, alias: str | None = None):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(alias or name)


# -- scans and filters ---------------------------------------------------------------


def prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = filters.stations_by_prefix(wt.stations(spark, sf), PREFIX)
    stored = found.withColumn("node_id_bin", tx.hex_to_bytes(wt.digest_id(F.col("node_id"))))
    return stored.select("node_id", tx.bytes_to_hex(F.col("node_id_bin")).alias("node_hex"), "postcode", "trading_name")


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = wt.stations(spark, sf).withColumn("node_id", wt.digest_id(F.col("node_id")))
    one = checks.at_most_one(filters.station_by_id(keyed, LOOKUP), "station")
    return report.station_detail(one)


def station_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of one station: the one the first customer stands for."""
    rows = filters.rows_of_station(wt.prices(spark, sf), 0)
    return rows.select("node_id", "fuel_type_id", "price", micros("price_last_updated"))


def id_status(spark: SparkSession, sf: str) -> DataFrame:
    """Ids as asked for by events: errors cut theirs short, sign-ups ask for a stranger."""
    e = wt.table(spark, sf, "events")
    kind, digest = F.col("event_type"), wt.digest_id(F.col("user_id"))
    asked = (
        F.when(kind == "error", F.substring(digest, 1, 63))
        .when(kind == "signup", wt.digest_id(F.concat(F.lit("x"), F.col("user_id").cast("string"))))
        .when(kind == "click", F.lower(digest))
        .otherwise(digest)
    )
    known = wt.stations(spark, sf).select(wt.digest_id(F.col("node_id")).alias("node_id"))
    return filters.id_status(e.select("event_id", asked.alias("node_id")), known).select("event_id", "status")


def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = filters.changed_since(wt.table(spark, sf, "events"), CURSOR, "ts")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", tm.feed_timestamp(ts).alias("feed_ts"),
        tm.feed_timestamp(tm.minus_seconds(ts, tm.OVERLAP_SECONDS)).alias("overlap_ts"),
    )


# -- columns -------------------------------------------------------------------------


def unit_repair(spark: SparkSession, sf: str) -> DataFrame:
    return wt.table(spark, sf, "events").select("event_id", repair_unit(F.col("value")).alias("price"))


def unit_repair_large(spark: SparkSession, sf: str) -> DataFrame:
    li = wt.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", repair_unit(F.col("l_extendedprice")).alias("price"))


def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Event times, and half an hour to midnight of each order date, as shown to a reader."""
    ts = F.col("ts").cast("timestamp")
    e = wt.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("event").alias("kind"), tm.date_label(ts).alias("label"),
    )
    # in summer the label zone is a day ahead of UTC by then
    late = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '23:30' HOUR TO MINUTE")
    o = wt.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), tm.date_label(late).alias("label"),
    )
    return e.unionByName(o)


def full_address(spark: SparkSession, sf: str) -> DataFrame:
    nested = pg.nest_location(wt.stations(spark, sf).withColumns(
        {"country": F.lit(None).cast("string"), "county": F.lit(None).cast("string")}
    ))
    flat = nested.select("node_id", "trading_name", "location.*")
    return report.station_detail(flat)


def csv_list(spark: SparkSession, sf: str) -> DataFrame:
    """Stored list text to a list and back; empty entries vanish."""
    p = wt.table(spark, sf, "part")
    stored = F.concat_ws(",", "p_brand", F.lit(""), F.replace("p_name", F.lit(" "), F.lit(",,")), "p_type", F.lit(""))
    items = tx.csv_to_list(stored)
    return p.select(
        "p_partkey", F.size(items).cast("bigint").alias("n_items"), tx.list_to_csv(items).alias("csv"),
        tx.price_text(F.col("p_size").cast("double")).alias("size_text"),
    )


def strict_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Prices per product, from rows that may hold no NULL in a required column."""
    strict = checks.require_not_null(wt.prices(spark, sf), schemas.PRICE_REQUIRED)
    return strict.groupBy("fuel_type_id").agg(
        F.count("*").alias("n_rows"), F.min("price").alias("least"), F.max("price").alias("most"),
        F.max(micros("price_last_updated")).alias("newest"),
    )


def one_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return checks.repeated_keys(wt.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# -- joins ---------------------------------------------------------------------------


def dim_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers 5 to 7 have no region and keep a NULL name."""
    li = wt.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.with_dimension(li, wt.table(spark, sf, "region"), "l_linenumber", "r_regionkey")


def dim_strict(spark: SparkSession, sf: str) -> DataFrame:
    named = wt.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("nation")
    )
    nations = wt.table(spark, sf, "nation")
    return joins.resolve_dimension(named, nations, "nation", "n_name", "n_nationkey", "nation_id")


def _solvent(spark: SparkSession, sf: str) -> DataFrame:
    return wt.table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("node_id"))


def absent_keys(spark: SparkSession, sf: str) -> DataFrame:
    page = wt.table(spark, sf, "events").select(F.col("user_id").alias("node_id"), "event_id")
    return joins.absent_rows(page, _solvent(spark, sf))


def present_rows(spark: SparkSession, sf: str) -> DataFrame:
    page = wt.table(spark, sf, "events").select(F.col("user_id").alias("node_id"), "event_id", "value")
    return joins.present_rows(page, _solvent(spark, sf))


def station_prices_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = report.stations_with_prices(
        wt.stations(spark, sf), wt.prices(spark, sf), wt.event_types(spark), bucket="WEEK", size=SERIES_SIZE
    )
    text = F.array_join(
        F.transform("fuel_prices", lambda p: F.concat_ws(
            "|", F.unix_micros(p["price_last_updated"]).cast("string"), p["fuel_type"], p["price"].cast("string"))),
        ";",
    )
    return nested.select(
        "node_id", "trading_name", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "part",
        F.size("fuel_prices").cast("bigint").alias("n_prices"), text.alias("fuel_prices"),
    )


# -- latest, report, history ---------------------------------------------------------


def _latest(prices: DataFrame) -> DataFrame:
    return groups.latest_per_type(prices).select(
        "node_id", F.col("fuel_type_id").cast("bigint").alias("fuel_type_id"), "price",
        micros("price_last_updated"), micros("price_change_effective_timestamp"),
    )


def latest_per_type(spark: SparkSession, sf: str) -> DataFrame:
    return _latest(wt.line_prices(spark, sf))


def latest_per_type_events(spark: SparkSession, sf: str) -> DataFrame:
    return _latest(wt.prices(spark, sf))


def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.latest_price_report(
        wt.stations(spark, sf), wt.prices(spark, sf), wt.event_types(spark), ranking="purchase"
    )


def postcode_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.latest_price_report(
        wt.stations(spark, sf), wt.prices(spark, sf), wt.event_types(spark), prefix="auto", ranking="purchase"
    )


def supplier_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.latest_price_report(
        wt.suppliers(spark, sf), wt.line_prices(spark, sf), wt.return_flags(spark), ranking="N"
    )


def cheapest_order(spark: SparkSession, sf: str) -> DataFrame:
    return report.stations_by_price(
        wt.stations(spark, sf), wt.prices(spark, sf), wt.event_types(spark), ranking="purchase"
    )


def history_points(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_points(wt.prices(spark, sf), wt.event_types(spark))


def history_series_json(spark: SparkSession, sf: str) -> DataFrame:
    series = history.history_series(wt.prices(spark, sf), wt.event_types(spark), bucket="WEEK", size=SERIES_SIZE)
    return history.series_json(series).select(
        "node_id", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "part", "series"
    )


def supplier_history(spark: SparkSession, sf: str) -> DataFrame:
    """Series per supplier and flag, a calendar year at most in each row."""
    series = history.history_series(wt.line_prices(spark, sf), wt.return_flags(spark), bucket="YEAR")
    return series.select(
        "node_id", "name", F.year("bucket").cast("bigint").alias("year"), "part",
        F.size("data").cast("bigint").alias("n_points"),
        F.col("data")[0]["x"].alias("first_x"), F.element_at("data", -1)["x"].alias("last_x"),
        F.array_max(F.transform("data", lambda p: p["y"])).alias("dearest"),
        F.array_join(F.transform("data", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("points"),
    )


# -- upserts and retention -----------------------------------------------------------


def last_writer(spark: SparkSession, sf: str) -> DataFrame:
    """Two pages one after the other: the finished lines, then the open ones."""
    li = wt.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", micros("l_shipdate", "shipped"), "l_orderkey", "l_linenumber", "l_extendedprice",
        "l_linestatus",
    )
    pages = (
        li.where("l_linestatus = 'F'").withColumn("batch_number", F.lit(1).cast("bigint"))
        .unionByName(li.where("l_linestatus <> 'F'").withColumn("batch_number", F.lit(2).cast("bigint")))
        .drop("l_linestatus")
    )
    return groups.last_writer(
        pages, ["l_suppkey", "l_returnflag", "shipped"], ["batch_number", "l_orderkey", "l_linenumber"]
    )


def upsert_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Orders before 2000 meet a later load of all since 1998, its urgent ones repriced."""
    o = wt.table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    target = o.where("o_orderdate < timestamp_ntz '2000-01-01'").select(*columns, F.col("day").alias("last_updated"))
    repriced = F.when(F.col("o_orderpriority") == "1-URGENT", repair_unit(F.col("o_totalprice")))
    source = o.where("o_orderdate >= timestamp_ntz '1998-01-01'").select(*columns).withColumn(
        "o_totalprice", F.coalesce(repriced, "o_totalprice")
    )
    merged = upsert_rows(target, source, ["o_orderkey"], BATCH_TS)
    return merged.select(*columns, micros("last_updated"), F.col(ACTION).alias("action"))


def _price_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Prices stored as they came up to the 20th meet a repaired load from the 10th on."""
    stored = wt.prices(spark, sf).withColumns({
        "price_last_updated": tm.to_second(F.col("price_last_updated")),
        "price_change_effective_timestamp": tm.to_second(F.col("price_change_effective_timestamp")),
    })
    once = groups.last_writer(stored, list(schemas.PRICE_KEY), ["price"])
    at = F.col("price_last_updated")
    target = once.where(at < tm.utc_literal(datetime(2024, 1, 20))).withColumn("last_updated", at)
    source = once.where(at >= tm.utc_literal(datetime(2024, 1, 10))).withColumn("price", repair_unit(F.col("price")))
    return upsert_rows(target, source, schemas.PRICE_KEY, BATCH_TS, update=["price"])


def upsert_one_column(spark: SparkSession, sf: str) -> DataFrame:
    return _price_merge(spark, sf).select(
        "node_id", F.col("fuel_type_id").cast("bigint").alias("fuel_type_id"), micros("price_last_updated"), "price",
        micros("last_updated"), F.col(ACTION).alias("action"),
    )


def upsert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _price_merge(spark, sf).agg(*action_counts())


def prune_prices(spark: SparkSession, sf: str) -> DataFrame:
    e = wt.table(spark, sf, "events").withColumn("last_updated", F.col("ts").cast("timestamp"))
    return retention.prune_rows(e, SINCE).select("event_id", "user_id", micros("last_updated"))


def prune_stations_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's station is as old as the last order; prices of old ones go too."""
    last = wt.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(
        F.max("o_orderdate").cast("timestamp").alias("last_updated")
    )
    prices = wt.table(spark, sf, "events").select(F.col("user_id").alias("node_id"), "event_id")
    kept, rows = retention.prune_stations(last, prices, STATION_SINCE)
    stations = kept.select("node_id", F.lit(None).cast("bigint").alias("event_id"), F.lit("station").alias("kind"))
    return stations.unionByName(rows.select("node_id", "event_id", F.lit("price").alias("kind")))


# -- feed pages ----------------------------------------------------------------------


def station_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every station item with its fate: empty reason if good."""
    decoded = pg.fail_on_page_error(pg.decode_stations(wt.station_pages(spark, sf)))
    good = pg.station_rows(pg.good_items(decoded)).select(
        "batch_number", "idx", "node_id", "address_line_2", "longitude", F.lit("").alias("reason")
    )
    bad = pg.rejects(decoded).select("batch_number", "idx", "reason")
    both = good.unionByName(bad, allowMissingColumns=True)
    return both.withColumn("idx", F.col("idx").cast("bigint"))


def price_items(spark: SparkSession, sf: str) -> DataFrame:
    decoded = pg.fail_on_page_error(pg.decode_prices(wt.price_pages(spark, sf)))
    return pg.price_rows(pg.good_items(decoded)).select(
        "batch_number", F.col("idx").cast("bigint").alias("idx"), F.col("price_idx").cast("bigint").alias("price_idx"),
        "node_id", "fuel_type", "price", F.unix_millis("price_last_updated").alias("updated_ms"),
        F.unix_millis("price_change_effective_timestamp").alias("effective_ms"),
    )


def reject_summary(spark: SparkSession, sf: str) -> DataFrame:
    stations = pg.rejects(pg.decode_stations(wt.station_pages(spark, sf))).select(F.lit("stations").alias("feed"), "reason")
    prices = pg.rejects(pg.decode_prices(wt.price_pages(spark, sf))).select(F.lit("prices").alias("feed"), "reason")
    return checks.reason_summary(
        stations.unionByName(prices).select(F.concat_ws(": ", "feed", "reason").alias("reason"))
    )


def unknown_types(spark: SparkSession, sf: str) -> DataFrame:
    """Rejects when the feed knows no HVO and unknown codes are set aside."""
    known = [code for code in wt.FEED_CODES.values() if code != "HVO"]
    decoded = pg.decode_prices(wt.price_pages(spark, sf), known, on_unknown="quarantine")
    return pg.rejects(decoded).select("batch_number", F.col("idx").cast("bigint").alias("idx"), "reason")


def page_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 20 events listing those above 100; a page of none ends the sequence."""
    e = wt.table(spark, sf, "events")
    page = (F.floor(F.col("event_id") / 20) + 1).cast("bigint")
    listed = F.when(F.col("value") > 100, F.col("event_id").cast("string"))
    pages = e.groupBy(page.alias("batch_number")).agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(listed)), ","), F.lit("]")).alias("value")
    )
    n_items = F.size(F.from_json("value", "array<bigint>")).cast("bigint")
    return pages.select("batch_number", n_items.alias("n_items"), pg.is_used(pg.list_pages(pages)).alias("used"))


def _nine_tenths(pages: DataFrame) -> int:
    """A page number at nine tenths of the highest, from 1 on."""
    return max(1, pages.agg(F.max("batch_number")).first()[0] * 9 // 10)


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 500 events landed as files, each padded with blanks; the one at nine tenths has no item."""
    e = wt.table(spark, sf, "events")
    page = (F.floor(F.col("event_id") / 500) + 1).cast("bigint")
    listed = F.when(page != _nine_tenths(e.select(page.alias("batch_number"))), F.col("event_id").cast("string"))
    pages = e.groupBy(page.alias("batch_number")).agg(
        F.concat(F.lit("[" + " " * 5000), F.array_join(F.array_sort(F.collect_list(listed)), ","), F.lit("]")).alias("value")
    )
    root = work_dir(spark, "page-files")
    pages.repartition("batch_number").write.partitionBy("batch_number").text(root)
    n_items = F.size(F.from_json("value", "array<bigint>")).cast("bigint")
    return pg.Feed.at(spark, root).usable().select("batch_number", n_items.alias("n_items"))


def _stored(store: load.Store) -> DataFrame:
    return store.prices.read().select(
        "node_id", F.col("fuel_type_id").cast("bigint").alias("fuel_type_id"), "price",
        micros("price_last_updated"), micros("price_change_effective_timestamp"),
    )


def _land(spark: SparkSession, sf: str, root: str) -> None:
    """Both feeds as page rows in files, the way pages wait to be read."""
    for name, pages in (("stations", wt.station_pages(spark, sf)), ("prices", wt.price_pages(spark, sf))):
        pages.write.parquet(f"{root}/landed/{name}")


def _feeds(spark: SparkSession, root: str) -> list[pg.Feed]:
    return [pg.Feed.of(spark.read.schema(PAGE_ROWS).parquet(f"{root}/landed/{name}")) for name in ("stations", "prices")]


def full_load(spark: SparkSession, sf: str) -> DataFrame:
    """Both feeds into empty tables; the stored prices."""
    root = work_dir(spark, "full-load")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    load.full_load(store, *_feeds(spark, root), BATCH_TS)
    return _stored(store)


def partial_load(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a cursor: prices changed before it are left out."""
    root = work_dir(spark, "partial-load")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    load.write_cursor(store, CURSOR, CURSOR)
    load.partial_update(store, *_feeds(spark, root), BATCH_TS, snapshot=True)
    stored = _stored(store)
    cursor = store.cursors.read().select(
        F.col("id").alias("node_id"), F.lit(None).cast("bigint").alias("fuel_type_id"),
        F.lit(None).cast("double").alias("price"), micros("last_update", "price_last_updated"),
        F.lit(None).cast("bigint").alias("price_change_effective_timestamp"),
    )
    return stored.unionByName(cursor)


def increment_load(spark: SparkSession, sf: str) -> DataFrame:
    """An increment that holds prices from long before the cursor: all that the feed returned is stored, and the cursor moves."""
    root = work_dir(spark, "increment-load")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    load.write_cursor(store, CURSOR, CURSOR)
    load.partial_update(store, *_feeds(spark, root), BATCH_TS)
    moved = F.unix_micros(store.cursors.read().select("last_update").scalar())
    return _stored(store).withColumn("cursor", moved)


def malformed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Both feeds with malformed ids from nine tenths of the station pages on: failing there, and with those items set aside."""
    root = work_dir(spark, "malformed-ids")
    _land(spark, sf, root)
    stations, prices = _feeds(spark, root)
    from_page = _nine_tenths(stations.pages)
    cut = F.when(F.col("batch_number") >= from_page, F.replace("value", F.lit('"node_id":"0'), F.lit('"node_id":"x'))).otherwise(F.col("value"))
    cut_stations, cut_prices = (pg.Feed.of(feed.pages.withColumn("value", cut)) for feed in (stations, prices))
    found = []
    for how in ("fail", "quarantine"):
        store = load.Store.at(spark, f"{root}/{how}").create()
        for part, feed in ((load.load_stations, cut_stations), (load.load_prices, cut_prices)):
            try:
                done = part(store, feed, BATCH_TS, on_malformed=how)
                found.append(done.rejects.select(F.lit(f"{how}: rejected").alias("kind"), F.col("reason").alias("name")))
            except load.FeedError:
                found.append(spark.range(1).select(F.lit(f"{how}: failed").alias("kind"), F.lit(part.__name__).alias("name")))
        found += [store.stations.read().select(F.lit(f"{how}: station").alias("kind"), F.col("node_id").alias("name"))]
        found += [store.prices.read().select(F.lit(f"{how}: price").alias("kind"), F.col("node_id").alias("name"))]
    return reduce(DataFrame.unionByName, found).groupBy("kind", "name").agg(F.count("*").alias("n_items"))


def _loaded(spark: SparkSession, sf: str, name: str) -> load.Store:
    root = work_dir(spark, name)
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    load.full_load(store, *_feeds(spark, root), BATCH_TS)
    return store


def stored_postcode_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report under a prefix with wildcards, on stored tables: a range of the folded postcode reaches the scan."""
    store = _loaded(spark, sf, "stored-prefix")
    return report.latest_price_report(store.stations.read(), store.prices.read(), store.fuel_types, STORED_PREFIX, "HVO")


def stored_station_history(spark: SparkSession, sf: str) -> DataFrame:
    """Points and details of the first priced station by id, read by its key from stored tables."""
    store = _loaded(spark, sf, "stored-history")
    first = store.prices.read().agg(F.min("node_id")).first()[0]
    points = history.history_points(store.prices.read(key=first), store.fuel_types)
    detail = report.station_detail(store.stations.read(key=first))
    return points.join(joins.station_side(detail, "node_id", "full_address"), "node_id").select("node_id", "name", "x", "y", "full_address")


def report_after_increments(spark: SparkSession, sf: str) -> DataFrame:
    """The report from kept newest prices, after three increments of the price pages and a prune of what only the first stored."""
    root = work_dir(spark, "kept-report")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    stations, prices = _feeds(spark, root)
    load.load_stations(store, stations, SINCE)
    for n in range(3):
        now = SINCE + timedelta(days=n)
        load.apply_prices(store, prices.pages.where(F.col("batch_number") % 3 == n), now).release(spark)
        latest.refresh(store, now)
    latest.prune_prices(store, SINCE + timedelta(days=1), BATCH_TS)
    return latest.maintained_report(store, ranking="HVO")


def series_append(spark: SparkSession, sf: str) -> DataFrame:
    """Series per supplier and flag stored in parts: the early lines, then the late ones, then one line number of all dates."""
    prices = wt.line_prices(spark, sf).withColumn("line", F.hour("price_change_effective_timestamp"))
    points = prices.select("node_id", "fuel_type_id", tm.epoch_millis(F.col("price_change_effective_timestamp")).alias("x"), F.col("price").alias("y"), "line")
    table = series.series_table(spark, work_dir(spark, "series"), points.schema["node_id"].dataType).create()
    late, early = F.col("line") == 3, F.col("x") < int(datetime(1997, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    for n, part in enumerate((~late & early, ~late & ~early, late)):
        series.append(table, points.where(part), BATCH_TS, "YEAR", STORED_SIZE, batch_id=n)
    return table.read().select(
        "node_id", F.col("fuel_type_id").cast("bigint").alias("fuel_type_id"), F.year("bucket").cast("bigint").alias("year"), F.col("nth").alias("part"), "n",
        F.array_join(F.transform("data", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("points"),
    )


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same feeds as page streams, in several micro-batches; the stored prices."""
    root = work_dir(spark, "stream-ingest")
    _land(spark, sf, root)

    def landed(name: str) -> DataFrame:
        reader = spark.readStream.schema(PAGE_ROWS).option("maxFilesPerTrigger", 4)
        return reader.parquet(f"{root}/landed/{name}")

    store = load.Store.at(spark, f"{root}/store").create()
    ingest.ingest_available(store, landed("stations"), landed("prices"), f"{root}/checkpoint", lambda: BATCH_TS)
    return _stored(store)


def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """The price feed in two halves, the second under a new checkpoint, and the first started once more."""
    root = work_dir(spark, "stream-restart")
    _land(spark, sf, root)
    pages = spark.read.schema(PAGE_ROWS).parquet(f"{root}/landed/prices")
    for half in (0, 1):
        pages.where(F.col("batch_number") % 2 == half).write.parquet(f"{root}/half/{half}")
    store = load.Store.at(spark, f"{root}/store").create()

    def landed(path: str) -> DataFrame:
        return spark.readStream.schema(PAGE_ROWS).option("maxFilesPerTrigger", 4).parquet(f"{root}/{path}")

    ingest.station_stream(store, landed("landed/stations"), f"{root}/checkpoint/stations", clock=lambda: BATCH_TS).awaitTermination()
    for half in (0, 1, 0):
        ingest.price_stream(store, landed(f"half/{half}"), f"{root}/checkpoint/{half}", clock=lambda: BATCH_TS).awaitTermination()
    return _stored(store)


def _landed(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    return spark.readStream.schema(PAGE_ROWS).option("maxFilesPerTrigger", files).parquet(path)


def stream_late_station(spark: SparkSession, sf: str) -> DataFrame:
    """Prices that land before any station: parked, and stored once the stations are."""
    root = work_dir(spark, "stream-late")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    feeds = {name: _landed(spark, f"{root}/landed/{name}") for name in ("stations", "prices")}
    ingest.price_stream(store, feeds["prices"], f"{root}/early", clock=lambda: BATCH_TS).awaitTermination()
    ingest.station_stream(store, feeds["stations"], f"{root}/checkpoint", clock=lambda: BATCH_TS).awaitTermination()
    load.retry_parked(store, BATCH_TS)
    return _stored(store)


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What the page streams left out, by reason."""
    root = work_dir(spark, "stream-rejects")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    feeds = [_landed(spark, f"{root}/landed/{name}") for name in ("stations", "prices")]
    ingest.ingest_available(store, *feeds, f"{root}/checkpoint", lambda: BATCH_TS)
    why = ingest.rejects(store).select(F.concat_ws(": ", "feed", "reason").alias("reason"))
    return why.unionByName(ingest.absents(store).select(F.lit("absent station").alias("reason"))).groupBy("reason").agg(
        F.count("*").alias("n_items")
    )


def stream_out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every price page is corrected by a later page, which lands first; a stream started again on the rest leaves the corrections."""
    root = work_dir(spark, "stream-order")
    _land(spark, sf, root)
    pages = spark.read.schema(PAGE_ROWS).parquet(f"{root}/landed/prices")
    last = pages.agg(F.max("batch_number")).first()[0]
    dearer = F.regexp_replace("value", r'"price":(\d)', r'"price":1$1')
    pages.select((F.col("batch_number") + last).alias("batch_number"), dearer.alias("value")).write.parquet(f"{root}/feed")
    store = load.Store.at(spark, f"{root}/store").create()
    ingest.station_stream(store, _landed(spark, f"{root}/landed/stations"), f"{root}/checkpoint/stations", clock=lambda: BATCH_TS).awaitTermination()
    for moment in (SINCE, BATCH_TS):
        ingest.price_stream(store, _landed(spark, f"{root}/feed", 8), f"{root}/checkpoint/prices", clock=lambda at=moment: at).awaitTermination()
        if moment == SINCE:
            pages.write.mode("append").parquet(f"{root}/feed")
    return _stored(store)


def stream_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The price feed landed twice within the overlap: what its stream left out, counted once."""
    root = work_dir(spark, "stream-overlap")
    _land(spark, sf, root)
    pages = spark.read.schema(PAGE_ROWS).parquet(f"{root}/landed/prices")
    for again in (0, 60):
        pages.withColumn("landed", tm.utc_literal(BATCH_TS + timedelta(seconds=again))).write.mode("append").parquet(f"{root}/feed")
    store = load.Store.at(spark, f"{root}/store").create()
    ingest.station_stream(store, _landed(spark, f"{root}/landed/stations"), f"{root}/checkpoint/stations", clock=lambda: BATCH_TS).awaitTermination()
    feed = spark.readStream.schema(f"{PAGE_ROWS}, landed timestamp").option("maxFilesPerTrigger", 8).parquet(f"{root}/feed")
    ingest.price_stream(store, feed, f"{root}/checkpoint/prices", clock=lambda: BATCH_TS).awaitTermination()
    counts = []
    for kind, why in (("rejects", F.col("reason")), ("absents", F.lit("absent station"))):
        if names_in(spark, f"{store.path}/{kind}"):
            ingest.ledger_stream(store, kind, f"{root}/once/{kind}", f"{root}/checkpoint/{kind}").awaitTermination()
            once = spark.read.schema(ingest.LEDGER[kind]).parquet(f"{root}/once/{kind}")
            counts.append(once.where("feed = 'prices'").groupBy(why.alias("reason")).agg(F.count("*").alias("n_items")))
    return reduce(DataFrame.unionByName, counts)


def parked_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Prices parked on two days before any station comes; the first day is let go, the second stored."""
    root = work_dir(spark, "parked-expiry")
    _land(spark, sf, root)
    pages = spark.read.schema(PAGE_ROWS).parquet(f"{root}/landed/prices")
    store = load.Store.at(spark, f"{root}/store").create()
    for half, moment in ((0, SINCE), (1, BATCH_TS)):
        pages.where(F.col("batch_number") % 2 == half).write.parquet(f"{root}/half/{half}")
        ingest.price_stream(store, _landed(spark, f"{root}/half/{half}", 8), f"{root}/checkpoint/{half}", clock=lambda at=moment: at).awaitTermination()
    load.expire_beside(store, BATCH_TS, keep=timedelta(days=7))
    ingest.station_stream(store, _landed(spark, f"{root}/landed/stations"), f"{root}/checkpoint/stations", clock=lambda: BATCH_TS).awaitTermination()
    load.retry_parked(store, BATCH_TS)
    return _stored(store)


def malformed_page(spark: SparkSession, sf: str) -> DataFrame:
    """The price feed with the page at nine tenths cut off: the load fails there, the pages before stay stored."""
    root = work_dir(spark, "malformed-page")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    stations, prices = _feeds(spark, root)
    load.load_stations(store, stations, BATCH_TS)
    cut = F.when(F.col("batch_number") == _nine_tenths(prices.pages), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    try:
        load.load_prices(store, pg.Feed.of(prices.pages.withColumn("value", cut)), BATCH_TS)
    except load.FeedError:
        pass
    return _stored(store)


def stored_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """A store whose product dimension has one product more, which purchases are of; the stored prices."""
    root = work_dir(spark, "stored-dimension")
    _land(spark, sf, root)
    types = schemas.fuel_types(spark, [*schemas.FUEL_TYPES, (9, "SYN", "Synthetic")])
    store = load.Store.at(spark, f"{root}/store").create(types)
    stations, prices = _feeds(spark, root)
    named = prices.pages.withColumn("value", F.replace("value", F.lit('"HVO"'), F.lit('"SYN"')))
    load.full_load(store, stations, pg.Feed.of(named), BATCH_TS)
    return _stored(store)


def stored_stations(spark: SparkSession, sf: str) -> DataFrame:
    """The stored station rows after the same feed was loaded twice: the second time changes nothing."""
    root = work_dir(spark, "stored-stations")
    _land(spark, sf, root)
    store = load.Store.at(spark, f"{root}/store").create()
    stations, _ = _feeds(spark, root)
    for now in (SINCE, BATCH_TS):
        load.load_stations(store, stations, now)
    return store.stations.read().select(
        "node_id", "trading_name", "brand_name", "address_line_1", "address_line_2", "city", "postcode", "latitude",
        "longitude", "temporary_closure", "permanent_closure", F.array_join("fuel_types", ",").alias("fuel_types"), micros("last_updated"),
    )


def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The latest report written as a file and read again."""
    path = work_dir(spark, "report")
    rows = latest_report(spark, sf)
    report.write_report(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def table_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Tables loaded, one brand's stations changed later, all older ones pruned with their prices."""
    root = work_dir(spark, "retention")
    store = load.Store.at(spark, root).create()
    blank = {c: F.lit(None).cast("boolean") for c in schemas.STATION_FLAGS}
    blank |= {c: F.lit(None).cast("string") for c in ("country", "county")}
    rows = wt.stations(spark, sf).withColumns(
        {**blank, "node_id": wt.hex_id(F.col("node_id")), "fuel_types": F.array(F.lit("E10"))}
    )
    store.stations.upsert(rows, SINCE)
    prices = wt.prices(spark, sf).withColumns({
        "node_id": wt.hex_id(F.col("node_id")), "price_last_updated": tm.to_second(F.col("price_last_updated")),
    })
    store.prices.upsert(groups.last_writer(prices, list(schemas.PRICE_KEY), ["price"]), SINCE)
    changed = F.when(F.col("brand_name") == "AUTOMOBILE", "CARS").otherwise(F.col("brand_name"))
    store.stations.upsert(rows.withColumn("brand_name", changed), BATCH_TS)
    prune_stations(store.stations, store.prices, BATCH_TS)
    kept = store.stations.read().groupBy("brand_name").agg(F.count("*").alias("n_rows"))
    priced = store.prices.read().groupBy("fuel_type_id").agg(F.count("*").alias("n_rows"))
    return kept.select(F.col("brand_name").alias("name"), "n_rows").unionByName(
        priced.select(F.col("fuel_type_id").cast("string").alias("name"), "n_rows")
    )


# -- activity ------------------------------------------------------------------------


def activity_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return activity.activity_sessions(wt.table(spark, sf, "events")).select(
        "user_id", micros("session_start"), micros("session_end"), "n_touches"
    )


def _touches(spark: SparkSession, sf: str) -> DataFrame:
    return wt.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def active_users(spark: SparkSession, sf: str) -> DataFrame:
    return activity.active_users(_touches(spark, sf), AS_OF).select("user_id", micros("last_touch"))


def unexpired_state(spark: SparkSession, sf: str) -> DataFrame:
    state = activity.latest_state(_touches(spark, sf))
    return activity.unexpired_state(state, AS_OF).select("user_id", micros("last_touch"), "props")


def state_latest(spark: SparkSession, sf: str) -> DataFrame:
    return activity.latest_state(_touches(spark, sf)).select("user_id", "event_id", micros("last_touch"), "props")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions the stream has closed: those that end before the watermark."""
    root = work_dir(spark, "stream-sessions")
    events = wt.table(spark, sf, "events")
    # a pattern names both a file and a folder of files
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    query = (
        session_stream(stream).writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/closed").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = spark.read.schema("user_id bigint, session_start timestamp, session_end timestamp, n_touches bigint").parquet(
        f"{root}/closed"
    )
    return closed.select("user_id", micros("session_start"), micros("session_end"), "n_touches")


def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """State that the stream has let go: the last touch before each pause of over an hour, behind the watermark."""
    root = work_dir(spark, "stream-state")
    events = wt.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    query = (
        state_stream(stream).writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/expired").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema("user_id bigint, last_touch timestamp, event_id bigint, props string").parquet(f"{root}/expired")
    return rows.select("user_id", "event_id", micros("last_touch"), "props")


def stream_active_users(spark: SparkSession, sf: str) -> DataFrame:
    """How many users were active at each full minute behind the watermark, and the newest touch among them."""
    root = work_dir(spark, "stream-active")
    events = wt.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    query = (
        liveness_stream(stream).writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/active").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema("as_of timestamp, user_id bigint, last_touch timestamp").parquet(f"{root}/active")
    return rows.groupBy(micros("as_of")).agg(F.count("*").alias("n_users"), F.max(F.unix_micros("last_touch")).alias("newest"))


QUERIES = {
    f.__name__: f
    for f in (
        prefix_scan, point_lookup, station_facts, id_status, incremental_scan, unit_repair, unit_repair_large,
        date_labels, full_address, csv_list, strict_rows, one_per_key, dim_left_join, dim_strict, absent_keys,
        present_rows, station_prices_nested, latest_per_type, latest_per_type_events, latest_report,
        postcode_report, supplier_report, cheapest_order, history_points, history_series_json, supplier_history,
        last_writer, upsert_all_columns, upsert_one_column, upsert_counts, prune_prices, prune_stations_cascade,
        station_items, price_items, reject_summary, unknown_types, page_sequence, page_files,
        full_load, partial_load, stream_ingest, stream_restart, stream_late_station, stream_rejects,
        malformed_page, stored_dimension, stored_stations, report_file, table_retention,
        activity_sessions, active_users, unexpired_state, state_latest, stream_sessions, stream_state,
        increment_load, malformed_ids, stored_postcode_report, stored_station_history, report_after_increments, series_append,
        stream_out_of_order, stream_overlap, parked_expiry, stream_active_users,
    )
}
