"""Loading landed pages into the stored tables: whole feeds, and increments from a cursor."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.functions.prices import repair_unit
from pricewell.functions.times import next_cursor, read_from, to_second, utc_literal
from pricewell.operators import groups, joins
from pricewell.operators.filters import changed_since, station_by_id
from pricewell.operators.upsert import STAMP
from pricewell.sources import pages as pg
from pricewell.sources.keyed_table import (
    ORDER, STATION_BUCKETS, Change, KeyedTable, cursor_table, latest_table, parked_table, price_table, station_table,
)
from pricewell.session import drop_dir, names_in, work_dir

log = logging.getLogger(__name__)
CURSOR_ID = "STATIONS-AND-PRICES"
# Folders beside the tables in which streams keep, by day, what they left out.
LEDGERS = ("rejects", "absents")
# Marks decoded price items whose station is not stored.
ABSENT = "_absent"


class FeedError(RuntimeError):
    """A page that fails as a whole. The pages before it have been stored."""


@dataclass
class Loaded:
    """What became of a load. `rejects` and `absent_items` read the staged items until `release`."""

    change: Change
    rejected: int
    absent: int = 0
    older: int = 0
    rejects: DataFrame | None = field(default=None, repr=False)
    absent_items: DataFrame | None = field(default=None, repr=False)
    failure: FeedError | None = None
    staged: str = ""

    def report(self, what: str) -> "Loaded":
        """Log what was left out; a page that failed as a whole ends the load here."""
        if self.absent:
            log.error("%d %s items of absent stations", self.absent, what)
        if self.rejected:
            log.error("%d %s items rejected", self.rejected, what)
        if self.older:
            log.warning("%d %ss older than the cursor left out of a snapshot", self.older, what)
        if self.failure:
            raise self.failure
        return self

    def release(self, spark: SparkSession) -> None:
        drop_dir(spark, self.staged)


@dataclass
class Store:
    """The stored tables of one installation, by folder.

    `parked` holds prices whose station is not stored yet, `latest` what `plans.latest` keeps of the prices.
    """

    path: str
    stations: KeyedTable
    prices: KeyedTable
    cursors: KeyedTable
    parked: KeyedTable
    latest: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> "Store":
        return cls(
            path.rstrip("/"), station_table(spark, f"{path}/stations"), price_table(spark, f"{path}/prices"),
            cursor_table(spark, f"{path}/cursors"), parked_table(spark, f"{path}/parked"), latest_table(spark, f"{path}/latest"),
        )

    @property
    def spark(self) -> SparkSession:
        return self.stations.spark

    @property
    def fuel_types(self) -> DataFrame:
        """The stored product dimension."""
        return self.spark.read.schema(schemas.FUEL_TYPE).parquet(f"{self.path}/fuel_types")

    def known_types(self) -> list[str]:
        """Product codes, a handful, that decoding accepts: those of the stored dimension."""
        return [r["name"] for r in self.fuel_types.select("name").collect()]

    def create(self, fuel_types: DataFrame | None = None, station_buckets: int = STATION_BUCKETS) -> "Store":
        types = schemas.fuel_types(self.spark) if fuel_types is None else fuel_types
        types.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fuel_types")
        for table in (self.stations, self.latest):
            table.create(station_buckets)
        for table in (self.prices, self.cursors, self.parked):
            table.create()
        return self


# -- transforms shared by the batch and the streaming form ------------------------


def load_number(now: datetime) -> int:
    """The number of a load that its pages do not name: later loads have greater ones."""
    return int((now - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def written_by(rows: DataFrame, load: int) -> Column:
    """Who writes a row: its load, page, item and price, in the order in which a reader of the pages would write."""
    own = F.coalesce("load", F.lit(load)) if "load" in rows.columns else F.lit(load)
    price_idx = F.col("price_idx") if "price_idx" in rows.columns else F.lit(0)
    return F.struct(
        own.cast("bigint").alias("load"), F.col("batch_number").alias("page"), F.col("idx").cast("int").alias("idx"), price_idx.cast("int").alias("price_idx")
    ).cast(schemas.WRITTEN).alias(ORDER)


def latest_stations(good: DataFrame, load: int = 0) -> DataFrame:
    """Station rows of a load, the last writer per id."""
    rows = pg.station_rows(good)
    columns = [c for c in rows.columns if c not in ("batch_number", "idx", *pg.CARRIED)]
    return groups.last_writer(rows.select(*columns, written_by(rows, load)), schemas.STATION_KEY, [ORDER])


def clean_prices(rows: DataFrame, fuel_types: DataFrame, load: int = 0) -> DataFrame:
    """Repaired prices under their stored key, the last writer per key.

    The reduction to one row per key is partly done before its shuffle, and comes
    before the join with the stations, which then meets no repeated keys.
    """
    typed = joins.resolve_dimension(rows, fuel_types, "fuel_type").select(
        written_by(rows, load), "node_id", "fuel_type_id",
        to_second(F.col("price_last_updated")).alias("price_last_updated"),
        to_second(F.col("price_change_effective_timestamp")).alias("price_change_effective_timestamp"),
        repair_unit(F.col("price")).alias("price"),
    )
    return groups.last_writer(typed, schemas.PRICE_KEY, [ORDER])


def item_counts(marked: bool = False) -> list[Column]:
    """Aggregates over decoded items; how many good ones are of absent stations, if they are `marked`."""
    sound = F.col("page_error").isNull() & (F.col("errors") == "")
    return [
        F.count(F.when(F.col("errors") != "", True)).alias("rejected"),
        F.count(F.when(sound & F.col(ABSENT), True) if marked else F.lit(None)).alias("absent"),
        F.min(F.when(F.col("page_error").isNotNull(), F.struct("batch_number", "page_error"))).alias("bad_page"),
    ]


# -- what batch and stream do with decoded items -------------------------------------


@dataclass(frozen=True)
class Staged:
    """Decoded items written once, those before the first page that fails as a whole, and what was counted of them."""

    path: str
    items: DataFrame
    rejected: int
    absent: int
    failure: FeedError | None


def _stage(spark: SparkSession, decoded: DataFrame, name: str, known: DataFrame | None = None) -> Staged:
    """Write the decoded items once, counting them on the way, and find the first page that fails as a whole.

    Everything after reads the staged Parquet, so page text is parsed once and a lost
    executor costs a reread, not a reparse. With `known`, the side of stored stations, items are marked here
    for all that follows: one join tells which are of absent stations.
    """
    path, seen, marked = work_dir(spark, name), Observation(), known is not None
    if marked:
        # a left outer join with the items on its left, so that AQE can split those of a station with very many
        decoded = decoded.join(known.withColumn("_stored", F.lit(True)), "node_id", "left").withColumn(ABSENT, F.col("_stored").isNull()).drop("_stored")
    decoded.observe(seen, *item_counts(marked)).write.parquet(path)
    staged = spark.read.schema(decoded.schema).parquet(path)
    facts = seen.get
    if facts["bad_page"] is None:
        return Staged(path, staged, facts["rejected"], facts["absent"], None)
    number, why = facts["bad_page"]
    before = staged.where(F.col("batch_number") < number)
    counts = before.agg(*item_counts(marked)[:2]).first()
    return Staged(path, before, counts["rejected"], counts["absent"], FeedError(f"page {number}: {why}"))


def _load_of(table: KeyedTable, now: datetime, replay: dict | None) -> int:
    """A stream's pages belong to one load, however many micro-batches they come in: the one it began with."""
    began = table.began(replay["stream"]) if replay else None
    return load_number(now) if began is None else began


def apply_stations(
    store: Store, pages: DataFrame, now: datetime, replay: dict | None = None, on_malformed: str = "fail"
) -> Loaded:
    """Upsert the stations of the pages before the first that fails as a whole.

    `replay` names the stream and batch of a micro-batch. A failing one is not marked as done, so it comes again.
    """
    staged = _stage(store.spark, pg.decode_stations(pages, on_malformed), "stations")
    number = _load_of(store.stations, now, replay)
    mark = {} if staged.failure or not replay else {**replay, "began": number}
    change = store.stations.upsert(latest_stations(pg.good_items(staged.items), number), now, **mark)
    return Loaded(change, staged.rejected, rejects=pg.rejects(staged.items), failure=staged.failure, staged=staged.path)


def apply_prices(
    store: Store, pages: DataFrame, now: datetime, since: datetime | None = None, on_unknown: str = "fail",
    replay: dict | None = None, park: bool = False, stations: DataFrame | None = None, on_malformed: str = "fail",
) -> Loaded:
    """Upsert the prices of the pages before the first that fails as a whole, those of unknown stations left out.

    With `park` the latter wait in `store.parked`. `stations` is the side of known ids, if the caller has sized it.
    """
    decoded = pg.decode_prices(pages, store.known_types(), on_unknown, on_malformed)
    known = joins.station_side(store.stations.read(), "node_id") if stations is None else stations
    staged = _stage(store.spark, decoded, "prices", known)
    number = _load_of(store.prices, now, replay)
    mark = {} if staged.failure or not replay else {**replay, "began": number}
    good = pg.good_items(staged.items)
    absent, present = good.where(ABSENT), good.where(~F.col(ABSENT))
    n_older = 0
    if since is not None:
        n_older = pg.price_rows(good).where(F.col("price_last_updated") < utc_literal(since)).count()

    def clean(items: DataFrame) -> DataFrame:
        rows = pg.price_rows(items)
        return clean_prices(rows if since is None else changed_since(rows, since, overlap_seconds=0), store.fuel_types, number)

    # a stored key holds the station, so either part is reduced on its own
    if park and staged.absent:
        # before the stored ones: if the batch comes again, nothing of it is in neither table
        store.parked.upsert(clean(absent).withColumn("arrived", F.lit(f"{now:%Y-%m-%d}")), now, update=["price"])
    change = store.prices.upsert(clean(present), now, update=["price"], **mark)
    absent = absent.select("batch_number", *pg.carried(absent), "idx", "node_id")
    return Loaded(change, staged.rejected, staged.absent, n_older, pg.rejects(staged.items), absent, staged.failure, staged.path)


def retry_parked(store: Store, now: datetime, stations: DataFrame | None = None) -> Change:
    """Move the parked prices of stations stored by now to the prices.

    Who wrote a price is parked with it, so that it does not win over a later one. With nothing parked,
    which the manifest tells, nothing is read; how much can be parked is bounded by `expire_beside`.
    """
    if store.parked.is_empty():
        return Change()
    known = joins.station_side(store.stations.read(), "node_id") if stations is None else stations
    ready = joins.present_rows(store.parked.read(), known, sized=True).drop(STAMP, "arrived")
    # the same price may have been parked on several days
    change = store.prices.upsert(groups.last_writer(ready, schemas.PRICE_KEY, [ORDER]), now, update=["price"])
    if change != Change():
        store.parked.delete_matching(known, "node_id", sized=True)
    return change


def expire_beside(store: Store, now: datetime, keep: timedelta) -> int:
    """Let go of what lies beside the tables since before `now` less `keep`, a day at a time: parked prices and the ledgers of streams.

    Whole folders are unlinked by their names; no row is read. Returns how many.
    """
    first = f"{now - keep:%Y-%m-%d}"
    gone = store.parked.unlink_below(first)
    for kind in LEDGERS:
        for name in names_in(store.spark, f"{store.path}/{kind}"):
            if name.startswith("day=") and name.removeprefix("day=") < first:
                drop_dir(store.spark, f"{store.path}/{kind}/{name}")
                gone += 1
    return gone


# -- batch form --------------------------------------------------------------------


def load_stations(store: Store, feed: pg.Feed, now: datetime, on_malformed: str = "fail") -> Loaded:
    """Upsert the stations of a feed. All pages up to the first gap count."""
    return apply_stations(store, feed.usable(), now, on_malformed=on_malformed).report("station")


def load_prices(
    store: Store, feed: pg.Feed, now: datetime, since: datetime | None = None, on_unknown: str = "fail", on_malformed: str = "fail"
) -> Loaded:
    """Upsert the prices of a feed, those of unknown stations left out.

    `since` is for a feed that is a snapshot: prices changed before it are left out and counted in `older`.
    """
    return apply_prices(store, feed.usable(), now, since, on_unknown, on_malformed=on_malformed).report("price")


def full_load(store: Store, stations: pg.Feed, prices: pg.Feed, now: datetime) -> tuple[Loaded, Loaded]:
    """Stations, then prices, whatever their age. The cursor is left alone."""
    return load_stations(store, stations, now), load_prices(store, prices, now)


def read_cursor(store: Store) -> datetime | None:
    # through epoch microseconds: a collected timestamp would shift by the driver's zone
    micros = station_by_id(store.cursors.read(), CURSOR_ID, "id").select(F.unix_micros("last_update")).first()
    return None if micros is None else datetime(1970, 1, 1) + timedelta(microseconds=micros[0])


def write_cursor(store: Store, moment: datetime, now: datetime) -> None:
    spark = store.cursors.spark
    row = spark.range(1).select(F.lit(CURSOR_ID).alias("id"), utc_literal(moment).alias("last_update"))
    store.cursors.upsert(row, now)


def partial_update(
    store: Store, stations: pg.Feed, prices: pg.Feed, run_start: datetime, snapshot: bool = False
) -> tuple[Loaded, Loaded] | None:
    """Stations, then prices, changed since the cursor; the cursor moves last.

    Without a cursor nothing is done. A failure leaves the cursor, so the next run reads
    the same stretch again, and the upserts make the repeat harmless. The pages are what
    the feed returned for this cursor, and all of them is stored. Only where they hold the
    whole feed instead (`snapshot`) are prices from before the cursor left out.
    """
    cursor = read_cursor(store)
    if cursor is None:
        log.error("no cursor %s: run a full load and write one first", CURSOR_ID)
        return None
    done = (
        load_stations(store, stations, run_start),
        load_prices(store, prices, run_start, since=read_from(cursor) if snapshot else None),
    )
    write_cursor(store, next_cursor(run_start), run_start)
    return done
