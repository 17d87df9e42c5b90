"""Landed pages as a stream: each micro-batch is cleaned and upserted like a batch load.

The stream's checkpoint is the cursor. Delivery is at least once and the tables skip a
micro-batch they have applied, so a restart neither loses nor repeats a change. The page
stop rule has no place here: every page that lands is taken, once. A page that fails as a
whole stops the stream, after the pages of smaller number in its batch were stored.

All pages of a stream are of one load unless they name theirs: a page that comes after one of higher number does not win
over it. A feed that is landed again and again puts each round into a folder `load=<number>`, or carries the number.

Nothing is dropped unseen. Rejected items and items of absent stations are written by batch
beside the tables, and a price that comes before its station is parked and retried.
`load.expire_beside` lets go of both by age. A stretch that is read twice lands twice; `ledger_stream` counts it once.

    <store>/rejects/day=<day>/feed=<feed>/stream=<mark>/batch=<id>     batch_number, idx, reason, raw, landed
    <store>/absents/day=<day>/feed=prices/stream=<mark>/batch=<id>     batch_number, idx, node_id, landed
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewell.functions.times import OVERLAP_SECONDS, utc_literal
from pricewell.operators import joins
from pricewell.plans import load

OF_BATCH = "landed timestamp, day string, feed string, stream string, batch bigint"
LEDGER = {
    "rejects": f"batch_number bigint, idx int, reason string, raw string, {OF_BATCH}",
    "absents": f"batch_number bigint, idx int, node_id string, {OF_BATCH}",
}
# What tells an item of a ledger from another: its feed, page, place and text.
LEDGER_KEY = {"rejects": ["feed", "batch_number", "idx", "reason", "raw"], "absents": ["feed", "batch_number", "idx", "node_id"]}
# A stretch is read again by the next run, which starts this much before the last one, as long as that ran.
LANDED_AGAIN_WITHIN = timedelta(seconds=2 * OVERLAP_SECONDS)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def replay_mark(batch: DataFrame, name: str) -> str:
    """Names the stream that a batch number belongs to: a new checkpoint is a new query, and counts from 0 again."""
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{name}@{query_id}" if query_id else name


def dealt(batch: DataFrame) -> DataFrame:
    """The pages of a micro-batch over all cores. It reads few files, each in one task, and decoding is the most work there is."""
    return batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)


def _start(pages: DataFrame, apply, checkpoint: str, name: str, every: str | None) -> StreamingQuery:
    writer = pages.writeStream.queryName(name).foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _keep(items: DataFrame, store: load.Store, kind: str, feed: str, replay: dict, now: datetime) -> None:
    """Write what a batch left out; the same batch come again on a day replaces it. A page without a time of landing came now."""
    landed = F.coalesce("landed", utc_literal(now)) if "landed" in items.columns else utc_literal(now)
    columns = [c for c in ("batch_number", "idx", "reason", "raw", "node_id") if c in items.columns]
    batch = f"{store.path}/{kind}/day={now:%Y-%m-%d}/feed={feed}/stream={replay['stream']}/batch={replay['batch_id']}"
    items.select(*columns, landed.alias("landed")).write.mode("overwrite").parquet(batch)


def rejects(store: load.Store) -> DataFrame:
    """Items that the streams rejected, with feed, stream and batch."""
    return store.spark.read.schema(LEDGER["rejects"]).parquet(f"{store.path}/rejects")


def absents(store: load.Store) -> DataFrame:
    """Price items whose station was not stored when their batch ran."""
    return store.spark.read.schema(LEDGER["absents"]).parquet(f"{store.path}/absents")


def ledger_stream(
    store: load.Store, kind: str, path: str, checkpoint: str, every: str | None = None, within: timedelta = LANDED_AGAIN_WITHIN
) -> StreamingQuery:
    """A ledger ("rejects" or "absents") without the items of pages that landed again, written to `path`.

    The first of the items that agree in feed, page, place and text and landed less than `within` apart stays. State lives as long as the
    watermark on the time of landing allows.
    """
    items = store.spark.readStream.schema(LEDGER[kind]).parquet(f"{store.path}/{kind}")
    once = items.withWatermark("landed", f"{int(within.total_seconds())} seconds").dropDuplicatesWithinWatermark(LEDGER_KEY[kind])
    writer = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def station_stream(
    store: load.Store, pages: DataFrame, checkpoint: str, every: str | None = None,
    clock: Callable[[], datetime] = utc_now, name: str = "stations", on_malformed: str = "fail",
) -> StreamingQuery:
    """Upsert station pages; `every` is a processing-time interval, else what is there now."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        replay, now = {"stream": replay_mark(batch, name), "batch_id": batch_id}, clock()
        done = load.apply_stations(store, dealt(batch), now, replay, on_malformed)
        if done.rejected:
            _keep(done.rejects, store, "rejects", "stations", replay, now)
        done.release(store.spark)
        done.report("station")

    return _start(pages, apply, checkpoint, name, every)


def price_stream(
    store: load.Store, pages: DataFrame, checkpoint: str, every: str | None = None,
    clock: Callable[[], datetime] = utc_now, name: str = "prices", on_unknown: str = "fail", on_malformed: str = "fail",
) -> StreamingQuery:
    """Upsert price pages; those of stations not stored when the batch runs are parked for a later batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        replay, now = {"stream": replay_mark(batch, name), "batch_id": batch_id}, clock()
        stations = joins.station_side(store.stations.read(), "node_id")
        load.retry_parked(store, now, stations)
        done = load.apply_prices(store, dealt(batch), now, None, on_unknown, replay, True, stations, on_malformed)
        if done.rejected:
            _keep(done.rejects, store, "rejects", "prices", replay, now)
        if done.absent:
            _keep(done.absent_items, store, "absents", "prices", replay, now)
        done.release(store.spark)
        done.report("price")

    return _start(pages, apply, checkpoint, name, every)


def ingest_available(
    store: load.Store, stations: DataFrame, prices: DataFrame, checkpoint: str,
    clock: Callable[[], datetime] = utc_now,
) -> None:
    """Take every page that has landed: the stations first, so that their prices find them."""
    station_stream(store, stations, f"{checkpoint}/stations", clock=clock).awaitTermination()
    price_stream(store, prices, f"{checkpoint}/prices", clock=clock).awaitTermination()
    load.retry_parked(store, clock())
