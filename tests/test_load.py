"""Loads into the stored tables, in batch and as a stream."""

import json
from datetime import datetime, timedelta

import pytest
from feed import land, node, price, prices, station
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.plans import load
from pricewell.sources import pages as pg
from pricewell.sources.keyed_table import prune_stations
from pricewell.streaming import ingest

T0 = datetime(2026, 3, 1, 12)
T1 = T0 + timedelta(hours=1)


@pytest.fixture
def store(spark, tmp_path):
    return load.Store.at(spark, str(tmp_path / "store")).create()


@pytest.fixture
def feed(spark, tmp_path):
    def at(name, *pages):
        for number, content in enumerate(pages, start=1):
            land(tmp_path / name, number, content)
        return pg.Feed.at(spark, str(tmp_path / name))

    return at


def stored(table, *columns):
    return sorted(map(tuple, table.read().select(*columns).collect()))


def stamps(table, key):
    rows = table.read().select(key, F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    return {r[0]: r[1] for r in rows}


def test_full_load_repairs_filters_and_keeps_last_writer(store, feed):
    done = load.full_load(
        store,
        feed("s", [station(1), station(2)], [station(2, trading_name="Newer")]),
        feed("p", [prices(1, price(amount=150.0), price("E5", 1.5)), prices(3, price())],
             [prices(1, price(amount=151.0)), prices(2, price("HVO", 1500), price("HVO", 1490))]),
        T0,
    )
    assert stored(store.stations, "node_id", "trading_name") == [(node(1), "Garage 1"), (node(2), "Newer")]
    assert stored(store.prices, "node_id", "fuel_type_id", "price") == [
        (node(1), 5, 151.0), (node(1), 6, 150.0), (node(2), 4, 149.0),
    ]
    assert done[0].change.inserted == 2 and done[1].change.inserted == 3
    assert done[1].absent == 1 and [r["node_id"] for r in done[1].absent_items.collect()] == [node(3)]


def test_times_are_stored_to_the_second_and_last_in_second_wins(store, feed):
    load.load_stations(store, feed("s", [station(1)]), T0)
    load.load_prices(store, feed("p", [prices(
        1, price(amount=140, updated="2026-03-01T10:00:00.100Z"), price(amount=141, updated="2026-03-01T10:00:00.900Z"),
    )]), T0)
    assert stored(store.prices, "price", F.date_format("price_last_updated", "HH:mm:ss.SSS")) == [(141.0, "10:00:00.000")]


def test_upsert_twice_is_upsert_once_and_stamp_moves_on_change_only(store, feed):
    first = feed("s", [station(1), station(2), station(3)])
    load.load_stations(store, first, T0)
    again = load.load_stations(store, first, T1).change
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 3)
    change = load.load_stations(store, feed("s2", [station(1), station(2, brand_name="NEW"), station(4)]), T1).change
    assert (change.inserted, change.updated, change.unchanged) == (1, 1, 1)
    at = stamps(store.stations, "node_id")
    assert [at[node(n)][11:13] for n in (1, 2, 3, 4)] == ["12", "13", "12", "13"]


def test_price_conflict_changes_price_only(store, feed):
    load.load_stations(store, feed("s", [station(1)]), T0)
    load.load_prices(store, feed("p", [prices(1, price(amount=140), price("E5", 150))]), T0)
    change = load.load_prices(store, feed("p2", [prices(1, price(amount=139), price("E5", 150))]), T1).change
    assert (change.inserted, change.updated, change.unchanged) == (0, 1, 1)
    rows = stored(store.prices, "fuel_type_id", "price", F.hour("last_updated"))
    assert rows == [(5, 139.0, 13), (6, 150.0, 12)]


def test_superseded_folders_are_those_no_reader_needs(store, feed):
    load.load_stations(store, feed("s", [station(1)]), T0)
    first = {r["folder"].split("/store/")[1] for r in store.stations.superseded().collect()}
    assert first == {"stations/commits/commit=0"}
    load.load_stations(store, feed("s2", [station(1, brand_name="X")]), T1)
    old = sorted(r["folder"].split("/store/")[1] for r in store.stations.superseded().collect())
    assert old[:2] == ["stations/commits/commit=0", "stations/commits/commit=1"] and len(old) == 3 and "/c=1/" in old[2]
    assert store.stations.read().first()["brand_name"] == "X"


def test_pages_before_a_bad_one_stay_stored(store, feed):
    with pytest.raises(load.FeedError, match="page 3"):
        load.load_stations(store, feed("s", [station(1)], [station(2)], "{}", [station(4)]), T0)
    assert stored(store.stations, "node_id") == [(node(1),), (node(2),)]


def test_empty_feed_is_a_no_op(store, feed):
    assert load.load_stations(store, feed("s", []), T0).change.inserted == 0
    assert load.load_prices(store, feed("p", [prices(1, price())]), T0).change.inserted == 0
    assert store.prices.read().count() == 0


def test_partial_update_needs_a_cursor_and_moves_it_last(spark, store, feed):
    s, p = feed("s", [station(1)]), feed("p", [prices(
        1, price(updated="2026-03-01T11:58:59Z"), price(updated="2026-03-01T11:59:00Z"), price(updated="2026-03-01T12:30:00Z"),
    )])
    assert load.partial_update(store, s, p, T1) is None and store.stations.read().count() == 0
    load.write_cursor(store, T0, T0)
    _, priced = load.partial_update(store, s, p, T1, snapshot=True)
    assert priced.older == 1
    assert stored(store.prices, F.date_format("price_last_updated", "HH:mm")) == [("11:59",), ("12:30",)]
    assert load.read_cursor(store) == T1 - timedelta(seconds=60)
    with pytest.raises(load.FeedError):
        load.partial_update(store, s, feed("bad", "{}"), T1 + timedelta(hours=1))
    assert load.read_cursor(store) == T1 - timedelta(seconds=60)


def test_prune_prices_by_stamp(store, feed):
    load.load_stations(store, feed("s", [station(1)]), T0)
    load.load_prices(store, feed("p", [prices(1, price(), price(updated="2026-02-01T10:00:00Z"))]), T0)
    load.load_prices(store, feed("p2", [prices(1, price("E5"))]), T1)
    assert store.prices.read(low="2026-02-15").count() == 2 and store.prices.read(high="2026-02-15").count() == 1
    assert store.prices.prune(T0).deleted == 0
    assert store.prices.prune(T0 + timedelta(minutes=1)).deleted == 2
    assert stored(store.prices, "fuel_type_id") == [(6,)]


def test_prune_stations_takes_their_prices_along(store, feed):
    load.full_load(store, feed("s", [station(1), station(2)]),
                   feed("p", [prices(1, price()), prices(2, price(), price("E5"))]), T0)
    load.load_stations(store, feed("s2", [station(1, brand_name="X")]), T1)
    gone, dropped = prune_stations(store.stations, store.prices, T1)
    assert (gone.deleted, dropped.deleted) == (1, 2)
    assert stored(store.stations, "node_id") == [(node(1),)] == stored(store.prices, "node_id")


def test_stream_equals_batch_and_replay_is_skipped(spark, store, feed, tmp_path):
    s_pages = [[station(1), station(2)], [station(2, trading_name="Newer")], []]
    p_pages = [[prices(1, price(amount=1.4)), prices(9, price())], [prices(1, price(amount=1390)), prices(2, price("E5"))]]
    load.full_load(store, feed("s", *s_pages), feed("p", *p_pages), T0)

    other = load.Store.at(spark, str(tmp_path / "other")).create()
    ck = str(tmp_path / "ck")

    def run():
        ingest.ingest_available(
            other, pg.stream_pages(spark, str(tmp_path / "s"), 1), pg.stream_pages(spark, str(tmp_path / "p"), 1), ck,
            clock=lambda: T0,
        )

    run()
    for table in ("stations", "prices"):
        a, b = getattr(store, table).read(), getattr(other, table).read()
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    before = other.prices._manifest()
    run()
    assert other.prices._manifest() == before
    mark = next(name for name in before.batches if name.startswith("prices"))
    assert other.prices.upsert(store.prices.read().drop("last_updated"), T1, batch_id=0, stream=mark).skipped
    land(tmp_path / "p", 3, [prices(2, price("E10", 138))])
    run()
    assert other.prices.read().count() == store.prices.read().count() + 1


def test_stream_stores_pages_before_a_malformed_one_then_fails(spark, store, tmp_path):
    for number, content in enumerate([[station(1)], "{}", [station(3)]], start=1):
        land(tmp_path / "s", number, content)

    def run():
        ingest.station_stream(store, pg.stream_pages(spark, str(tmp_path / "s")), str(tmp_path / "ck")).awaitTermination()

    with pytest.raises(PySparkException):
        run()
    assert stored(store.stations, "node_id") == [(node(1),)]
    land(tmp_path / "s", 2, [station(2)])
    run()
    assert stored(store.stations, "node_id") == [(node(1),), (node(2),), (node(3),)]


def test_stream_keeps_rejects_and_parks_prices_of_late_stations(spark, store, tmp_path):
    land(tmp_path / "p", 1, [prices(1, price(amount=140)), prices(2, price(), trading_name=None), prices(3, price())])

    def run(at):
        price_pages = pg.stream_pages(spark, str(tmp_path / "p"), 1)
        ingest.price_stream(store, price_pages, str(tmp_path / "ck"), clock=lambda: at).awaitTermination()

    run(T0)
    assert store.prices.read().count() == 0 and store.parked.read().count() == 2
    assert [tuple(r) for r in ingest.rejects(store).select("feed", "idx", "reason", "batch").collect()] == [("prices", 1, "trading_name", 0)]
    assert sorted(r["idx"] for r in ingest.absents(store).collect()) == [0, 2]
    store.stations.upsert(load.latest_stations(pg.good_items(pg.decode_stations(
        spark.createDataFrame([(1, json.dumps([station(1)]))], "batch_number long, value string")))), T0)
    land(tmp_path / "p", 2, [prices(1, price(amount=139))])
    run(T1)
    assert stored(store.prices, "node_id", "price") == [(node(1), 139.0)]
    assert stored(store.parked, "node_id") == [(node(3),)]


def test_identical_rewrite_leaves_every_folder(store, feed):
    s, p = feed("s", [station(n) for n in range(6)]), feed("p", [prices(1, price(), price(updated="2026-02-01T10:00:00Z"))])
    load.full_load(store, s, p, T0)
    parts = store.stations._manifest().parts, store.prices._manifest().parts
    load.full_load(store, s, p, T1)
    assert (store.stations._manifest().parts, store.prices._manifest().parts) == parts
    change = load.load_prices(store, feed("p2", [prices(1, price(amount=1.5), price(updated="2026-02-01T10:00:00Z"))]), T1).change
    assert (change.updated, change.unchanged) == (1, 1)
    after = store.prices._manifest().parts
    assert [day for day in after if after[day] != parts[1][day]] == ["2026-03-01"]


def test_bucket_count_and_products_are_those_of_create(spark, tmp_path, feed):
    types = schemas.fuel_types(spark, [*schemas.FUEL_TYPES, (9, "SYN", "Synthetic")])
    load.Store.at(spark, str(tmp_path / "own")).create(types, station_buckets=2)
    store = load.Store.at(spark, str(tmp_path / "own"))
    load.full_load(store, feed("s", [station(n) for n in range(20)]), feed("p", [prices(1, price("SYN", 150))]), T0)
    assert sorted(store.stations._manifest().parts) == ["0000", "0001"]
    assert stored(store.prices, "fuel_type_id") == [(9,)]


def test_increment_keeps_all_that_the_feed_returned(spark, store, feed):
    s, p = feed("s", [station(1)]), feed("p", [prices(1, price(updated="2026-03-01T11:58:59Z"), price(updated="2026-03-01T12:30:00Z"))])
    load.write_cursor(store, T0, T0)
    _, priced = load.partial_update(store, s, p, T1)
    assert priced.older == 0
    assert stored(store.prices, F.date_format("price_last_updated", "HH:mm")) == [("11:58",), ("12:30",)]
