import pytest
from feed import land, node, price, prices, station
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pricewell.session import prepare
from pricewell.sources import pages as pg
from pricewell.streaming import ingest


def decode(spark, folder, decoder, **kw):
    return decoder(pg.Feed.at(spark, str(folder)).usable(), **kw)


def test_stations_decode(spark, tmp_path):
    land(tmp_path, 1, [station(0xAB), station(2), station(3)])
    decoded = decode(spark, tmp_path, pg.decode_stations)
    rows = pg.station_rows(pg.good_items(decoded)).orderBy("idx").collect()
    assert [r["node_id"] for r in rows] == [node(0xAB).upper(), node(2), node(3)]
    first = rows[0]
    assert first["address_line_2"] == "" and first["country"] is None
    assert first["longitude"] == -1.0 and first["fuel_types"] == ["E10", "B7_STANDARD"]
    assert first["temporary_closure"] is False and first["permanent_closure"] is None
    assert pg.rejects(decoded).count() == 0


BAD_STATIONS = {
    "node_id": {"node_id": None},
    "node_id ": {"node_id": 123},
    "brand_name": {"brand_name": 7},
    "temporary_closure": {"temporary_closure": "no"},
    "fuel_types": {"fuel_types": ["E10", None]},
    "fuel_types ": {"fuel_types": [None]},
    "fuel_types  ": {"fuel_types": "E10"},
    "location.latitude": {"location": {"city": "A", "postcode": "B", "latitude": "1.5", "longitude": 1}},
    "location.address_line_1": {
        "location": {"address_line_1": 5, "city": "A", "postcode": "B", "latitude": 1, "longitude": 1}
    },
    "location.city, location.postcode, location.latitude, location.longitude": {"location": None},
}


def test_bad_stations_are_rejected_with_reason(spark, tmp_path):
    land(tmp_path, 1, [station(i, **c) for i, c in enumerate(BAD_STATIONS.values())] + [station(99), 5, None])
    decoded = decode(spark, tmp_path, pg.decode_stations)
    found = {r["idx"]: r["reason"] for r in pg.rejects(decoded).collect()}
    assert [found[i] for i in range(len(BAD_STATIONS))] == [k.strip() for k in BAD_STATIONS]
    good = pg.good_items(decoded).collect()
    assert [r["idx"] for r in good] == [len(BAD_STATIONS)]
    assert len(found) + len(good) == len(BAD_STATIONS) + 3


def test_optional_fields_may_be_missing_and_empty_list_is_fine(spark, tmp_path):
    item = station(1, fuel_types=[])
    for name in ("temporary_closure", "is_motorway_service_station"):
        del item[name]
    land(tmp_path, 1, [item])
    row = pg.station_rows(pg.good_items(decode(spark, tmp_path, pg.decode_stations))).first()
    assert row["temporary_closure"] is None and row["fuel_types"] == []


def test_prices_decode_keeps_milliseconds(spark, tmp_path):
    land(tmp_path, 1, [prices(0xAB, price(), price("E5", 150)), prices(2, price("HVO", 1.5))])
    rows = pg.price_rows(pg.good_items(decode(spark, tmp_path, pg.decode_prices))).orderBy("idx", "price_idx")
    got = rows.selectExpr("node_id", "fuel_type", "price", "unix_millis(price_last_updated) % 1000 ms").collect()
    assert [(r[1], r[2], r[3]) for r in got] == [("E10", 140.9, 123), ("E5", 150.0, 123), ("HVO", 1.5, 123)]
    assert got[0][0] == node(0xAB).upper()


def test_instant_forms(spark, tmp_path):
    forms = ["2026-03-01T10:00:00Z", "2026-03-01T12:00:00+02:00", "2026-03-01T10:00", 1772359200000]
    land(tmp_path, 1, [prices(1, *[price(updated=f) for f in forms])])
    rows = pg.price_rows(pg.good_items(decode(spark, tmp_path, pg.decode_prices)))
    assert {r[0] for r in rows.selectExpr("unix_millis(price_last_updated)").collect()} == {1772359200000}
    bad = ["2026-03-01", "2026-13-01T10:00:00Z", "yesterday", None, True, 1e30]
    land(tmp_path / "bad", 1, [prices(i, price(updated=f)) for i, f in enumerate(bad)])
    decoded = decode(spark, tmp_path / "bad", pg.decode_prices)
    assert pg.rejects(decoded).count() == len(bad) and pg.good_items(decoded).count() == 0


def test_one_bad_price_rejects_its_item_only(spark, tmp_path):
    land(tmp_path, 1, [prices(1, price(), price(amount="140")), prices(2, price()), prices(3, price(), node_id=None)])
    decoded = decode(spark, tmp_path, pg.decode_prices)
    assert {(r["idx"], r["reason"]) for r in pg.rejects(decoded).collect()} == {(0, "fuel_prices"), (2, "node_id")}
    assert [r["node_id"] for r in pg.good_items(decoded).collect()] == [node(2)]


def test_unknown_fuel_type_fails_the_page_or_is_set_aside(spark, tmp_path):
    land(tmp_path, 1, [prices(1, price("COAL")), prices(2, price())])
    failing = pg.good_items(pg.fail_on_page_error(decode(spark, tmp_path, pg.decode_prices)))
    with pytest.raises(PySparkException, match="unknown fuel type"):
        failing.collect()
    lenient = decode(spark, tmp_path, pg.decode_prices, on_unknown="quarantine")
    assert [r["reason"] for r in pg.rejects(lenient).collect()] == ["fuel_type"]
    assert pg.good_items(lenient).count() == 1


@pytest.mark.parametrize("body", ["{}", "[1, 2", "null", '"x"'])
def test_page_of_wrong_shape_fails(spark, tmp_path, body):
    land(tmp_path, 1, body)
    with pytest.raises(PySparkException, match="page 1: page is not a JSON array"):
        pg.good_items(pg.fail_on_page_error(decode(spark, tmp_path, pg.decode_stations))).collect()


@pytest.mark.parametrize(
    "pages, used",
    [
        ({1: 2, 2: 1}, {1, 2}),
        ({1: 1, 2: 0, 3: 1}, {1}),
        ({1: 1, 3: 1}, {1}),
        ({2: 1, 3: 1}, set()),
        ({1: 0}, set()),
    ],
)
def test_sequence_stops_at_first_missing_or_empty_page(spark, tmp_path, pages, used):
    for number, n in pages.items():
        land(tmp_path, number, [station(number * 10 + i) for i in range(n)])
    decoded = decode(spark, tmp_path, pg.decode_stations)
    assert {r["batch_number"] for r in pg.good_items(decoded).collect()} == used


def test_bad_page_after_the_gap_is_never_read(spark, tmp_path):
    land(tmp_path, 1, [station(1)])
    land(tmp_path, 3, "{}")
    decoded = pg.fail_on_page_error(decode(spark, tmp_path, pg.decode_stations))
    assert pg.good_items(decoded).count() == 1


def test_listing_from_texts_equals_listing_from_files(spark, tmp_path):
    land(tmp_path, 1, [station(i) for i in range(20)])
    land(tmp_path, 2, " [\n ] ")
    land(tmp_path, 3, "{}")
    land(tmp_path, 4, "[" + " " * 5000 + "]")
    from_files = {tuple(r) for r in pg.Feed.at(spark, str(tmp_path)).listing.collect()}
    from_texts = {tuple(r) for r in pg.list_pages(pg.read_pages(spark, str(tmp_path))).collect()}
    assert from_files == from_texts == {(1, True), (2, False), (3, True), (4, False)}


def test_repeated_json_keys_take_the_last(spark, tmp_path):
    land(tmp_path, 1, f'[{{"node_id": "a", "node_id": "{node(11)}", "trading_name": "t", "fuel_prices": []}}]')
    assert pg.good_items(decode(spark, tmp_path, pg.decode_prices)).first()["node_id"] == node(11).upper()


@pytest.mark.parametrize("decoder, item", [(pg.decode_stations, station), (pg.decode_prices, lambda n, **c: prices(n, price(), **c))])
def test_malformed_id_fails_the_page_or_is_set_aside(spark, tmp_path, decoder, item):
    land(tmp_path, 1, [item(1), item(2, node_id="not-hex"), item(3, node_id=node(3)[1:]), item(4, node_id=None), item(0xAB, node_id=node(0xAB).upper())])
    failing = pg.good_items(pg.fail_on_page_error(decode(spark, tmp_path, decoder)))
    with pytest.raises(PySparkException, match="page 1: malformed station id"):
        failing.collect()
    lenient = decode(spark, tmp_path, decoder, on_malformed="quarantine")
    assert sorted((r["idx"], r["reason"]) for r in pg.rejects(lenient).collect()) == [(1, "node_id"), (2, "node_id"), (3, "node_id")]
    assert sorted(r["node_id"] for r in pg.good_items(lenient).collect()) == [node(1), node(0xAB).upper()]
    with pytest.raises(ValueError):
        decode(spark, tmp_path, decoder, on_malformed="skip")


def test_location_round_trip(spark, tmp_path):
    land(tmp_path, 1, [station(1)])
    good = pg.good_items(decode(spark, tmp_path, pg.decode_stations))
    nested = pg.nest_location(pg.station_rows(good))
    assert nested.first()["location"] == good.first()["location"]


def test_scans_take_few_pages_at_once(spark, tmp_path):
    """Pages may be of a few hundred kilobytes, so a task holds a few of a file and not thousands; in a stream too."""
    prepare(spark)
    path = str(tmp_path / "pages")
    spark.range(1000).select(F.col("id").alias("batch_number"), F.repeat(F.lit("x"), 100).alias("value")).coalesce(1).write.parquet(path)
    pages = spark.read.parquet(path)
    assert len(pages.collect()) == 1000

    def batches(plan):
        metric = plan.metrics().get("numInputBatches")
        own = [metric.get().value()] if metric.isDefined() else []
        return own + [n for i in range(plan.children().size()) for n in batches(plan.children().apply(i))]

    assert sum(batches(pages._jdf.queryExecution().executedPlan())) >= 1000 / 64
    sizes = []
    stream = spark.readStream.schema(pages.schema).parquet(path)
    ingest._start(stream, lambda batch, _: sizes.append(int(batch.sparkSession.conf.get("spark.sql.parquet.columnarReaderBatchSize"))), str(tmp_path / "checkpoint"), "few", None).awaitTermination()
    assert sizes and max(sizes) <= 64
