"""Stored tables: reads that skip, writers out of order, kept answers, growing series, retention beside the tables."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from feed import land, node, price, prices, station
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.functions import text as tx
from pricewell.operators import filters
from pricewell.plans import history, latest, load, report, series
from pricewell.session import names_in
from pricewell.sources import pages as pg
from pricewell.sources.keyed_table import price_table, station_table
from pricewell.streaming import ingest
from pricewell.streaming.activity import liveness_stream

T0 = datetime(2026, 3, 1, 12)
T1 = T0 + timedelta(hours=1)
DAY = timedelta(days=1)


@pytest.fixture
def store(spark, tmp_path):
    return load.Store.at(spark, str(tmp_path / "store")).create(station_buckets=2)


def page_rows(spark, *pages, **more):
    names = "".join(f", {n} {kind}" for n, (kind, _) in more.items())
    return spark.createDataFrame([(number, json.dumps(items), *(v for _, v in more.values())) for number, items in pages], f"batch_number long, value string{names}")


def stored(table, *columns):
    return sorted(map(tuple, table.read().select(*columns).collect()))


def scanned(frame):
    """Rows that the file scans of a query handed on, after those that statistics and filters in the reader skipped."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = frame.select("*")
        again.collect()
        todo, total, pushed = [again._jdf.queryExecution().executedPlan()], 0, ""
        while todo:
            plan = todo.pop()
            if plan.nodeName().startswith("Scan parquet"):
                total += plan.metrics().apply("numOutputRows").value()
                pushed += str(plan.metadata().get("PushedFilters"))
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
        return total, pushed
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# -- reads that skip ---------------------------------------------------------------------


def many_stations(spark, n):
    rows = spark.range(n).select(F.lpad(F.hex(F.col("id") * 7919), 64, "0").alias("node_id"), F.concat(F.lit("Pc"), F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("postcode"))
    others = {f.name: F.lit(None).cast(f.dataType) for f in schemas.STATIONS.fields if f.name not in ("node_id", "postcode", "last_updated")}
    return rows.withColumns(others)


def test_prefix_and_key_reads_skip_row_groups(spark, tmp_path):
    table = station_table(spark, str(tmp_path / "t"), row_group_bytes=4096).create(2)
    table.upsert(many_stations(spark, 20_000), T0)
    found = filters.stations_by_prefix(table.read(), "pC0")
    rows, pushed = scanned(found)
    assert rows < 8_000 and "GreaterThanOrEqual(postcode_key,pc0)" in pushed and "LessThan(postcode_key,pc1)" in pushed
    assert found.count() == table.read().where(F.col("postcode").startswith("Pc0")).count() > 0
    one = table.read(key=f"{7919 * 5:064X}")
    rows, pushed = scanned(one)
    assert one.count() == 1 and rows < 5_000 and "EqualTo(node_id" in pushed
    assert scanned(table.read(key="nobody"))[0] < 2_000


def test_prices_of_one_station_skip_row_groups(spark, tmp_path):
    table = price_table(spark, str(tmp_path / "p"), row_group_bytes=4096).create()
    rows = spark.range(20_000).select(
        F.lpad(F.hex(F.col("id") % 500), 64, "0").alias("node_id"), F.col("id").cast("double").alias("price"), F.lit(5).cast("smallint").alias("fuel_type_id"),
        F.timestamp_seconds(F.col("id") * 10 + 1_772_000_000).alias("price_last_updated"), F.timestamp_seconds(F.col("id")).alias("price_change_effective_timestamp"),
    )
    table.upsert(rows, T0)
    own = table.read(key=f"{77:064X}")
    assert own.count() == 40 and scanned(own)[0] < 10_000
    assert table.read(key=f"{77:064X}", low="2026-02-26").count() < 40


@pytest.mark.parametrize("prefix", ["a", "AB", "É", "a_c", "%b", "a%c", "a\\%", "a\\_c", "\\", "ab\\", "_", "\U0010ffff", "a퟿", "ß", "zz"])
def test_stored_key_finds_what_the_pattern_finds(spark, prefix):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aAbcéÉ%_\\ß퟿\U0010ffff z") for _ in range(rng.randint(0, 5))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "postcode string").withColumn("postcode_key", tx.fold(F.col("postcode")))
    by_pattern = rows.drop("postcode_key").where(tx.starts_with(F.col("postcode"), prefix))
    assert sorted(r[0] for r in filters.stations_by_prefix(rows, prefix).select("postcode").collect()) == sorted(r[0] for r in by_pattern.collect())


def test_range_of_a_head():
    assert tx.literal_head("ab%c") == "ab" and tx.literal_head("a\\%b_") == "a%b" and tx.literal_head("%a") == "" and tx.literal_head("a\\\\%") == "a\\"
    assert tx.after_all("ab") == "ac" and tx.after_all("a\U0010ffff") == "b" and tx.after_all("\U0010ffff") is None and tx.after_all("퟿") == ""


# -- one merge, counted on the way -----------------------------------------------------------


def test_folders_without_a_change_are_not_left(spark, store):
    pages = page_rows(spark, (1, [prices(1, price(), price(updated="2026-02-01T10:00:00Z"))]))
    load.apply_stations(store, page_rows(spark, (1, [station(1)])), T0)
    load.apply_prices(store, pages, T0)
    load.apply_prices(store, pages, T1)
    assert names_in(spark, f"{store.prices.path}/data") == ["c=1"] and store.prices._manifest().commit == 1
    change = load.apply_prices(store, page_rows(spark, (1, [prices(1, price(amount=1.5), price(updated="2026-02-01T10:00:00Z"))])), T1).change
    assert (change.inserted, change.updated, change.unchanged) == (0, 1, 1)
    assert names_in(spark, f"{store.prices.path}/data/c=2") and "part=2026-02-01" not in names_in(spark, f"{store.prices.path}/data/c=2")


# -- writers out of order --------------------------------------------------------------------


def test_a_page_that_comes_late_does_not_win(spark, store, tmp_path):
    def run(at, *pages):
        for number, items in pages:
            land(tmp_path / "s", number, items)
        ingest.station_stream(store, pg.stream_pages(spark, str(tmp_path / "s")), str(tmp_path / "ck"), clock=lambda: at).awaitTermination()

    run(T0, (2, [station(1, brand_name="SECOND"), station(2, brand_name="SAME")]))
    run(T1, (7, [station(1, brand_name="SEVENTH"), station(2, brand_name="SAME"), station(3)]))
    run(T1 + DAY, (3, [station(1, brand_name="THIRD"), station(2, brand_name="OTHER"), station(4)]))
    assert stored(store.stations, "node_id", "brand_name") == [(node(1), "SEVENTH"), (node(2), "SAME"), (node(3), "BRAND"), (node(4), "BRAND")]
    # the next load is a later writer whatever its page numbers
    load.load_stations(store, pg.Feed.of(page_rows(spark, (1, [station(1, brand_name="NEXT")]))), T1 + 2 * DAY)
    assert stored(store.stations, "brand_name")[1] == ("NEXT",) or ("NEXT",) in stored(store.stations, "brand_name")


def test_pages_that_name_their_load(spark, store):
    load.apply_stations(store, page_rows(spark, (1, [station(1)])), T0)
    for number, load_number, amount in ((7, 2, 150.0), (3, 1, 140.0), (1, 3, 130.0), (9, 2, 120.0)):
        load.apply_prices(store, page_rows(spark, (number, [prices(1, price(amount=amount))]), load=("long", load_number)), T0)
    assert stored(store.prices, "price") == [(130.0,)]


def test_load_number_is_read_from_the_path(spark, tmp_path):
    land(tmp_path / "load=12", 3, [station(1)])
    land(tmp_path / "other", 4, [station(1)])
    rows = pg.with_page_number(spark.read.text([str(tmp_path / "load=12"), str(tmp_path / "other")], wholetext=True))
    assert sorted((r["batch_number"], r["load"]) for r in rows.collect()) == [(3, 12), (4, None)] and rows.where("landed is null").count() == 0


def test_parked_price_does_not_win_over_a_later_page(spark, store):
    late = page_rows(spark, (2, [prices(1, price(amount=120))]), load=("long", 1))
    load.apply_prices(store, late, T0, park=True)
    load.apply_stations(store, page_rows(spark, (1, [station(1)])), T0)
    load.apply_prices(store, page_rows(spark, (5, [prices(1, price(amount=150))]), load=("long", 1)), T1)
    assert load.retry_parked(store, T1).unchanged == 1
    assert stored(store.prices, "price") == [(150.0,)] and store.parked.is_empty()


# -- retention beside the tables ----------------------------------------------------------------


def test_old_parked_prices_and_ledgers_go_by_day(spark, store, tmp_path):
    for n, at in enumerate((T0 - 9 * DAY, T0 - DAY), 1):
        land(tmp_path / "p", n, [prices(n, price()), prices(9, price(), trading_name=None)])
        ingest.price_stream(store, pg.stream_pages(spark, str(tmp_path / "p")), str(tmp_path / "ck"), clock=lambda at=at: at).awaitTermination()
    assert store.parked.read().count() == 2 and ingest.rejects(store).count() == 2 and ingest.absents(store).count() == 2
    assert load.expire_beside(store, T0, 7 * DAY) == 3
    assert stored(store.parked, "node_id") == [(node(2),)]
    assert [r["batch_number"] for r in ingest.rejects(store).collect()] == [2] == [r["batch_number"] for r in ingest.absents(store).collect()]
    assert load.expire_beside(store, T0, 7 * DAY) == 0


def test_ledger_counts_a_page_that_landed_twice_once(spark, store, tmp_path):
    feed = str(tmp_path / "feed")
    bad = [prices(1, price(), trading_name=None), prices(2, price(amount="x")), prices(3, price())]
    for again in (0, 100):
        page_rows(spark, (1, bad), (2, bad[:1]), landed=("timestamp", T0 + timedelta(seconds=again))).write.mode("append").parquet(feed)
    pages = spark.readStream.schema("batch_number long, value string, landed timestamp").option("maxFilesPerTrigger", 1).parquet(feed)
    ingest.price_stream(store, pages, str(tmp_path / "ck"), clock=lambda: T0).awaitTermination()
    assert ingest.rejects(store).count() == 6 and ingest.absents(store).count() == 2
    for kind, n in (("rejects", 3), ("absents", 1)):
        ingest.ledger_stream(store, kind, str(tmp_path / kind), str(tmp_path / f"ck-{kind}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / kind)).count() == n


# -- the kept report ----------------------------------------------------------------------------


def same_report(store):
    columns = ["node_id", "fuel_type", "price", "effective_date"]
    kept = latest.maintained_report(store).select(*columns)
    whole = report.latest_price_report(store.stations.read(), store.prices.read(), store.fuel_types).select(*columns)
    return sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect()))


def test_kept_report_follows_increments_corrections_and_prunes(spark, store):
    rng = random.Random(5)
    load.apply_stations(store, page_rows(spark, (1, [station(n) for n in range(6)])), T0)
    for n in range(4):
        items = [
            prices(s, *[price(rng.choice(["E10", "E5", "HVO"]), rng.randint(100, 200), f"2026-03-{rng.randint(1, 9):02d}T10:00:0{rng.randint(0, 2)}Z") for _ in range(4)])
            for s in range(6)
        ]
        load.apply_prices(store, page_rows(spark, (1, items)), T0 + n * DAY)
        if n != 1:  # a refresh may miss a load and take both at once
            latest.refresh(store, T0 + n * DAY)
            assert same_report(store)
    assert latest.refresh(store, T1).skipped
    latest.prune_prices(store, T0 + 2 * DAY, T0 + 4 * DAY)
    assert same_report(store) and store.latest.read().count() > 0
    load.apply_stations(store, page_rows(spark, (1, [station(n, brand_name="X") for n in range(3)])), T0 + 5 * DAY)
    latest.prune_stations(store, T0 + 5 * DAY)
    assert same_report(store) and {r[0] for r in store.latest.read().select("node_id").collect()} <= {node(n) for n in range(3)}
    latest.prune_prices(store, T0 + 9 * DAY, T0 + 9 * DAY)
    assert store.latest.read().count() == 0 == store.prices.read().count()


# -- series that grow -------------------------------------------------------------------------------


def test_series_grown_by_appends_equals_one_built_at_once(spark, tmp_path):
    rng = random.Random(3)
    day = 86_400_000
    points = [("a" if rng.random() < 0.7 else "b", rng.randint(1, 2), 1_700_000_000_000 + rng.randint(0, 60) * day, float(rng.randint(1, 3))) for _ in range(600)]
    schema = "node_id string, fuel_type_id int, x long, y double"
    table = series.series_table(spark, str(tmp_path / "s")).create()
    sizes = [0, 1, 200, 250, 400, 599, 600]
    for n, (s, e) in enumerate(zip(sizes, sizes[1:])):
        change = series.append(table, spark.createDataFrame(points[s:e], schema), T0, "MONTH", 7, batch_id=n)
        assert not change.skipped
    assert series.append(table, spark.createDataFrame(points[:1], schema), T0, "MONTH", 7, batch_id=5).skipped
    assert series.append(table, spark.createDataFrame([], schema), T0, "MONTH", 7).inserted == 0
    got = {(r["node_id"], r["fuel_type_id"], str(r["bucket"]), r["nth"]): [tuple(p) for p in r["data"]] for r in table.read().collect()}
    facts = spark.createDataFrame(points, schema).select("node_id", "fuel_type_id", F.timestamp_millis("x").alias("price_change_effective_timestamp"), F.col("y").alias("price"))
    types = schemas.fuel_types(spark, ((1, "A", "1"), (2, "B", "2")))
    want = {(r["node_id"], int(r["name"]), str(r["bucket"]), r["part"]): [tuple(p) for p in r["data"]] for r in history.history_series(facts, types, size=7).collect()}
    assert got == want


def test_appending_in_time_order_leaves_full_parts_alone(spark, tmp_path):
    table = series.series_table(spark, str(tmp_path / "s")).create()

    def add(first, last):
        series.append(table, spark.range(first, last).select(F.lit("a").alias("node_id"), F.lit(1).alias("fuel_type_id"), (F.col("id") + 1_700_000_000_000).alias("x"), F.lit(1.0).alias("y")), T0, "MONTH", 10)
        return table._manifest().parts

    before = add(0, 25)
    after = add(25, 42)
    assert len(after) == 5 and [after[p] == before.get(p) for p in sorted(after)] == [True, True, False, False, False]
    assert sum(r["n"] for r in table.read().collect()) == 42


def test_appends_among_ties_and_points_without_price(spark, tmp_path):
    points = [("a", 1, 1_700_000_000_000 + x, y) for x, y in [(1, 2.0), (1, 3.0), (2, None), (2, 1.0), (2, 5.0), (3, 1.0), (2, None), (1, 2.0), (2, 0.5), (3, None), (3, 9.0)]]
    schema = "node_id string, fuel_type_id int, x long, y double"
    table = series.series_table(spark, str(tmp_path / "s")).create()
    for s, e in ((0, 4), (4, 6), (6, 7), (7, 11)):
        series.append(table, spark.createDataFrame(points[s:e], schema), T0, "MONTH", 2)
    got = [tuple(p) for r in table.read().orderBy("nth").collect() for p in r["data"]]
    assert got == sorted(((x, y) for _, _, x, y in points), key=lambda p: (p[0], p[1] is not None, p[1] or 0.0))
    assert sorted(r["n"] for r in table.read().collect()) == [1, 2, 2, 2, 2, 2]


# -- liveness as a stream ------------------------------------------------------------------------------


def test_live_users_at_each_minute(spark, tmp_path):
    touches = [(1, T0), (1, T0 + timedelta(minutes=15)), (2, T0 + timedelta(seconds=1)), (3, T0 + timedelta(hours=3)), (4, T0 - timedelta(microseconds=1))]
    spark.createDataFrame(touches, "user_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = liveness_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("as_of timestamp, user_id long, last_touch timestamp").parquet(str(tmp_path / "out")).selectExpr("unix_micros(as_of) a", "user_id u", "unix_micros(last_touch) t").collect()
    micros = lambda m: (m - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    got = {}
    for a, u, t in rows:
        got.setdefault(a, set()).add((u, t))
    for minute in range(0, 40):
        at = T0 + timedelta(minutes=minute)
        want = {}
        for u, t in touches:
            if at - timedelta(minutes=15) < t <= at:
                want[u] = max(want.get(u, 0), micros(t))
        assert got.get(micros(at), set()) == set(want.items()), minute


def test_liveness_keeps_touches_and_not_their_minutes_over_several_runs(spark, tmp_path):
    def at(minutes):
        return T0 + timedelta(minutes=minutes)

    users = [None, "a", "b", *(f"u{n}" for n in range(30))]
    rounds = [
        [(u, at(n)) for n, u in enumerate(users)] + [("b", at(9)), ("z", at(80))],
        [("a", at(5)), ("a", at(21)), ("late", at(-60)), ("z", at(90))],
        [(None, at(40)), ("z", at(300))],
    ]
    kept = []
    for touches in rounds:
        spark.createDataFrame(touches, "user_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = liveness_stream(spark.readStream.schema("user_id string, ts timestamp").parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        kept += [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(kept) <= len(users) + 2
    rows = spark.read.schema("as_of timestamp, user_id string, last_touch timestamp").parquet(str(tmp_path / "out")).selectExpr("unix_micros(as_of) a", "user_id u", "unix_micros(last_touch) t").collect()
    micros = lambda m: (m - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    want = set()
    for minute in range(-100, 240):  # the last watermark is an hour before the last touch
        newest = {}
        for n, touches in enumerate(rounds):
            for u, t in touches:
                passed = at([-10_000, 19, 29][n])  # the watermark before the round
                if passed < at(minute) and at(minute - 15) < t <= at(minute):
                    newest[u] = max(newest.get(u, 0), micros(t))
        want |= {(micros(at(minute)), u, t) for u, t in newest.items()}
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_a_micro_batch_of_one_file_is_decoded_on_all_cores_and_joined_once(store, spark, tmp_path, monkeypatch):
    for name, items in (("stations", lambda n: [station(n)]), ("prices", lambda n: [prices(n, price()), prices(n + 100, price())])):
        page_rows(spark, *((n, items(n)) for n in range(1, 9))).coalesce(1).write.parquet(str(tmp_path / name))
    staged, release = [], load.Loaded.release
    monkeypatch.setattr(load.Loaded, "release", lambda self, session: (staged.append((len(list(Path(self.staged).glob("part-*"))), self.absent)), release(self, session)))
    feeds = [spark.readStream.schema("batch_number long, value string").parquet(str(tmp_path / name)) for name in ("stations", "prices")]
    ingest.ingest_available(store, *feeds, str(tmp_path / "ck"), lambda: T0)
    assert staged == [(spark.sparkContext.defaultParallelism, 0), (spark.sparkContext.defaultParallelism, 8)]
    assert store.prices.read().count() == 8 and store.parked.read().count() == 8 and ingest.absents(store).count() == 8
