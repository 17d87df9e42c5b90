import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.operators import activity, checks, filters, groups, joins, retention
from pricewell.operators.upsert import ACTION, upsert_rows
from pricewell.plans import history, report
from pricewell.streaming.activity import rows_too_late, session_stream, state_stream

T0 = datetime(2026, 3, 1, 12)
PRICE = "node_id string, fuel_type_id smallint, price double, u string, e string"


def price_df(spark, rows):
    stamp = lambda c: F.col(c).cast("timestamp")
    return spark.createDataFrame(rows, PRICE).select(
        "node_id", "fuel_type_id", "price", stamp("u").alias("price_last_updated"),
        stamp("e").alias("price_change_effective_timestamp"),
    )


def station_df(spark, *ids):
    return spark.createDataFrame([(i, f"Garage {i}", f"AB{i}") for i in ids], "node_id string, trading_name string, postcode string")


@pytest.fixture(scope="module")
def types(spark):
    return schemas.fuel_types(spark)


# -- joins and checks ----------------------------------------------------------------


def test_semi_and_anti_split_the_input_and_keep_duplicates(spark):
    page = spark.createDataFrame([("a", 1), ("a", 1), ("x", 2), ("x", 2), (None, 3)], "node_id string, v int")
    known = station_df(spark, "a", "b")
    assert sorted(map(tuple, joins.present_rows(page, known).collect())) == [("a", 1), ("a", 1)]
    assert joins.absent_rows(page, known).count() == 3


def test_semi_join_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    page = spark.range(1000).select(F.when(F.col("id") < 400, "a").otherwise(F.col("id").cast("string")).alias("node_id"))
    known = station_df(spark, "a", "500", "501")
    small = joins.present_rows(page, known).count()
    monkeypatch.setattr(joins, "small_enough", lambda *a: False)
    assert joins.present_rows(page, known).count() == small == 402
    assert joins.restrict_to(page, known, "node_id") is page


def test_broadcast_bound_is_in_bytes(spark):
    side = spark.createDataFrame([("a" * 64, 1), ("b" * 64, 2), (None, 3)], "node_id string, v int").select("node_id")
    width = 2 * (64 + joins.ROW_BYTES) + joins.ROW_BYTES
    assert joins.small_enough(side, width) and not joins.small_enough(side, width - 1)
    assert joins.small_enough(side.limit(0), 0)


def test_left_dimension_keeps_strangers_and_strict_one_fails(spark, types):
    facts = spark.createDataFrame([("E10", 5), ("?", 99)], "fuel_type string, t int")
    rows = {r["t"]: r["display_text"] for r in joins.with_dimension(facts, types, "t").collect()}
    assert rows == {5: "Petrol E10", 99: None}
    ok = joins.resolve_dimension(facts.where("t = 5"), types, "fuel_type")
    assert ok.collect()[0].asDict() == {"t": 5, "fuel_type_id": 5}
    with pytest.raises(PySparkException, match="unknown name: \\?"):
        joins.resolve_dimension(facts, types, "fuel_type").collect()


def test_id_status(spark):
    good, lower, short = "A" * 64, "a" * 64, "A" * 63
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([good, lower, short, "B" * 64, "G" * 64, None])], "i int, node_id string")
    got = filters.id_status(asked, spark.createDataFrame([(good,)], "node_id string")).orderBy("i").collect()
    assert [r["status"] for r in got] == ["valid", "valid", "malformed", "absent", "malformed", "malformed"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    assert [tuple(r) for r in checks.repeated_keys(df, ["k"]).collect()] == [(1, 2)]
    assert checks.require_not_null(df.where("k = 2"), ["v"]).count() == 1
    with pytest.raises(PySparkException, match="NULL in required column v"):
        checks.require_not_null(df, ["v"]).collect()
    assert checks.at_most_one(df.where("k = 2")).count() == 1 and checks.at_most_one(df.where("k = 3")).count() == 0
    with pytest.raises(PySparkException, match="more than one row"):
        checks.at_most_one(df).collect()


def test_changed_since_reaches_the_scan(spark, tmp_path):
    spark.range(5).select((F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins="id")).alias("ts")).write.parquet(str(tmp_path / "t"))
    df = filters.changed_since(spark.read.parquet(str(tmp_path / "t")), T0 + timedelta(minutes=3), "ts")
    assert df.count() == 3
    assert "GreaterThanOrEqual(ts" in df._jdf.queryExecution().executedPlan().toString()


# -- groups --------------------------------------------------------------------------


def test_latest_per_type_matches_brute_force_with_a_hot_station(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(3000):
        node = "hot" if rnd.random() < 0.4 else f"n{rnd.randrange(40)}"
        rows.append((node, rnd.randint(1, 6), float(rnd.randint(100, 200)),
                     f"2026-03-{rnd.randint(1, 9):02d} 10:00:00", f"2026-03-{rnd.randint(1, 9):02d} 09:00:00"))
    best = {}
    for n, t, p, u, e in rows:
        best[n, t] = max(best.get((n, t), ("", "", 0.0)), (u, e, p))
    got = groups.latest_per_type(price_df(spark, rows)).select(
        "node_id", "fuel_type_id", F.date_format("price_last_updated", "yyyy-MM-dd HH:mm:ss"),
        F.date_format("price_change_effective_timestamp", "yyyy-MM-dd HH:mm:ss"), "price",
    ).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == best and len(got) == len(best)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bounded_arrays_hold_the_whole_group_in_order(uncoalesced):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice([None, *"abcdefg"]), rnd.randrange(10_000)) for _ in range(5000)]
    rows += [("hot", 1234)] * 333 + [("one", 7)] * 120
    df = uncoalesced.createDataFrame(rows, "k string, x int")
    arrays = groups.bounded_arrays(df, ["k"], F.floor(F.col("x") / 1000), F.struct("x"), "xs", size=50)
    got = {(r["k"], r["bucket"], r["part"]): [p["x"] for p in r["xs"]] for r in arrays.collect()}
    held = defaultdict(list)
    for k, x in rows:
        held[k, x // 1000].append(x)
    want = {(*g, i // 50): sorted(xs)[i:i + 50] for g, xs in held.items() for i in range(0, len(xs), 50)}
    assert got == want


def test_bounded_arrays_split_one_instant(uncoalesced):
    df = uncoalesced.range(4000).selectExpr("'k' k", "5 x", "id y")
    sliced = df.repartitionByRange("k", F.struct("x", "y")).groupBy(F.spark_partition_id()).count().collect()
    assert len(sliced) > 2 and max(r["count"] for r in sliced) < 2000
    arrays = groups.bounded_arrays(df, ["k"], F.lit(0), F.struct("x", "y"), "xs", size=300)
    got = sorted((r["part"], [p["y"] for p in r["xs"]]) for r in arrays.collect())
    assert got == [(n, list(range(n * 300, min(4000, n * 300 + 300)))) for n in range(14)]
    assert groups.bounded_arrays(df.limit(0), ["k"], F.lit(0), F.struct("x"), "xs").count() == 0


def test_bounded_arrays_of_long_and_short_groups(uncoalesced, monkeypatch):
    monkeypatch.setattr(groups, "POINTS_PER_CHUNK", 200)
    rnd = random.Random(5)
    rows = [(k, rnd.choice([None, float("nan"), 0.0, -0.0, *range(30)]), rnd.randrange(3)) for k, n in (("long", 700), (None, 500), ("short", 200), ("one", 1)) for _ in range(n)]
    rows += [("long", 4.0, 1)] * 150
    df = uncoalesced.createDataFrame([(k, None if y is None else float(y), x) for k, y, x in rows], "k string, y double, x int")
    arrays = groups.bounded_arrays(df, ["k"], F.lit(0), F.struct("y", "x"), "ys", size=40)
    got = {(r["k"], r["part"]): [(str(p["y"]), p["x"]) for p in r["ys"]] for r in arrays.collect()}
    held = defaultdict(list)
    for k, y, x in rows:
        held[k].append(((y is not None, y != y, 0.0 if y is None or y != y else y, x), (str(None if y is None else float(y) + 0.0), x)))
    want = {(k, i // 40): [p for _, p in sorted(ps, key=lambda p: p[0])[i:i + 40]] for k, ps in held.items() for i in range(0, len(ps), 40)}
    assert got == want


def test_short_groups_are_shuffled_once(uncoalesced):
    df = uncoalesced.range(1000).selectExpr("id % 50 k", "id x")
    arrays = groups.bounded_arrays(df, ["k"], F.floor(F.col("x") / 500), F.struct("x"), "xs", size=8)
    plan = arrays._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert sorted(len(r["xs"]) for r in arrays.collect()) == [2] * 100 + [8] * 100


def test_last_writer_is_sequential_application(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(50), b, i, rnd.random()) for b in range(5) for i in range(100)]
    table = {}
    for k, b, i, v in rows:
        table[k] = v
    df = spark.createDataFrame(rows, "k int, b int, i int, v double").repartition(7)
    assert {r["k"]: r["v"] for r in groups.last_writer(df, ["k"], ["b", "i"]).collect()} == table


# -- report and history --------------------------------------------------------------


def test_report_orders_missing_first_then_cheapest_and_labels_first_rows(spark, types):
    at = "2026-03-01 10:00:00"
    prices = price_df(spark, [
        ("1", 5, 150.0, at, at), ("1", 6, 160.0, at, at),
        ("2", 5, 140.0, "2026-03-02 10:00:00", "2026-06-30 23:30:00"), ("2", 5, 99.0, at, at),
        ("3", 6, 155.0, at, at),
        ("9", 5, 1.0, at, at),
    ])
    rows = report.latest_price_report(station_df(spark, "1", "2", "3", "4"), prices, types).collect()
    assert [tuple(r)[:5] for r in rows] == [
        ("3", "Garage 3", "Petrol E5", 155.0, "1 March 2026"),
        ("2", "Garage 2", "Petrol E10", 140.0, "1 July 2026"),
        ("1", "Garage 1", "Petrol E10", 150.0, "1 March 2026"),
        ("1", "", "Petrol E5", 160.0, "1 March 2026"),
    ]
    order = report.stations_by_price(station_df(spark, "1", "2", "3", "4"), prices, types).collect()
    assert [r["node_id"] for r in order] == ["3", "4", "2", "1"]
    only = report.latest_price_report(station_df(spark, "1", "2", "3", "4"), prices, types, prefix="ab1").collect()
    assert {r["node_id"] for r in only} == {"1"}


def test_nested_prices_keep_stations_without_any(spark, types):
    at = "2026-03-01 10:00:00"
    prices = price_df(spark, [("1", 5, 150.0, at, at), ("1", 6, 160.0, at, at), ("2", 5, 140.0, at, at)])
    rows = report.stations_with_prices(station_df(spark, "1", "2", "3"), prices, types).collect()
    assert {r["node_id"]: [p["price"] for p in r["fuel_prices"]] for r in rows} == {"1": [150.0, 160.0], "2": [140.0], "3": []}
    assert all(r["public_phone_number"] is None for r in rows) and len(rows) == 3


def test_history_series_json(spark, types, tmp_path):
    prices = price_df(spark, [
        ("1", 5, 150.0, "2026-03-01 10:00:00", "2026-03-01 10:00:00"), ("1", 5, 149.5, "2026-03-01 10:00:00", "2026-03-01 09:00:00"),
        ("1", 6, 160.0, "2026-03-01 10:00:00", "2026-03-01 10:00:00"), ("2", 6, 1.0, "2026-03-01 10:00:00", "2026-03-01 10:00:00"),
    ])
    series = history.history_series(prices, types, node_id="1")
    texts = {r["series"] for r in history.series_json(series).collect()}
    assert texts == {
        '{"name":"Petrol E10","data":[{"x":1772355600000,"y":149.5},{"x":1772359200000,"y":150.0}]}',
        '{"name":"Petrol E5","data":[{"x":1772359200000,"y":160.0}]}',
    }
    history.write_series(series, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    report.write_report(report.latest_price_report(station_df(spark, "1"), prices, types), str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2


# -- upsert and retention ------------------------------------------------------------


def merge(spark, target, source, **kw):
    t = spark.createDataFrame(target, "k int, v string, w string, at string").withColumn("last_updated", F.col("at").cast("timestamp")).drop("at")
    s = spark.createDataFrame(source, "k int, v string, w string")
    rows = upsert_rows(t, s, ["k"], T0, **kw).collect()
    return {r["k"]: (r["v"], r["w"], r[ACTION], r["last_updated"].hour) for r in rows}


def test_upsert_all_and_one_column(spark):
    old = [(1, "a", "x", "2026-01-01 01:00:00"), (2, "b", None, "2026-01-01 02:00:00"), (3, "c", "z", "2026-01-01 03:00:00")]
    new = [(2, "b", None), (3, "C", None), (4, None, "n")]
    assert merge(spark, old, new) == {
        1: ("a", "x", "kept", 1), 2: ("b", None, "unchanged", 2), 3: ("C", None, "updated", 12), 4: (None, "n", "inserted", 12),
    }
    assert merge(spark, old, new, update=["v"])[3] == ("C", "z", "updated", 12)
    assert merge(spark, old, [(3, "c", "other")], update=["v"])[3] == ("c", "z", "unchanged", 3)
    assert merge(spark, old, new, touch_unchanged=True)[2] == ("b", None, "unchanged", 12)


def test_prunes(spark):
    ages = spark.createDataFrame([("1", "2026-01-01"), ("2", "2026-02-01"), ("3", "2026-03-01")], "node_id string, d string").select(
        "node_id", F.col("d").cast("timestamp").alias("last_updated"))
    prices = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3), ("x", 4)], "node_id string, p int")
    since = datetime(2026, 2, 1)
    assert retention.prune_rows(ages, since).count() == 2 and retention.expired_rows(ages, since).count() == 1
    kept, rows = retention.prune_stations(ages, prices, since)
    assert {r[0] for r in kept.collect()} == {"2", "3"} and {r["p"] for r in rows.collect()} == {2, 3, 4}


# -- activity ------------------------------------------------------------------------


def brute_sessions(touches, gap):
    out, by_user = set(), defaultdict(list)
    for u, t in touches:
        by_user[u].append(t)
    for u, ts in by_user.items():
        ts.sort()
        cur = [ts[0]]
        for t in ts[1:]:
            if t - cur[-1] >= gap:
                out.add((u, cur[0], cur[-1], len(cur)))
                cur = []
            cur.append(t)
        out.add((u, cur[0], cur[-1], len(cur)))
    return out


def as_set(df):
    rows = df.select("user_id", F.unix_micros("session_start"), F.unix_micros("session_end"), "n_touches").collect()
    return {tuple(r) for r in rows}


def touch_df(spark, touches):
    return spark.createDataFrame(touches, "user_id int, us bigint").select(
        "user_id", F.timestamp_micros("us").alias("ts"), F.monotonically_increasing_id().alias("event_id"),
        F.col("us").cast("string").alias("props"))


def test_sessions_match_brute_force_with_exact_gaps_and_a_hot_user(spark):
    rnd = random.Random(4)
    gap = 15 * 60 * 1_000_000
    touches, t = [], defaultdict(lambda: 1_700_000_000_000_000)
    for _ in range(4000):
        u = 0 if rnd.random() < 0.4 else rnd.randrange(1, 30)
        t[u] += rnd.choice([0, 1, gap // 3, gap - 1, gap, gap + 1, 5 * gap])
        touches.append((u, t[u]))
    rnd.shuffle(touches)
    assert as_set(activity.activity_sessions(touch_df(spark, touches))) == brute_sessions(touches, gap)


def test_stream_sessions_equal_closed_batch_sessions(spark, tmp_path):
    minute = 60 * 1_000_000
    base = 1_700_000_000_000_000
    touches = [(1, base), (1, base + 15 * minute), (1, base + 29 * minute), (2, base + minute), (3, base + 600 * minute)]
    touch_df(spark, touches).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = session_stream(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {s for s in brute_sessions(touches, 15 * minute) if s[0] != 3}
    assert as_set(spark.table("sessions_out")) == closed and len(closed) == 3
    q = state_stream(stream).writeStream.format("memory").queryName("state_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["user_id"] for r in spark.table("state_out").collect()} == {1, 2}
    assert rows_too_late(q) == 0


def test_state_expires_an_hour_after_the_last_touch(spark, tmp_path):
    minute, base = 60 * 1_000_000, 1_700_000_000_000_000
    for n, touches in enumerate([[(1, base), (1, base + 61 * minute), (2, base)], [(2, base + 60 * minute), (3, base + 900 * minute)]]):
        touch_df(spark, touches).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    schema = spark.read.parquet(str(tmp_path / "in")).drop("n").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = state_stream(stream).writeStream.format("memory").queryName("expired").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    ends = sorted((r["user_id"], r["us"] - base) for r in spark.table("expired").select("user_id", F.unix_micros("last_touch").alias("us")).collect())
    assert ends == [(1, 0), (1, 61 * minute), (2, 60 * minute)]


def test_liveness_and_expiry_edges(spark):
    us = lambda m: int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) - m
    minute = 60 * 1_000_000
    df = touch_df(spark, [(1, us(15 * minute)), (2, us(15 * minute - 1)), (3, us(60 * minute)), (4, us(60 * minute + 1)), (2, us(99 * minute))])
    assert {r["user_id"] for r in activity.active_users(df, T0).collect()} == {2}
    assert {r["user_id"] for r in activity.unexpired_state(activity.latest_state(df), T0).collect()} == {1, 2, 3}
