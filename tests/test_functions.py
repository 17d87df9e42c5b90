from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricewell.functions import text as tx
from pricewell.functions import times as tm
from pricewell.functions.prices import repair_unit
from pricewell.operators import filters


def column(spark, kind, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c"))).collect()]


def test_unit_repair_boundaries(spark):
    got = column(spark, "double", [150.0, 1.5, 1500.0, 10.0, 10.01, 999.99, 1000.0, 0.0, -1.0, None], repair_unit)
    assert got == [150.0, 150.0, 150.0, 1000.0, 10.01, 999.99, 100.0, 0.0, -100.0, None]


def test_date_label_follows_the_zone(spark):
    texts = ["2026-06-30 23:30:00", "2026-01-31 23:30:00", "2026-03-29 00:59:59", "2026-10-25 00:30:00", "2026-12-05 12:00:00"]
    got = column(spark, "string", texts, lambda c: tm.date_label(c.cast("timestamp")))
    assert got == ["1 July 2026", "31 January 2026", "29 March 2026", "25 October 2026", "5 December 2026"]


def test_epoch_millis_and_second(spark):
    texts = ["2026-03-01 10:00:00.123999", "1969-12-31 23:59:59.9995"]
    assert column(spark, "string", texts, lambda c: tm.epoch_millis(c.cast("timestamp"))) == [1772359200123, -1]
    assert column(spark, "string", texts[:1], lambda c: tm.feed_timestamp(tm.to_second(c.cast("timestamp")))) == [
        "2026-03-01 10:00:00"
    ]


def test_address_skips_null_and_keeps_empty(spark):
    df = spark.createDataFrame([(None, "", "T", "P"), ("1 Rd", None, "T", "P")], "a string, b string, c string, d string")
    rows = df.select(tx.full_address(*[F.col(x) for x in "abcd"])).collect()
    assert [r[0] for r in rows] == [", T, P", "1 Rd, T, P"]


def test_lists(spark):
    assert column(spark, "string", ["a,b", "", ",a,,b,"], tx.csv_to_list) == [["a", "b"], [], ["a", "b"]]
    assert column(spark, "array<string>", [["a", "b"], []], tx.list_to_csv) == ["a,b", ""]


def test_hex(spark):
    assert column(spark, "string", ["ab01", "zz"], lambda c: tx.bytes_to_hex(tx.hex_to_bytes(c))) == ["AB01", None]


@pytest.mark.parametrize(
    "prefix, found",
    [
        ("ab1", {"AB1 2CD", "ab10 3EF"}),
        ("AB_ ", {"AB1 2CD"}),
        ("%2c", {"AB1 2CD"}),
        ("é", {"Ée1"}),
        ("e", {"Ée1"}),
        ("\\%", {"%odd"}),
        ("A\\B1", {"AB1 2CD", "ab10 3EF"}),
        ("zz", set()),
        ("", {"AB1 2CD", "ab10 3EF", "Ée1", "%odd"}),
    ],
)
def test_prefix(spark, prefix, found):
    df = spark.createDataFrame([(c,) for c in ("AB1 2CD", "ab10 3EF", "Ée1", "%odd", None)], "postcode string")
    assert {r[0] for r in filters.stations_by_prefix(df, prefix).collect()} == found


def test_trailing_backslash_escapes_the_wildcard():
    assert tx.like_pattern("ab\\") == "ab\\%"
    assert tx.like_pattern("a\\b") == "ab%"
    assert tx.like_pattern("a\\\\") == "a\\\\%"


def test_cursor_arithmetic():
    at = datetime(2026, 3, 1, 12)
    assert tm.read_from(at) == tm.next_cursor(at) == datetime(2026, 3, 1, 11, 59)
