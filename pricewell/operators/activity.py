"""Activity per user: sessions, liveness, expiry and last state.

A session is live for a quarter of an hour after its last touch, strictly: a touch
exactly that much later starts a new one.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.times import utc_literal
from pricewell.operators.groups import top_row

LIVE_FOR = timedelta(minutes=15)
KEEP_FOR = timedelta(hours=1)


def activity_sessions(
    touches: DataFrame, user: str = "user_id", ts: str = "ts", gap: timedelta = LIVE_FOR
) -> DataFrame:
    """One row per session: user, `session_start`, `session_end` (last touch), `n_touches`.

    Two touches in one gap-wide slot are less than a gap apart, so they share a session
    and the slot can be summed up first, before the shuffle. The window then sees at most
    one row per user and slot: its size is bounded by elapsed time, not by traffic.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = int(gap.total_seconds() * 1_000_000)
    slots = (
        touches.select(F.col(user), micros.alias("_us"))
        .groupBy(user, (F.col("_us") - F.pmod("_us", F.lit(width))).alias("_slot"))
        .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count("*").alias("_n"))
    )
    by_time = Window.partitionBy(user).orderBy("_lo")
    starts = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_time) >= width, F.lit(True))
    numbered = slots.withColumn("_starts", starts).withColumn(
        "_session", F.sum(F.col("_starts").cast("bigint")).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(user, "_session")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("n_touches"))
        .select(
            user,
            F.timestamp_micros("_lo").alias("session_start"),
            F.timestamp_micros("_hi").alias("session_end"),
            "n_touches",
        )
    )


def last_touch(touches: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    return touches.groupBy(user).agg(F.max(ts).alias("last_touch"))


def active_users(
    touches: DataFrame, as_of: datetime, user: str = "user_id", ts: str = "ts", live_for: timedelta = LIVE_FOR
) -> DataFrame:
    """Users whose last touch is strictly younger than `live_for` at `as_of`."""
    return last_touch(touches, user, ts).where(F.col("last_touch") > utc_literal(as_of - live_for))


def unexpired_state(
    state: DataFrame, as_of: datetime, column: str = "last_touch", keep_for: timedelta = KEEP_FOR
) -> DataFrame:
    """State the purge leaves: everything not strictly older than `keep_for`."""
    return state.where(F.col(column) >= utc_literal(as_of - keep_for))


def latest_state(
    touches: DataFrame, user: str = "user_id", ts: str = "ts", order: str = "event_id", payload: str = "props"
) -> DataFrame:
    """Last payload and last touch of each user."""
    rows = touches.select(user, F.col(ts).alias("last_touch"), order, payload)
    return top_row(rows, [user], ["last_touch", order])
