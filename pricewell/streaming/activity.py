"""Activity sessions over an unbounded touch stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from pricewell.operators.activity import KEEP_FOR, LIVE_FOR
from pricewell.session import importable

# Rows that a task combines at once before the shuffle, and rows of a batch it hands on.
COMBINED_ROWS = 1_000_000
COMBINED_OUT = 10_000
# Users are kept in so many groups, as a call per user costs more than its touches do. Fixed, as the state is laid out by it.
LIVENESS_GROUPS = 2048


def session_stream(
    touches: DataFrame, user: str = "user_id", ts: str = "ts", gap: timedelta = LIVE_FOR,
    late_by: timedelta = KEEP_FOR,
) -> DataFrame:
    """Same rows as `operators.activity.activity_sessions`, emitted as sessions close.

    `session_window` joins touches exactly a gap apart, which must stay apart here, so it
    gets a gap one microsecond short. The watermark bounds the state: a touch later than
    `late_by` is dropped and a session is final once the watermark has passed its end.
    """
    micros = int(gap.total_seconds() * 1_000_000) - 1
    timed = touches.select(user, F.col(ts).cast("timestamp").alias("_ts"))
    return (
        timed.withWatermark("_ts", f"{int(late_by.total_seconds())} seconds")
        .groupBy(user, F.session_window("_ts", f"{micros} microseconds"))
        .agg(F.min("_ts").alias("session_start"), F.max("_ts").alias("session_end"), F.count("*").alias("n_touches"))
        .select(user, "session_start", "session_end", "n_touches")
    )


def state_stream(
    touches: DataFrame, user: str = "user_id", ts: str = "ts", order: str = "event_id", payload: str = "props",
    keep_for: timedelta = KEEP_FOR, late_by: timedelta = KEEP_FOR,
) -> DataFrame:
    """Last payload and touch of each user's state, emitted when it expires `keep_for` after that touch.

    A touch exactly `keep_for` later still finds the state. What has expired is dropped once the
    watermark has passed, so the state held is that of users seen in the last while, not of all users.
    """
    timed = touches.select(user, F.col(ts).cast("timestamp").alias("_ts"), order, payload)
    latest = F.max(F.struct(F.col("_ts").alias("last_touch"), order, payload)).alias("_last")
    return (
        timed.withWatermark("_ts", f"{int(late_by.total_seconds())} seconds")
        .groupBy(user, F.session_window("_ts", f"{int(keep_for.total_seconds())} seconds"))
        .agg(latest).select(user, "_last.*")
    )


def liveness_stream(
    touches: DataFrame, user: str = "user_id", ts: str = "ts", live_for: timedelta = LIVE_FOR, every: timedelta = timedelta(minutes=1),
    late_by: timedelta = KEEP_FOR,
) -> DataFrame:
    """`as_of`, user and `last_touch`: who is active at each full `every`, emitted once the watermark has passed it.

    Same rule as `operators.activity.active_users`: a touch counts for less than `live_for`, its own instant included.
    What is kept of a user is the last touch before each full `every` that the watermark has not left behind, and not a row for every
    `as_of` that a touch counts for: those are made as they are emitted, from the span in which a touch is the last. A touch counts only for
    the `as_of` ahead of the watermark of the batch it comes in. Touches of a user before one `as_of` are combined before the shuffle.
    """
    importable(touches.sparkSession)
    live, step = (int(d.total_seconds() * 1_000_000) for d in (live_for, every))
    offset, kind = live % step, touches.schema[user].dataType
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # the first `as_of` of a touch; text tells users apart whatever their type, and null from the rest
    first = at + F.pmod(F.lit(offset) - at, F.lit(step))
    rows = touches.select(F.col(user).cast("string").alias("who"), first.alias("first"), at.alias("at")).where("at is not null")
    combined = rows.mapInArrow(_last_before_each, rows.schema)
    # the watermark passes this when it has passed all that the touch counts for; a microsecond less, as that ends before `live_for`
    until = F.timestamp_micros(F.col("at") + F.lit(live - 1)).alias("until")
    spans = (
        combined.select(F.pmod(F.xxhash64("who"), F.lit(LIVENESS_GROUPS)).alias("_group"), "who", "at", until)
        .withWatermark("until", f"{int((late_by + live_for).total_seconds())} seconds")
        .groupBy("_group").applyInPandasWithState(
            partial(_settled_spans, live=live, step=step, offset=offset), "who string, low long, high long, at long",
            "settled long, users array<string>, codes binary, kept binary", "append", "EventTimeTimeout",
        )
    )
    as_of = F.explode(F.sequence("low", "high", F.lit(step).cast("bigint"))).alias("as_of")
    return spans.select("who", "at", as_of).select(
        F.timestamp_micros("as_of").alias("as_of"), F.col("who").cast(kind).alias(user), F.timestamp_micros("at").alias("last_touch")
    )


def _last_before_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last touch of each user and first `as_of` in a stretch of rows."""

    def last(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = pa.Table.from_batches(held).group_by(["who", "first"]).aggregate([("at", "max")])
        yield from best.select(["who", "first", "at_max"]).rename_columns(["who", "first", "at"]).to_batches(max_chunksize=COMBINED_OUT)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= COMBINED_ROWS:
            yield from last(held)
            held, n = [], 0
    if held:
        yield from last(held)


def _last_of_each(who: np.ndarray, at: np.ndarray, step: int, offset: int) -> tuple[np.ndarray, ...]:
    """The last touch for each user and first `as_of`, in order: users, then by touch the place of its user, its first `as_of` and itself."""
    codes, users = pd.factorize(who, use_na_sentinel=False)
    first = at + (offset - at) % step
    order = np.lexsort((at, first, codes))
    codes, first, at = codes[order], first[order], at[order]
    last = np.append((codes[1:] != codes[:-1]) | (first[1:] != first[:-1]), True)[: len(at)]
    return np.where(pd.isna(users), None, users), codes[last], first[last], at[last]


def _settled_spans(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState, live: int, step: int, offset: int) -> Iterator[pd.DataFrame]:
    """From `low` to `high`, one `step` apart, `at` is the last touch of a user: what the watermark has passed since the last call.

    The touches kept of a user are bounded by the time between two calls and `live`, whatever the traffic.
    """
    passed = state.getCurrentWatermarkMs() * 1000
    # the first `as_of` ahead of a moment
    ahead = lambda moment: moment + 1 + (offset - moment - 1) % step
    who, at = np.empty(0, object), np.empty(0, np.int64)
    if state.exists:
        settled, users, codes, kept = state.get
        users, codes, first, at = _last_of_each(np.array(users, object)[np.frombuffer(bytes(codes), np.int64)], np.frombuffer(bytes(kept), np.int64), step, offset)
        who, followed = users[codes], np.append(codes[1:] == codes[:-1], False)
        high = np.minimum((at - 1 + live - offset) // step * step + offset, ahead(passed) - step)
        high = np.where(followed, np.minimum(high, np.append(first[1:], 0) - step), high)
        low = np.maximum(first, ahead(settled))
        out = low <= high
        if out.any():
            yield pd.DataFrame({"who": who[out], "low": low[out], "high": high[out], "at": at[out]})
    if not state.hasTimedOut:
        new = list(chunks)
        who, at = np.concatenate([who, *(c["who"] for c in new)]), np.concatenate([at, *(c["at"].to_numpy(np.int64) for c in new)])
    waits = at - 1 + live >= ahead(passed)
    if not waits.any():
        if state.exists:
            state.remove()
        return
    users, codes, first, at = _last_of_each(who[waits], at[waits], step, offset)
    state.update((passed, users.tolist(), codes.astype(np.int64).tobytes(), at.tobytes()))
    # fires once the watermark is greater, and may not be set to where the watermark is
    due = max(int(first.min()), ahead(passed))
    state.setTimeoutTimestamp(max(-(-due // 1000) - 1, passed // 1000 + 1))


def rows_too_late(query: StreamingQuery) -> int:
    """Rows that the recent micro-batches dropped because they came behind the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
