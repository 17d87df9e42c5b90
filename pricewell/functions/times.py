"""Instants, labels and cursors. Sessions run in UTC (see ``session.RUNTIME_CONF``)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_ZONE = "Europe/London"
OVERLAP_SECONDS = 60

# Date and time joined by T; seconds, fraction and offset may be absent.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?$"


def utc_literal(moment: datetime, kind: str = "timestamp") -> Column:
    """`moment` as a literal of a Spark timestamp type; a naive one is read as UTC.

    Passing the datetime itself would go through the time zone of the driver machine.
    """
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)


def date_label(c: Column) -> Column:
    """Like ``1 July 2026``, on the wall clock of the label zone."""
    return F.date_format(F.from_utc_timestamp(c, LABEL_ZONE), "d MMMM yyyy")


def epoch_millis(c: Column) -> Column:
    return F.unix_millis(c)


def feed_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def minus_seconds(c: Column, seconds: int) -> Column:
    return c - F.make_dt_interval(secs=F.lit(seconds))


def to_second(c: Column) -> Column:
    """Stored times carry whole seconds only."""
    return F.date_trunc("SECOND", c)


def parse_instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL if the shape or the date is wrong."""
    return F.when(text.rlike(ISO_INSTANT), F.try_to_timestamp(text))


def read_from(cursor: datetime) -> datetime:
    """Where an incremental read starts for a stored cursor."""
    return cursor - timedelta(seconds=OVERLAP_SECONDS)


def next_cursor(run_start: datetime) -> datetime:
    """What a finished run stores, so the next one reads the overlap again."""
    return run_start - timedelta(seconds=OVERLAP_SECONDS)
