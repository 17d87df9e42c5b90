"""Keyed upsert as one full outer join, for tables whose format has no MERGE."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.times import utc_literal

ACTION = "_action"
STAMP = "last_updated"


def upsert_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], batch_ts: datetime | Column,
    update: Sequence[str] | None = None, touch_unchanged: bool = False, order: str | None = None, advance: bool = False,
) -> DataFrame:
    """Merge `source` into `target`; both hold at most one row per key.

    On a conflict the `update` columns (all non-key columns by default) take the source
    value. The change stamp moves to `batch_ts` on an insert or a real change only; an
    identical rewrite leaves it, unless `touch_unchanged`. `_action` says what happened:
    `inserted`, `updated`, `unchanged` (in both) or `kept` (target only).

    `order` names a column that tells writers apart: a source row below the stored one comes too late and changes
    nothing; without a value on either side it is the newer. What is stored is the writer of the last change or, with `advance`, the
    last writer even if its values were the same (`advanced`), which is what later pages of an unfinished load must be compared with.

    The join is on the full key, which is unique on either side, so the shuffle is even
    no matter how many rows one station has.
    """
    values = [c for c in target.columns if c not in keys and c not in (STAMP, order)]
    kept = [order] if order else []
    update = list(values if update is None else update)
    stamp = batch_ts if isinstance(batch_ts, Column) else utc_literal(batch_ts)

    t = target.select(*keys, F.struct(*values, *kept, STAMP).alias("_old"))
    s = source.select(*keys, F.struct(*values, *kept).alias("_new"))
    both = t.join(s, list(keys), "full_outer")

    old, new = F.col("_old"), F.col("_new")
    differs = F.lit(False)
    for c in update:
        differs = differs | ~old[c].eqNullSafe(new[c])
    late = F.coalesce(new[order] < old[order], F.lit(False)) if order else F.lit(False)
    later = F.coalesce(new[order] > old[order], F.lit(False)) if order and advance else F.lit(False)
    action = (
        F.when(old.isNull(), "inserted")
        .when(new.isNull(), "kept")
        .when(late, "unchanged")
        .when(differs, "updated")
        .when(later, "advanced")
        .otherwise("unchanged")
    )
    moved = F.col(ACTION).isin("inserted", "updated", *(["unchanged"] if touch_unchanged else []))

    def value(c: str) -> Column:
        if c in update:
            return F.when(new.isNull() | late, old[c]).otherwise(new[c]).alias(c)
        return F.when(old.isNull(), new[c]).otherwise(old[c]).alias(c)

    merged = both.withColumn(ACTION, action).select(
        *keys, *[value(c) for c in values],
        *[F.when(F.col(ACTION).isin("inserted", "updated", "advanced"), new[c]).otherwise(old[c]).alias(c) for c in kept],
        F.when(moved, stamp).otherwise(old[STAMP]).alias(STAMP), ACTION,
    )
    return merged.select(*target.columns, ACTION)


def action_counts() -> list[Column]:
    """Aggregates for `DataFrame.observe` over the output of :func:`upsert_rows`."""
    named = {"inserted": ["inserted"], "updated": ["updated"], "unchanged": ["unchanged", "advanced"]}
    return [F.count(F.when(F.col(ACTION).isin(actions), True)).alias(name) for name, actions in named.items()]
