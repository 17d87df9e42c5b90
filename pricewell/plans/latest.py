"""The newest price of every station and product, kept up to date instead of worked out from all prices.

The table follows the commits of the price table: what was written since the last visit is reduced to its newest rows and merged, the
newer moment winning. A removal can take a newest price away; only then are the groups it hits read again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell import schemas
from pricewell.operators import groups
from pricewell.operators.upsert import STAMP
from pricewell.plans import report
from pricewell.plans.load import Store
from pricewell.sources import keyed_table
from pricewell.sources.keyed_table import Change

MOMENT = ("price_last_updated", "price_change_effective_timestamp")
FOLLOWED = "prices"


def _newest(prices: DataFrame) -> DataFrame:
    """The newest row of each group, under its moment; a stored key has one price, so there are no ties."""
    rows = prices.select(*schemas.LATEST_KEY, F.struct(*MOMENT).alias("moment"), "price", F.col(STAMP).alias("stamp"))
    return groups.top_row(rows, list(schemas.LATEST_KEY), ["moment"])


def refresh(store: Store, now: datetime) -> Change:
    """Take over what the price table wrote since the last refresh.

    Reads the partitions written since, whose other rows do no harm. The commit seen is the replay mark, so a
    refresh that died is simply done again, and one without news writes nothing.
    """
    seen = store.latest.last_batch(FOLLOWED)
    commit, written = store.prices.read_after(-1 if seen is None else seen)
    if commit == seen:
        return Change(skipped=True)
    return store.latest.upsert(_newest(written), now, batch_id=commit, stream=FOLLOWED)


def prune_prices(store: Store, since: datetime, now: datetime) -> Change:
    """Delete prices changed before `since`, and find the newest of the groups that lose theirs.

    A run that dies in between is put right by running it again: the groups to mend are told by the stamps they still hold.
    """
    refresh(store, now)
    gone = store.prices.prune(since)
    _mend(store, since, now)
    return gone


def _mend(store: Store, since: datetime, now: datetime) -> None:
    hit = store.latest.read().where(~keyed_table.kept_since("stamp", since)).select(*schemas.LATEST_KEY)
    left = store.prices.read().join(hit, list(schemas.LATEST_KEY), "left_semi")
    # an older price takes the place of the one removed, so the order of moments does not count here
    store.latest.upsert(_newest(left), now, ordered=False)
    store.latest.prune(since, "stamp")


def prune_stations(store: Store, since: datetime) -> tuple[Change, Change]:
    """Delete old stations with their prices and newest prices."""
    gone = store.stations.read().where(~keyed_table.kept_since(STAMP, since))
    store.latest.delete_matching(gone, "node_id")
    return keyed_table.prune_stations(store.stations, store.prices, since)


def read(store: Store) -> DataFrame:
    """Newest prices in the columns of the price table."""
    return store.latest.read().select(*schemas.LATEST_KEY, "moment.*", "price")


def maintained_report(store: Store, prefix: str = "", ranking: str = schemas.RANKING_FUEL) -> DataFrame:
    """The latest-price report from the kept rows: one row of each station and product is read, whatever the age of the table."""
    return report.latest_price_report(store.stations.read(), read(store), store.fuel_types, prefix, ranking)
