"""A keyed Parquet table that takes upserts and prunes, one writer at a time.

Each change writes only the partitions it touches, under a new version folder, and then
one small manifest file that maps every partition to the folder holding it. Readers
follow the newest manifest, so they never see half a change; a change that died half way
is invisible, and repeating it under the same batch id after it succeeded does nothing.

    <path>/data/c=<commit>/part=<value>/*.parquet
    <path>/commits/commit=<commit>/part-*          lines (part, c), (stream, batch_id, began), (buckets)

Files are ordered by the `cluster` columns, in small row groups with bloom filters on the first key, so reads for
one key or a range of the cluster skip most of what they open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell import schemas
from pricewell.functions import text
from pricewell.functions.times import utc_literal
from pricewell.operators.filters import kept_since
from pricewell.operators.joins import absent_rows, present_rows, station_side
from pricewell.operators.upsert import ACTION, STAMP, action_counts, upsert_rows
from pricewell.session import drop_dir, names_in, read_lines, work_dir, write_lines

MANIFEST = schemas.struct(
    part=T.StringType(), c=T.LongType(), batch_id=T.LongType(), began=T.LongType(), stream=T.StringType(), buckets=T.IntegerType()
)
ORDER = "written"
STATION_BUCKETS = 32
ROW_GROUP_BYTES = 16 << 20


@dataclass(frozen=True)
class Change:
    """Row counts of one change; `skipped` if its batch had been applied before."""

    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    deleted: int = 0
    skipped: bool = False


@dataclass(frozen=True)
class State:
    """What the newest manifest says: partitions and their folders, the last batch of each stream and the load it began, the bucket count."""

    commit: int
    buckets: int
    parts: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    began: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """`part` gives the partition column for a bucket count, which is fixed when the table is created.

    `derived` columns are made of the others at each upsert; `cluster` orders the files (by default the key does).
    `by_key` says that the first key alone decides the partition. `order` names the column that settles
    conflicts, see `upsert_rows`.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], part: Callable[[int], Column],
        order: str | None = None, derived: dict[str, Column] | None = None, cluster: Sequence[str] = (), by_key: bool = False,
        row_group_bytes: int = ROW_GROUP_BYTES,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.part, self.by_key = list(keys), part, by_key
        self.derived, self.cluster = derived or {}, list(cluster) or self.keys
        self.order = order
        self.writer = {"parquet.block.size": str(row_group_bytes), f"parquet.bloom.filter.enabled#{self.keys[0]}": "true"}

    # -- manifest -------------------------------------------------------------

    def create(self, buckets: int = 1) -> "KeyedTable":
        self._write_manifest(State(0, buckets))
        return self

    def _manifest(self) -> State:
        """One line per partition or stream: days or buckets, never data rows. Found by names, read without a job."""
        commits = f"{self.path}/commits"
        numbers = sorted((int(n.removeprefix("commit=")) for n in names_in(self.spark, commits) if n.startswith("commit=")), reverse=True)
        for last in numbers:  # the newest is not whole while its file is missing
            files = [n for n in names_in(self.spark, f"{commits}/commit={last}") if n.startswith("part-")]
            if files:
                rows = [json.loads(line) for name in files for line in read_lines(self.spark, f"{commits}/commit={last}/{name}")]
                marks = [r for r in rows if "stream" in r]
                return State(
                    last, next(r["buckets"] for r in rows if "buckets" in r), {r["part"]: r["c"] for r in rows if "part" in r},
                    {r["stream"]: r["batch_id"] for r in marks}, {r["stream"]: r["began"] for r in marks if "began" in r},
                )
        raise FileNotFoundError(f"no table at {self.path}")

    def _write_manifest(self, state: State) -> None:
        rows = [{"buckets": state.buckets}]
        rows += [{"part": p, "c": c} for p, c in state.parts.items()]
        rows += [{"stream": s, "batch_id": b, **({"began": state.began[s]} if s in state.began else {})} for s, b in state.batches.items()]
        # one file, so that it appears whole or not at all
        write_lines(self.spark, f"{self.path}/commits/commit={state.commit}/part-0.json", [json.dumps(row) for row in rows])

    # -- reads ----------------------------------------------------------------

    def _scan(self, parts: dict[str, int]) -> DataFrame:
        """The named partitions, with `part` as a column that prunes folders."""
        if not parts:
            return self.spark.createDataFrame([], self._part_schema())
        paths = [f"{self.path}/data/c={c}/part={p}" for p, c in parts.items()]
        return (
            self.spark.read.schema(self._part_schema()).option("basePath", f"{self.path}/data")
            .parquet(*paths).select(*self.schema.fieldNames(), "part")
        )

    def _part_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("part", T.StringType())])

    def read(self, low: str | None = None, high: str | None = None, key=None, parts: set[str] | None = None) -> DataFrame:
        """The current rows; `low` and `high` (inclusive) or `parts` pick partitions by name, `key` the rows of one first key.

        The equality reaches the scan, where row groups are skipped by their statistics, dictionaries and bloom filters; where the key
        decides the partition, only that one is opened.
        """
        state = self._manifest()
        chosen = {p: c for p, c in state.parts.items() if (low is None or p >= low) and (high is None or p <= high) and (parts is None or p in parts)}
        if key is None:
            return self._scan(chosen).drop("part")
        if self.by_key:
            kind = self.schema[self.keys[0]].dataType
            own = self.spark.sql("SELECT :key AS key", {"key": key}).select(F.col("key").cast(kind).alias(self.keys[0])).select(self.part(state.buckets)).first()[0]
            chosen = {p: c for p, c in chosen.items() if p == own}
        return self._scan(chosen).drop("part").where(F.col(self.keys[0]) == key)

    def read_after(self, commit: int) -> tuple[int, DataFrame]:
        """The newest commit, and all rows of the partitions written after `commit`: what changed since is among them."""
        state = self._manifest()
        return state.commit, self._scan({p: c for p, c in state.parts.items() if c > commit}).drop("part")

    def is_empty(self) -> bool:
        """Whether the table has no partition; the manifest tells."""
        return not self._manifest().parts

    def last_batch(self, stream: str) -> int | None:
        return self._manifest().batches.get(stream)

    def began(self, stream: str) -> int | None:
        """The load number under which a stream wrote its first batch here."""
        return self._manifest().began.get(stream)

    def superseded(self) -> DataFrame:
        """`folder` of each partition version and manifest no longer current, for whoever frees the space.

        Only once no reader is left that started before the newest commit.
        """
        last = self._manifest().commit
        every = self.spark.read.schema(MANIFEST).json(f"{self.path}/commits").withColumn("commit", F.col("commit").cast("bigint"))
        folder = F.concat(F.lit(f"{self.path}/data/c="), F.col("c").cast("string"), F.lit("/part="), "part").alias("folder")
        versions = every.where("part is not null").select("commit", folder)
        old = versions.where(F.col("commit") < last).select("folder").distinct().join(versions.where(F.col("commit") == last), "folder", "left_anti")
        return old.unionByName(every.where(F.col("commit") < last).select(F.concat(F.lit(f"{self.path}/commits/commit="), F.col("commit").cast("string")).alias("folder")).distinct())

    # -- changes --------------------------------------------------------------

    def _commit(self, rows: DataFrame, commit: int, *observed: Column) -> dict:
        """Write partitions of a commit, and return what was `observed` of the rows written.

        Rebalancing splits a large partition by its size without a sampling pass, which would run the merge twice;
        every file is ordered by the cluster. The counts are taken behind that shuffle, in the tasks that write, so a
        repeated map task cannot count twice.
        """
        dealt, seen = rows.hint("rebalance", "part"), Observation()
        dealt = dealt.observe(seen, *observed) if observed else dealt
        ordered = dealt.sortWithinPartitions("part", *self.cluster).drop(ACTION)
        ordered.write.options(**self.writer).mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/c={commit}")
        return seen.get if observed else {}

    def upsert(
        self, source: DataFrame, batch_ts: datetime, update: Sequence[str] | None = None,
        batch_id: int | None = None, stream: str = "batch", touch_unchanged: bool = False, began: int | None = None, ordered: bool = True,
    ) -> Change:
        """Merge rows, one per key. An empty source is a no-op. `batch_id` makes it replayable, `began` is kept with its stream.

        The merge runs once: it writes the partitions met and counts on the way, and those in which nothing is new or
        differs are unlinked again; if there is no other, at most the replay mark moves. The source is staged in the
        shared folder, as it is read more than once. A missing `written` counts as the newest. A stream's pages may come out of order, so
        with a `batch_id` the last writer of a row moves on even if it changes nothing. Without `ordered` the source wins anyhow.
        """
        state = self._manifest()
        if batch_id is not None and batch_id <= state.batches.get(stream, -1):
            return Change(skipped=True)
        folder, seen = work_dir(self.spark, "upsert"), Observation()
        rows = source.withColumns(self.derived)
        if self.order and self.order not in rows.columns:
            rows = rows.withColumn(self.order, F.lit(None).cast(self.schema[self.order].dataType))
        rows = rows.select(*[c for c in self.schema.fieldNames() if c != STAMP]).withColumn("part", self.part(state.buckets))
        rows.observe(seen, F.collect_set("part").alias("parts")).write.parquet(folder)
        try:
            staged = self.spark.read.schema(rows.schema).parquet(folder)
            mark = {} if batch_id is None else {stream: batch_id}
            after = replace(state, commit=state.commit + 1, batches={**state.batches, **mark}, began=state.began if began is None else {stream: began, **state.began})
            return self._merge(state, after, staged, seen.get["parts"], batch_ts, update, touch_unchanged, bool(mark), self.order if ordered else None)
        finally:
            drop_dir(self.spark, folder)

    def _merge(self, state: State, after: State, staged: DataFrame, parts: list[str], batch_ts, update, touch_unchanged: bool, marked: bool, order: str | None) -> Change:
        fresh, met = [p for p in parts if p not in state.parts], [p for p in parts if p in state.parts]
        written = []
        if fresh:
            new = staged.where(F.col("part").isin(fresh)).withColumns({STAMP: utc_literal(batch_ts), ACTION: F.lit("inserted")})
            written.append(new.select(*self.schema.fieldNames(), ACTION, "part"))
        if met:
            target = self._scan({p: state.parts[p] for p in met}).drop("part")
            both = upsert_rows(
                target, staged.where(F.col("part").isin(met)), self.keys, batch_ts, update, touch_unchanged, order, advance=marked
            )
            written.append(both.withColumn("part", self.part(state.buckets)))
        counts = {}
        if written:
            moves = F.col(ACTION).isin("inserted", "updated", "advanced", *(["unchanged"] if touch_unchanged else []))
            moved = F.collect_set(F.when(moves, F.col("part"))).alias("moved")
            counts = dict(self._commit(reduce(DataFrame.unionByName, written), after.commit, *action_counts(), moved))
            moved = set(counts.pop("moved"))
            for p in set(parts) - moved:
                drop_dir(self.spark, f"{self.path}/data/c={after.commit}/part={p}")
            if moved:
                after = replace(after, parts={**state.parts, **{p: after.commit for p in moved}})
            elif not marked:
                drop_dir(self.spark, f"{self.path}/data/c={after.commit}")
        if after.parts != state.parts or marked:
            self._write_manifest(after)
        return Change(**counts)

    def _rewrite(self, state: State, doomed: DataFrame, keep) -> int:
        """Drop the `doomed` rows of the table: `keep` filters them out of a partition scan."""
        lost = {r["part"]: r["n"] for r in doomed.groupBy("part").agg(F.count("*").alias("n")).collect()}
        if not lost:
            return 0
        hit = self._scan({p: state.parts[p] for p in lost})
        sizes = {r["part"]: r["n"] for r in hit.groupBy("part").agg(F.count("*").alias("n")).collect()}
        partial = {p: state.parts[p] for p in lost if lost[p] < sizes[p]}
        commit = state.commit + 1
        if partial:
            self._commit(keep(self._scan(partial)), commit)
        left = {p: (commit if p in partial else c) for p, c in state.parts.items() if p in partial or p not in lost}
        self._write_manifest(replace(state, commit=commit, parts=left))
        return sum(lost.values())

    def unlink_below(self, part: str) -> int:
        """Let go of whole partitions whose name is below `part`; no data is read. How many there were."""
        state = self._manifest()
        left = {p: c for p, c in state.parts.items() if p >= part}
        if len(left) < len(state.parts):
            self._write_manifest(replace(state, commit=state.commit + 1, parts=left))
        return len(state.parts) - len(left)

    def prune(self, since: datetime, column: str = STAMP) -> Change:
        """Delete rows whose change stamp is older than `since`; wholly old partitions are just unlinked."""
        state, keep = self._manifest(), kept_since(column, since)
        doomed = self._scan(state.parts).where(F.col(column) < utc_literal(since))
        return Change(deleted=self._rewrite(state, doomed, lambda rows: rows.where(keep)))

    def delete_matching(self, keys: DataFrame, key: str, sized: bool = False) -> Change:
        """Delete every row whose `key` is among `keys`; `sized` if they are a measured side already."""
        state, gone = self._manifest(), keys if sized else station_side(keys, key)
        doomed = present_rows(self._scan(state.parts), gone, key, sized=True)
        return Change(deleted=self._rewrite(state, doomed, lambda rows: absent_rows(rows, gone, key, sized=True)))


def station_bucket(buckets: int) -> Column:
    return F.format_string("%04d", F.pmod(F.xxhash64("node_id"), F.lit(buckets)))


def station_table(spark: SparkSession, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> KeyedTable:
    """Stations by hash bucket: one row per key, so buckets are even. How many is said at `create`.

    A bucket is ordered by the folded postcode, so a prefix reads few row groups of each; a key reads one bucket.
    """
    folded = {schemas.POSTCODE_KEY: text.fold(F.col("postcode"))}
    cluster = (schemas.POSTCODE_KEY, *schemas.STATION_KEY)
    return KeyedTable(spark, path, schemas.STATIONS, schemas.STATION_KEY, station_bucket, ORDER, folded, cluster, True, row_group_bytes)


def price_table(spark: SparkSession, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> KeyedTable:
    """Prices by the day of their change, a part of the key.

    New prices fall on few days, so an upsert reads and rewrites only those; and a
    station with a third of all prices is spread over every day it has traded.
    """
    part = F.date_format("price_last_updated", "yyyy-MM-dd")
    return KeyedTable(spark, path, schemas.PRICES, schemas.PRICE_KEY, lambda buckets: part, ORDER, row_group_bytes=row_group_bytes)


def parked_table(spark: SparkSession, path: str) -> KeyedTable:
    """Prices waiting for their station, by the day they came, so that old ones are let go as whole partitions."""
    return KeyedTable(spark, path, schemas.PARKED, (*schemas.PRICE_KEY, "arrived"), lambda buckets: F.col("arrived"), ORDER)


def latest_table(spark: SparkSession, path: str) -> KeyedTable:
    """The newest price of each station and product, in the buckets of the stations."""
    return KeyedTable(spark, path, schemas.LATEST, schemas.LATEST_KEY, station_bucket, "moment", by_key=True)


def cursor_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, schemas.CURSORS, ("id",), lambda buckets: F.lit("all"))


def prune_stations(stations: KeyedTable, prices: KeyedTable, since: datetime) -> tuple[Change, Change]:
    """Delete old stations and, first, the prices that hang on them.

    Prices go first: a run that dies in between is put right by running it again.
    """
    gone = stations.read().where(F.col(STAMP) < utc_literal(since))
    dropped = prices.delete_matching(gone, "node_id")
    return stations.prune(since), dropped
