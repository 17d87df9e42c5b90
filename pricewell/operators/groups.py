"""Per-group answers that hold when one group has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.session import work_dir

POINTS_PER_CHUNK = 10_000


def top_row(df: DataFrame, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The row of each group with the greatest `rank` columns, ties broken by the rest.

    A maximum over a struct is combined before the shuffle, so each map task sends one
    row per group however large the group is. Comparing the whole row makes the
    winner of a tie the same on every run.
    """
    rest = [c for c in df.columns if c not in keys and c not in rank]
    best = F.max(F.struct(*rank, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def latest_per_type(
    prices: DataFrame, key: str = "node_id", fuel: str = "fuel_type_id",
    updated: str = "price_last_updated", effective: str = "price_change_effective_timestamp",
) -> DataFrame:
    """Newest price of each station and product; then latest effective, then dearest."""
    return top_row(prices.select(key, fuel, updated, effective, "price"), [key, fuel], [updated, effective, "price"])


def last_writer(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What applying the rows in `order` one by one would leave under each key."""
    return top_row(rows, keys, order)


def bounded_arrays(
    rows: DataFrame, keys: Sequence[str], bucket: Column, element: Column, out: str, size: int = POINTS_PER_CHUNK
) -> DataFrame:
    """Group `element` structs into sorted arrays of `size` items, the last one of a bucket shorter.

    Columns: `keys`, `bucket`, `part`, `out`. `bucket` rises with the first field of
    `element`; read in (`bucket`, `part`) order the arrays of a group give all of it in
    order. Item n of a bucket, from 0, is in part n div `size`, however many rows there are.

    Groups are told apart by their size, counted before the shuffle. One of at most `POINTS_PER_CHUNK` items (or `size`) is no
    longer than an array may be: it is collected and sorted whole and then cut. Larger ones, few, go by slices.
    """
    group, longest = [*keys, "bucket"], max(size, POINTS_PER_CHUNK)
    items = rows.select(*keys, bucket.alias("bucket"), element.alias("_element"))
    items = items.withColumn("_element", _one_zero(F.col("_element"), items.schema["_element"].dataType))
    folder = work_dir(rows.sparkSession, "arrays")
    counts = items.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > longest)
    counts.select(*[F.col(c).alias(f"_long_{c}") for c in group]).write.parquet(f"{folder}/long")
    long = rows.sparkSession.read.schema(T.StructType([T.StructField(f"_long_{c}", items.schema[c].dataType) for c in group])).parquet(f"{folder}/long")
    if long.isEmpty():
        return _whole_groups(items, group, out, size)
    # null-safe on every key, as grouping is; there is one long group in `longest` rows at most
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_long_{c}")) for c in group])
    whole, sliced = (items.join(F.broadcast(long), same, how) for how in ("left_anti", "left_semi"))
    return _whole_groups(whole, group, out, size).unionByName(_sliced_groups(sliced, group, out, size, f"{folder}/slices"))


def _one_zero(element: Column, kind: T.StructType) -> Column:
    """The struct with 0.0 for -0.0, as grouping makes of the two."""
    def field(c: Column, kind: T.DataType) -> Column:
        return F.when(c == 0, F.lit(0).cast(kind)).otherwise(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c

    return F.struct(*[field(element[f.name], f.dataType).alias(f.name) for f in kind.fields])


def _whole_groups(items: DataFrame, group: list[str], out: str, size: int) -> DataFrame:
    """Parts of groups that fit an array. Rows are shuffled first: a map task holds too few of a group for collecting there to pay."""
    collected = items.repartition(*group).groupBy(*group).agg(F.sort_array(F.collect_list("_element")).alias("_all"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / size).cast("int"))
    parts = F.transform(numbers, lambda n: F.slice("_all", n * size + 1, size))
    return collected.select(*group, F.posexplode(parts).alias("part", out)).withColumn("part", F.col("part").cast("bigint"))


def _sliced_groups(items: DataFrame, group: list[str], out: str, size: int, folder: str) -> DataFrame:
    """The same for groups of any size.

    Equal items are counted first, combined before the shuffle. What is left is cut into
    slices by range over (keys, bucket, element) and staged, so a group of any size is spread over
    tasks, one whose items share an instant included. Items are numbered inside their
    slice, plus what earlier slices hold of the bucket. That list is broadcast: a slice has at most
    one bucket that an earlier one began, so it is no longer than the number of slices.
    """
    counted = items.groupBy(*group, "_element").agg(F.count("*").alias("_copies"))
    sliced = counted.repartitionByRange(*group, "_element").withColumn("_slice", F.spark_partition_id())
    sliced.write.parquet(folder)
    staged = items.sparkSession.read.schema(sliced.schema).parquet(folder)

    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = staged.groupBy(*group, "_slice").agg(F.sum("_copies").alias("_held"))
    begun = held.withColumn("_before", F.sum("_held").over(earlier)).where("_before > 0")
    begun = begun.select(*[F.col(c).alias(f"_begun_{c}") for c in group], F.col("_slice").alias("_begun_slice"), "_before")
    # null-safe on every key, as grouping is
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_begun_{c}")) for c in group], F.col("_slice") == F.col("_begun_slice"))
    inside = Window.partitionBy(*group, "_slice").orderBy("_element").rowsBetween(Window.unboundedPreceding, 0)
    numbered = staged.withColumn("_end", F.sum("_copies").over(inside)).join(F.broadcast(begun), same, "left")
    numbered = numbered.withColumn("_end", F.col("_end") + F.coalesce("_before", F.lit(0))).withColumn("_start", F.col("_end") - F.col("_copies"))
    # copies of one item may go on over several parts
    parts = F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size))
    dealt = numbered.select(*group, "_element", "_start", "_end", F.explode(parts).alias("part"))
    times = F.least("_end", (F.col("part") + 1) * size) - F.greatest("_start", F.col("part") * size)
    once = F.sort_array(F.collect_list(F.struct("_element", times.cast("int").alias("times"))))
    repeated = F.flatten(F.transform(once, lambda i: F.array_repeat(i["_element"], i["times"])))
    return dealt.groupBy(*group, "part").agg(repeated.alias(out))


def first_row_label(label: Column, group: Sequence[str], order: Sequence[str]) -> Column:
    """`label` on the first row of each group, blank below it. For groups of bounded size."""
    w = Window.partitionBy(*group).orderBy(*order)
    return F.when(F.row_number().over(w) == 1, label).otherwise(F.lit(""))
