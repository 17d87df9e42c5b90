"""Price series stored in parts, so that a new point rewrites the part it falls into and those behind it.

Item n of a series and calendar bucket, from 0, is in part number n div size, as `groups.bounded_arrays` numbers a whole series at once.
All parts but the last are full, so appending in time order touches the last part of a bucket only. A partition of the table is one
part number of one bucket: full parts lie in folders that appends do not write.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell import schemas
from pricewell.operators import groups
from pricewell.session import drop_dir, work_dir
from pricewell.sources.keyed_table import Change, KeyedTable

POINT = schemas.struct(x=T.LongType(), y=T.DoubleType())
GROUP = ("node_id", "fuel_type_id", "bucket")


def series_table(spark: SparkSession, path: str, node_id: T.DataType = schemas.TEXT) -> KeyedTable:
    """Parts of all series, numbered by `nth`; `last` is the greatest point of a part, `n` how many it has."""
    schema = schemas.struct(
        node_id=node_id, fuel_type_id=T.ShortType(), bucket=schemas.MOMENT, nth=T.LongType(), data=T.ArrayType(POINT), n=T.LongType(), last=POINT,
        last_updated=schemas.MOMENT,
    )
    return KeyedTable(spark, path, schema, (*GROUP, "nth"), lambda buckets: part_name(F.col("bucket"), F.col("nth")))


def part_name(bucket: Column, nth: Column) -> Column:
    return F.format_string("%s-%010d", F.date_format(bucket, "yyyy-MM-dd"), nth)


def append(
    table: KeyedTable, points: DataFrame, now: datetime, bucket: str = "MONTH", size: int = groups.POINTS_PER_CHUNK, batch_id: int | None = None
) -> Change:
    """Add points (node_id, fuel_type_id, x in epoch ms, y) to their series, wherever in time they fall.

    Equal points stay side by side. The first part that changes is the first whose greatest point comes after the least new
    `x` with the least new `y`, else the last one if it has room. Only folders of part numbers from there on are read. `bucket`
    and `size` must be those of all appends to a table. A `batch_id` that was applied before is skipped.
    """
    spark, folder = table.spark, work_dir(table.spark, "append")
    new = points.select(
        F.col("node_id"), F.col("fuel_type_id").cast("smallint").alias("fuel_type_id"), F.date_trunc(bucket, F.timestamp_millis("x")).alias("bucket"),
        F.struct(F.col("x").cast("bigint").alias("x"), F.col("y").cast("double").alias("y")).alias("point"),
    )
    new.write.parquet(f"{folder}/new")
    try:
        new = spark.read.schema(new.schema).parquet(f"{folder}/new")
        # minima of plain columns are taken by hash, a minimum of structs by sorting all points; days are named once a group
        x, y, known = F.min("point.x"), F.min("point.y"), F.count("point.y") == F.count("*")
        least = new.groupBy(*GROUP).agg(F.struct(x.alias("x"), F.when(known, y).alias("y")).alias("_least"))
        seen, day = Observation(), F.date_format("bucket", "yyyy-MM-dd")
        least.observe(seen, F.min(day).alias("low"), F.max(day).alias("high")).write.parquet(f"{folder}/least")
        low, high = seen.get["low"], seen.get["high"]
        if low is None:
            return Change()
        least = spark.read.schema(least.schema).parquet(f"{folder}/least")
        # names are the day and the part number, so ":" comes after all of a day
        heads = table.read(low=low, high=f"{high}:").select(*GROUP, "nth", "n", "last")
        changes = (F.col("last") > F.col("_least")) | (F.col("n") < size)
        after = F.coalesce(F.min(F.when(changes, F.col("nth"))), F.max("nth") + 1, F.lit(0)).cast("bigint")
        least.join(heads, list(GROUP), "left").groupBy(*GROUP).agg(after.alias("_from"), F.max("nth").alias("_to")).write.parquet(f"{folder}/from")
        begin = spark.read.schema(least.drop("_least").schema.add("_from", "long").add("_to", "long")).parquet(f"{folder}/from")

        numbers = F.explode(F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to")))
        names = begin.select("bucket", numbers.alias("nth")).distinct().select(part_name(F.col("bucket"), F.col("nth")).alias("name"))
        stored = table.read(parts={r["name"] for r in names.collect()})
        behind = stored.join(begin, list(GROUP)).where(F.col("nth") >= F.col("_from")).select(*GROUP, F.explode("data").alias("point"))
        # bounded_arrays counts from 0, here from the first part that changes; all before it are full
        series = list(GROUP[:2])
        arrays = groups.bounded_arrays(new.unionByName(behind), series, F.col("bucket"), F.col("point"), "data", size).join(begin, list(GROUP))
        rows = arrays.select(
            *GROUP, (F.col("part") + F.col("_from")).alias("nth"), "data", F.size("data").cast("bigint").alias("n"), F.element_at("data", -1).alias("last")
        )
        return table.upsert(rows, now, batch_id=batch_id, stream="points")
    finally:
        drop_dir(spark, folder)
