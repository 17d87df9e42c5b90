"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are laid end to end and cut into blocks of fixed length. Every
output shard draws how many of its slots each source fills, a multinomial draw made of one
hashed draw a slot. A source's slots are numbered through the shards, and slot
numbers are mapped to blocks by a pseudorandom permutation of the source's blocks (swap-or-not
rounds, another permutation for each pass over the source). A join on the block's index gives
the words that each document contributes.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.names import free_name
from pricewell.session import work_dir

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 128
SHARD_SLOTS = 1024
ROUNDS = 12
GRID = 4096
SPAN = 4096
BUCKET_DOCS = 512
TASK_SLOTS = 1 << 16
SEED = 20

WORD = r"[^\x20\x09-\x0D]+"


def _swap(x: Column, n: Column, key: Column, turn: Column) -> Column:
    """One round: x and its mirror in a keyed point change places if a keyed bit of the pair says so."""
    mirror = F.pmod(F.pmod(F.xxhash64(key, turn, F.lit(1)), n) - x, n)
    return F.when(F.xxhash64(key, turn, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Image of x in a pseudorandom permutation of 0..n-1."""
    turns = range(ROUNDS)
    turns = F.array(*[F.lit(i) for i in (reversed(turns) if inverse else turns)])
    return F.aggregate(turns, x.cast("long"), lambda at, turn: _swap(at, n, key, turn))


def running_total(rows: DataFrame, group: str, position: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` before each row of its group, one row per whole-number position.

    Totals of spans of positions come first, so no window holds a whole large group.
    """
    rows = rows.withColumn("span", F.floor(F.col(position) / SPAN))
    before = Window.partitionBy(group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(group, "span").agg(F.sum(value).alias("span_sum")).withColumn("span_before", F.coalesce(F.sum("span_sum").over(before), F.lit(0))).drop("span_sum")
    within = Window.partitionBy(group, "span").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(spans, [group, "span"])
    return joined.withColumn(name, F.col("span_before") + F.col("within")).drop("span", "span_before", "within")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """Adds ``number`` (from 1, by code point, null last) and ``target`` to (source, source_size).

    Sources share ``share`` of all sizes by weight; none gets more than ``most`` times its size, and what is
    over goes to the others by weight until none is above. Sources full at the least level come first, so the
    level of the first that is not full is the one that holds. One row per source.
    """
    numbered = sources.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1)
    numbered = numbered.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = numbered.withColumn("level", left / weight_left).withColumn("nth", F.row_number().over(order))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("nth", "level"))
    level = F.min(open_).over(all_)["level"]
    return ranked.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).drop("weight", "most", "level", "nth")


def mix(docs: DataFrame, folder: str | None = None, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, block: int = BLOCK) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and taken (words the mix takes of it, repeats counted).

    Needs doc_id, text and source; those four columns replace others of their names, all other columns stay.
    A size is the number of words; null and empty texts have none and nothing is taken of them. A null source is a
    source of its own, the last. Each source's taken words are its target, rounded; a document gives at most
    ``most`` times its size. The same rows, in any order or partitioning, give the same result; rows that
    agree in doc_id, source and size may change places. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "source-mix")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    row, of = free_name(own, "mix_row"), free_name(own, "mix_source")
    docs.select(*own, size.alias("size"), F.monotonically_increasing_id().alias(row)).write.parquet(f"{folder}/sized")
    sized = spark.read.parquet(f"{folder}/sized")
    rows = sized.select(F.col(row).alias("mix_row"), F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), "size")

    by_source = rows.groupBy(F.col("mix_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(by_source, weights, share, most)
    filled = F.greatest("source_size", F.lit(1))
    taken = F.round("target").cast("long")
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("passes", F.floor(taken / filled)).withColumn("rest", taken - F.col("passes") * F.col("source_size"))
    sources = sources.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
    extra = F.when(F.col("rest") > 0, F.least(F.col("blocks"), F.ceil(F.col("rest") / block) + 1)).otherwise(0)
    sources = sources.withColumn("slots", (F.col("passes") * F.col("blocks") + extra).cast("long"))
    key = F.xxhash64("number", F.col("passes"), F.lit(seed))
    sources = sources.withColumn("short_at", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), key, inverse=True)))
    sources.write.parquet(f"{folder}/sources")
    sources = spark.read.parquet(f"{folder}/sources")
    counts = sources.agg(F.sum("slots").alias("slots"), F.sum("n").alias("docs")).first()
    n_slots, n_docs = counts["slots"] or 0, counts["docs"] or 0

    taken_of = _block_takes(_slots(sources, n_slots, seed), sources, seed, block)
    laid = _laid_out(rows, sources, max(1, n_docs // BUCKET_DOCS), seed, block)
    overlap = F.aggregate("takes", F.lit(0).cast("long"), lambda sum_, t: sum_ + F.greatest(F.least(F.col("to"), t) - F.col("from"), F.lit(0)))
    per_row = laid.join(taken_of, ["number", "block"]).groupBy("mix_row").agg(F.sum(overlap).alias("taken"))
    named = sources.select(F.col("source").alias(of), "source_size", "target")
    whole = sized.join(per_row.withColumnRenamed("mix_row", row), row, "left").join(named, F.col("source").eqNullSafe(F.col(of)), "left")
    return whole.select(*own, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _slots(sources: DataFrame, n_slots: int, seed: int) -> DataFrame:
    """(number, shard, slot): every slot of every source once, in the shards that drew it.

    A shard's draw that a source can no longer fill stays empty; what draws left unfilled goes to shards
    of its own at the end, so each source has exactly its slots.
    """
    spark = sources.sparkSession
    shards = -(-n_slots // SHARD_SLOTS)
    cell = max(1, -(-n_slots // GRID))
    ends = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sources.where("slots > 0").select("number", "slots", F.sum("slots").over(ends).alias("hi")).withColumn("lo", F.col("hi") - F.col("slots"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    draws = spark.range(shards * SHARD_SLOTS).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n_slots))).alias("at"))
    drawn = draws.withColumn("cell", F.floor(F.col("at") / cell)).join(cells, "cell").where("at >= lo and at < hi").groupBy("number", "shard").agg(F.count("*").alias("count"))
    first = running_total(drawn, "number", "shard", "count", "first")
    got = drawn.groupBy("number").agg(F.sum("count").alias("got"))
    left = sources.select("number", "slots").join(got, "number", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("slots > got")
    late = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - F.col("got") - 1) / SHARD_SLOTS))))
    late = late.select("number", (F.col("part") + shards).alias("shard"), (F.col("got") + F.col("part") * SHARD_SLOTS).alias("first"), F.lit(SHARD_SLOTS).cast("long").alias("count"))
    every = first.select("number", "shard", "first", "count").unionByName(late).join(sources.select("number", "slots"), "number")
    every = every.withColumn("last", F.least(F.col("first") + F.col("count"), F.col("slots")) - 1).where("last >= first")
    every = every.repartition(max(1, -(-n_slots // TASK_SLOTS)), "number", "shard")
    return every.select("number", "shard", F.explode(F.sequence("first", "last")).alias("slot"))


def _block_takes(slots: DataFrame, sources: DataFrame, seed: int, block: int) -> DataFrame:
    """(number, block, takes): how many words, from its start, each pass takes of a block."""
    of = sources.select("number", "blocks", "passes", "rest", "short", "short_at")
    placed = slots.join(of, "number").withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("nth", F.pmod("slot", "blocks"))
    placed = placed.withColumn("block", permuted(F.col("nth"), F.col("blocks"), F.xxhash64("number", "pass", F.lit(seed))))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block))
    before = F.col("nth") * block - F.when(F.col("nth") > F.col("short_at"), F.lit(block) - F.col("short")).otherwise(0)
    take = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.greatest(F.least(F.col("rest") - before, length), F.lit(0)))
    return placed.select("number", "block", take.cast("long").alias("take")).where("take > 0").groupBy("number", "block").agg(F.collect_list("take").alias("takes"))


def _laid_out(rows: DataFrame, sources: DataFrame, spans: int, seed: int, block: int) -> DataFrame:
    """(mix_row, number, block, from, to): the part of each block that each row's words fill."""
    numbered = rows.where("size > 0").join(sources.select(F.col("source").alias("of"), "number"), F.col("mix_source").eqNullSafe(F.col("of"))).drop("of", "mix_source")
    numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("mix_doc", F.lit(seed)), F.lit(spans)))
    base = running_total(numbered.groupBy("number", "bucket").agg(F.sum("size").alias("total")), "number", "bucket", "total", "base").drop("total")
    before = Window.partitionBy("number", "bucket").orderBy("mix_doc", "size", "mix_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(base, ["number", "bucket"])
    placed = placed.withColumn("lo", F.col("base") + F.col("within")).withColumn("hi", F.col("lo") + F.col("size"))
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    start = F.col("block") * block
    return cut.select("mix_row", "number", "block", (F.greatest(F.col("lo"), start) - start).alias("from"), (F.least(F.col("hi"), start + block) - start).alias("to"))
