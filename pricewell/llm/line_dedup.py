"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line key, smallest document that holds it), bucketed and sorted by the key, all runs in equally many
buckets: joins between runs and with a batch dealt the same way merge bucket by bucket, without another shuffle of a run. Documents come
in batches of ascending id, whose number follows the bytes of the texts; each batch anti-joins its keys to all runs, keeps what is
new as a run of its own, and when a level has enough runs they are merged into one run of the
next level. Keys are unique over all runs, so a line stays exactly in the document that its
key's run names.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.llm import textops as T
from pricewell.llm.names import free_name
from pricewell.session import drop_dir, tidy_shuffles, work_dir

# Batches at least, which is enough for a second level, and bytes of text that a batch may have beyond that.
BATCHES = 4
BATCH_BYTES = 256 << 30
FANOUT = 2
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 8
LEAST_CHARS = 10
RUN = "key binary, owner long"


def line_key(line: bytes) -> bytes | None:
    """Digest of the line without outer white space and with A-Z lowered; None for a key that is too short."""
    key = line.strip(T.BREAKS)
    if len(key) < LEAST_CHARS or len(key.decode()) < LEAST_CHARS:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _keys_of_batches(batches):
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if text:
                found = {k for k in map(line_key, text.encode().split(b"\n")) if k is not None}
                ids += [doc] * len(found)
                keys += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])


class Runs:
    """Levelled runs in a shared folder, known to the session by temporary names until `forget`. A run is written once and never changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = LEAST_BUCKETS, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout, self.buckets = spark, folder, fanout, buckets
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def rows(self) -> DataFrame:
        tables = self.tables()
        return reduce(DataFrame.union, tables) if tables else self.spark.createDataFrame([], RUN)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/run-{len(self.names)}").saveAsTable(name)
        self.names.append(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Take in a batch (doc_id, key): keys that no run has yet, each with its smallest document."""
        owners = batch.groupBy("key").agg(F.min("doc_id").alias("owner")).repartition(self.buckets, "key")
        new = reduce(lambda left, run: left.join(run.hint("merge").select("key"), "key", "left_anti"), self.tables(), owners)
        self.levels[0].append(self._write(new.select("key", "owner")))
        self.compact()

    def compact(self) -> None:
        for level in range(len(self.levels) + 1):
            if level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                runs = [self.spark.table(name) for name in self.levels[level]]
                merged = self._write(reduce(merge, runs))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []

    def forget(self) -> None:
        """Drop the names; the files stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: they share no key, so a full outer join on their order is a merge."""
    a, b = a.hint("merge").toDF("key", "owner"), b.toDF("b_key", "b_owner")
    return a.join(b, F.col("key") == F.col("b_key"), "full_outer").select(F.coalesce("key", "b_key").alias("key"), F.coalesce("owner", "b_owner").alias("owner"))


def _drop_batches(batches, text_first: int, gone_keys: str):
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, gone in zip(batch.column(text_first), batch.column(gone_keys).to_pylist()):
            raw = (text.as_py() or "").encode().split(b"\n")
            kept = raw
            if gone:
                gone = set(gone)
                kept = [line for line in raw if line_key(line) not in gone]
            texts.append(b"\n".join(kept).decode())
            lines.append(len(raw))
            dropped.append(len(raw) - len(kept))
        names = [n for n in batch.schema.names if n != gone_keys]
        columns = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*names, "kept_text", "n_lines", "n_dropped"],
        )


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of the id range a document falls in; any cut points are right, as long as they ascend."""
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]), 1000).alias("c")).first()["c"] or []
    return reduce(lambda n, cut: n + (F.col("doc_id") > cut).cast("int"), sorted(set(cuts)), F.lit(0))


def _find_gone(known: DataFrame, folder: str, batches: int | None, fanout: int) -> None:
    """Write the keys that each document loses to the folder's `gone`; keys and runs are unlinked again."""
    spark = known.sparkSession
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches or max(BATCHES, -(-size // BATCH_BYTES))
    number = _batch_of(known.select("doc_id"), batches)
    known.select("doc_id", "text").mapInArrow(_keys_of_batches, "doc_id long, key binary").withColumn("batch", number).write.partitionBy("batch").parquet(f"{folder}/keys")
    keys = spark.read.schema("doc_id long, key binary, batch int").parquet(f"{folder}/keys")
    runs = Runs(spark, folder, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), fanout)
    try:
        for n in range(batches):
            runs.add(keys.where(F.col("batch") == n).select("doc_id", "key"))
        owned = keys.join(runs.rows(), "key").where(F.col("doc_id") > F.col("owner"))
        owned.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).write.parquet(f"{folder}/gone")
    finally:
        runs.forget()
    for name in ("keys", *(f"run-{n}" for n in range(len(runs.names)))):
        drop_dir(spark, f"{folder}/{name}")


def dedup_lines(docs: DataFrame, folder: str | None = None, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Drop every line whose key also stands in a document of smaller doc_id.

    Needs doc_id and text; adds kept_text, n_lines and n_dropped, in place of columns of those
    names, and keeps all others. A key is the line without outer white space, A-Z lowered; keys
    under 10 code points never count. Lines repeated within their key's first document stay. A
    null or empty text has one empty line. Rows of one doc_id count as one document; a null
    doc_id takes no part and keeps its lines. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "line-runs")
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    gone_doc, gone_keys = free_name(docs.columns, "gone_doc"), free_name(docs.columns, "gone_keys")
    known = docs.where(F.col("doc_id").isNotNull())
    with tidy_shuffles(spark):
        _find_gone(known, folder, batches, fanout)
    gone = spark.read.schema("doc_id long, keys array<binary>").parquet(f"{folder}/gone").toDF(gone_doc, gone_keys)
    marked = docs.join(gone, F.col("doc_id") == F.col(gone_doc), "left").drop(gone_doc)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text_at = docs.columns.index("text")
    return marked.mapInArrow(lambda b: _drop_batches(b, text_at, gone_keys), f"{schema}, kept_text string, n_lines long, n_dropped long")
