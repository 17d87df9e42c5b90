"""Ranked lexical search by pipelined term partitioning, with integer scores.

One pass over the documents writes blocks of postings of the terms that items may hold. The terms of a block are dealt to owners by how many
of its documents hold them: the first owner has the rarest. Items travel in bundles: a bundle meets
a block's owners one after the other, each stage a cogroup of the bundle's accumulators with that owner's postings. A stage
adds its contributions; after it, documents that cannot reach the k best of the block any more, by the largest contributions that the later owners
can still add, are let go, so accumulators stay sparse and the result exact. The last stage
selects each item's best of the block, and a window over these few rows merges the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm import packed as P
from pricewell.llm import textops as T
from pricewell.session import work_dir

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 21
BUNDLE_TERMS = 8192
# Owner i has the terms that at most this share of a block's documents hold, the last one all others.
OWNERS = (1 / 32, 1 / 4, 1.0)
# Marks of terms that items hold, one bit each: the table has this size however many items there are.
SIEVE_BITS = 22

BLOCKS = "block long, owner int, n_held long, n_terms long, terms array<string>, counts array<long>, packed binary"
STATE = "bundle int, slot int, block long, packed binary"
BEST = "item_id long, doc_id long, score long"


def _sieve_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> T.U(64 - SIEVE_BITS)).astype(np.int64)


def _slots_of_terms(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in T.pieces(batch.column("term"), docs=1 << 16):
            hashes = T.BYTES_OF[0].slices(T.BYTE_VALUES[0][piece.data], piece.offsets[:-1], piece.offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array(_sieve_slots(hashes), pa.int64())], names=["slot"])


def _sieve(terms: DataFrame) -> np.ndarray:
    """A bit for every hash prefix that a term has: at most 2**22 bits, whatever the number of terms."""
    slots = terms.select("term").mapInArrow(_slots_of_terms, "slot long")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 6), "<u8")
    for word, bits in words.collect():
        out[word] = bits & 0xFFFFFFFFFFFFFFFF
    return out


class _Block:
    """Postings of some documents, kept until the block is full."""

    def __init__(self):
        self.ids, self.lengths, self.hashes, self.docs, self.tf, self.names, self.n, self.postings = [], [], [], [], [], {}, 0, 0

    def add(self, piece: T.Piece, ids: pa.Array, sieve: np.ndarray) -> None:
        found = T.words(piece, NOT_TERM)
        hashes = T.word_hashes(piece, found, lower=True)
        live = np.flatnonzero(sieve[_sieve_slots(hashes)])
        names, first, back = np.unique(hashes[live], return_index=True, return_inverse=True)
        pairs, tf = np.unique(back * len(piece) + found.docs()[live], return_counts=True)
        term, doc = np.divmod(pairs, len(piece))
        for name, at in zip(names.tolist(), live[first].tolist()):
            if name not in self.names:
                self.names[name] = T.LOWER[piece.data[found.starts[at]:found.ends[at]]].tobytes().decode()
        self.ids.append(ids)
        self.lengths.append(found.counts())
        self.hashes.append(names[term] if len(names) else np.zeros(0, T.U))
        self.docs.append(doc + self.n)
        self.tf.append(tf)
        self.n += len(piece)
        self.postings += len(tf)

    def rows(self, block: int) -> pa.RecordBatch:
        lengths = np.concatenate(self.lengths).astype(np.int64)
        hashes, docs, tf = np.concatenate(self.hashes), np.concatenate(self.docs), np.concatenate(self.tf).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, docs, tf = hashes[order], docs[order], tf[order]
        first, count = P.groups(hashes)
        owner = np.searchsorted(np.array(OWNERS[:-1]) * self.n, count, side="left")
        by_owner = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[by_owner], np.arange(len(OWNERS) + 1))
        names = [self.names[h] for h in hashes[first[by_owner]].tolist()]
        top = np.maximum.reduceat(tf, first)[by_owner] if len(first) else tf
        least = np.minimum.reduceat(lengths[docs], first)[by_owner] if len(first) else tf
        ids = pa.concat_arrays([i.cast(pa.int64()) for i in self.ids])
        null = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0), np.int64)
        packed = []
        for o in range(len(OWNERS)):
            mine = by_owner[bounds[o]:bounds[o + 1]]
            at = P.expand(first[mine], count[mine])
            columns = [count[mine].astype("<i4"), docs[at].astype("<u2"), tf[at].astype("<i4"), lengths.astype("<i4")]
            columns += [bounds.astype("<i4"), top.astype("<i8"), least.astype("<i8")] if o == 0 else []
            columns += [ids.astype("<i8"), null.astype("u1")] if o == len(OWNERS) - 1 else []
            packed.append(P.join(*columns))
        n, rest = len(OWNERS), len(OWNERS) - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([int((lengths > 0).sum()), *[0] * rest], pa.int64()),
                pa.array([int(lengths.sum()), *[0] * rest], pa.int64()), pa.array([names, *[[]] * rest], pa.list_(pa.string())),
                pa.array([count[by_owner].tolist(), *[[]] * rest], pa.list_(pa.int64())), pa.array(packed, pa.binary()),
            ],
            names=["block", "owner", "n_held", "n_terms", "terms", "counts", "packed"],
        )


def _blocks(batches, sieve, block_docs: int) -> Iterator[pa.RecordBatch]:
    bits = np.unpackbits(sieve.value.view(np.uint8), bitorder="little").astype(bool)
    number, block = TaskContext.get().partitionId() << 32, _Block()
    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            if block.n and (block.n + len(piece) > block_docs or block.postings >= BLOCK_POSTINGS):
                yield block.rows(number)
                number, block = number + 1, _Block()
            block.add(piece, batch.column("doc_id").slice(piece.first, len(piece)), bits)
    if block.n:
        yield block.rows(number)


def _columns(blob: pa.Scalar, *kinds: str) -> list[np.ndarray]:
    return P.split([blob], *kinds)


class _Postings:
    """One owner's postings of a block, with the factor that a term's weight is multiplied by."""

    def __init__(self, blob: pa.Scalar, first: bool, last: bool, n_docs: int, n_terms: int):
        kinds = ["<i4", "<u2", "<i4", "<i4", *(["<i4", "<i8", "<i8"] if first else []), *(["<i8", "u1"] if last else [])]
        count, self.docs, tf, self.lengths, *more = _columns(blob, *kinds)
        self.ends = np.cumsum(count, dtype=np.int64)
        self.starts = self.ends - count
        self.scale = (n_docs, n_terms)
        self.factor = self.factors(tf.astype(np.int64), self.lengths.astype(np.int64)[self.docs])
        self.more = more

    def factors(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        n_docs, n_terms = self.scale
        m = 75 + (25 * length * n_docs) // n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _State:
    """A bundle in one block: its items' terms there with their owners and weights, and sparse accumulators.

    ``closed`` items take no further documents; ``rest`` is what the owners from each on can still add.
    """

    KINDS = ("<i8", "u1", "<i4", "u1", "<i4", "<i8", "<i8", "u1", "<i8", "<u2", "<i8")

    def __init__(self, *columns: np.ndarray):
        self.items, self.null, self.of, self.owner, self.term, self.weight, self.rest, self.closed, self.counts, self.docs, self.scores = columns

    @classmethod
    def start(cls, bundle: list, terms: list[str], postings: _Postings) -> _State:
        bounds, top, least = postings.more[:3]
        place = {t: n for n, t in enumerate(terms)}
        live = sorted(((b["item_id"] is None, b["item_id"] or 0, place[b["term"]], b["weight"]) for b in bundle if b["term"] in place))
        keys, of = {}, []
        for null, item, *_ in live:
            of.append(keys.setdefault((null, item), len(keys)))
        at, weight = np.array([x[2] for x in live], np.int64), np.array([x[3] for x in live], np.int64)
        owner = np.searchsorted(bounds, at, side="right") - 1
        most = weight * postings.factors(top, least)[at]
        rest = np.zeros((len(keys), len(OWNERS) + 1), np.int64)
        np.add.at(rest, (np.array(of, np.int64), owner), most)
        rest = rest[:, ::-1].cumsum(1)[:, ::-1]
        n = len(keys)
        return cls(
            np.array([k[1] for k in keys], "<i8"), np.array([k[0] for k in keys], "u1"), np.array(of, "<i4"), owner.astype("u1"),
            (at - bounds[owner]).astype("<i4"), weight, rest.reshape(-1), np.zeros(n, "u1"), np.zeros(n, "<i8"), np.zeros(0, "<u2"), np.zeros(0, "<i8"),
        )

    def packed(self) -> bytes:
        columns = (self.items, self.null, self.of, self.owner, self.term, self.weight, self.rest, self.closed, self.counts, self.docs, self.scores)
        return P.join(*(c.astype(k) for c, k in zip(columns, self.KINDS)))

    def visit(self, postings: _Postings, owner: int, k: int) -> None:
        """Add the contributions of one owner's terms, then let go of documents that cannot be among the k best."""
        rest = self.rest.reshape(len(self.items), len(OWNERS) + 1)[:, owner + 1]
        mine = np.flatnonzero(self.owner == owner)
        begin = np.searchsorted(self.of[mine], np.arange(len(self.items) + 1))
        ends = np.cumsum(self.counts)
        total = np.zeros(len(postings.lengths), np.int64)
        docs, scores, counts = [], [], np.zeros(len(self.items), np.int64)
        for i in range(len(self.items)):
            had = self.docs[ends[i] - self.counts[i]:ends[i]]
            total[had] = self.scores[ends[i] - self.counts[i]:ends[i]]
            for e in mine[begin[i]:begin[i + 1]].tolist():
                s, t = postings.starts[self.term[e]], postings.ends[self.term[e]]
                total[postings.docs[s:t]] += self.weight[e] * postings.factor[s:t]
            live = had if self.closed[i] else np.flatnonzero(total)
            score = total[live]
            total[:] = 0
            if len(live) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                self.closed[i] |= rest[i] < least
                keep = score + rest[i] >= least
                live, score = live[keep], score[keep]
            docs.append(live)
            scores.append(score)
            counts[i] = len(live)
        self.docs, self.scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, scores))
        self.counts = counts

    def best(self, postings: _Postings, k: int) -> pa.Table:
        """Rows of the k best of each item, ties to the smaller id."""
        ids, null = postings.more[-2:]
        item = np.repeat(np.arange(len(self.items)), self.counts)
        at = self.docs.astype(np.int64)
        order = np.lexsort((ids[at], null[at], ~self.scores.astype(np.int64), item))
        item, at, score = item[order], at[order], self.scores[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < k
        item, at, score = item[keep], at[keep], score[keep]
        columns = [pa.array(self.items[item], pa.int64(), mask=self.null[item] > 0), pa.array(ids[at], pa.int64(), mask=null[at] > 0), pa.array(score, pa.int64())]
        return pa.table(columns, names=["item_id", "doc_id", "score"])


def _stage(owner: int, k: int, n_docs: int, n_terms: int):
    """The work of one owner for one bundle in one slot of blocks."""
    first, last = owner == 0, owner == len(OWNERS) - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        states = {} if first else dict(zip(left.column("block").to_pylist(), range(left.num_rows)))
        bundle = left.column("entries")[0].as_py() if first and left.num_rows else []
        out = []
        for n, block in enumerate(right.column("block").to_pylist()):
            postings = _Postings(right.column("packed")[n], first, last, n_docs, n_terms)
            if first:
                state = _State.start(bundle, right.column("terms")[n].as_py(), postings)
            elif block in states:
                state = _State(*(c.copy() for c in _columns(left.column("packed")[states[block]], *_State.KINDS)))
            else:
                continue
            state.visit(postings, owner, k)
            if last:
                out.append(state.best(postings, k))
            elif len(state.items):
                key = [right.column(c)[n].as_py() for c in ("bundle", "slot")]
                out.append(pa.table([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([block], pa.int64()), pa.array([state.packed()], pa.binary())], names=["bundle", "slot", "block", "packed"]))
        if out:
            return pa.concat_tables(out)
        kinds = [("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())] if last else [("bundle", pa.int32()), ("slot", pa.int32()), ("block", pa.int64()), ("packed", pa.binary())]
        return pa.schema(kinds).empty_table()

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, folder: str | None = None, block_docs: int = BLOCK_DOCS, bundle_terms: int = BUNDLE_TERMS
) -> DataFrame:
    """The ``k`` documents of highest score for every item: item_id, rank (from 1), doc_id, score; ties to the smaller doc_id, null last.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Terms are runs of ASCII letters and digits and of all
    other than ASCII characters, A-Z lowered. Documents without a term (null or empty texts) count nowhere. Rows
    of one doc_id are documents of their own and each may take a rank; a null doc_id is one like any other. Repeated rows of an item
    count once, different texts of one item_id add up their terms. Only scores above 0 are returned; an item without terms, or with none that a document holds,
    has no rows, nor have empty tables. ``block_docs`` (at most 65,536) and ``bundle_terms`` bound a task's work. 64-bit numbers hold as long as 25 * terms of a document * documents stays below 2**63.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "lexical")
    terms = F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().select("item_id", terms).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    sieve = spark.sparkContext.broadcast(_sieve(asked))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts.mapInArrow(lambda batches: _blocks(batches, sieve, block_docs), BLOCKS).write.parquet(folder)

    blocks = spark.read.schema(BLOCKS).parquet(folder)
    heads = blocks.where("owner = 0")
    totals = heads.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n_held"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n_docs, n_terms, slots = totals["n"], max(1, totals["l"]), max(1, totals["blocks"])
    held = heads.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(held, "term").withColumn("weight", (F.col("times") * weight).cast("long")).where("weight > 0")
    bundles = max(1, -(-asked.count() // bundle_terms))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def owned(owner: int) -> DataFrame:
        slot = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")
        return blocks.where(F.col("owner") == owner).select(every(bundles).alias("bundle"), slot.alias("slot"), "block", "packed", *(["terms"] if owner == 0 else []))

    state = (
        weighed.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int").alias("bundle"))
        .agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("entries"))
        .select("bundle", every(slots).alias("slot"), "entries")
    )
    for owner in range(len(OWNERS)):
        schema = BEST if owner == len(OWNERS) - 1 else STATE
        state = state.groupBy("bundle", "slot").cogroup(owned(owner).groupBy("bundle", "slot")).applyInArrow(_stage(owner, k, n_docs, n_terms), schema)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return state.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
