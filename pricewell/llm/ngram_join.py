"""Exact Jaccard join of n-gram sets, and its groups: a size-aware heavy-light join.

Equal sets are one vertex. Sets up to a boundary size are light: two of them link exactly if
they share a subset of the size that their sizes call for, so each enumerates its fixed-size
subsets, and all that meet on one are linked in a star; nothing needs to be verified. Larger sets are
heavy: each lists its first n-grams, common ones last, and inverted lists give pairs. The
boundary is where the counted cost of both is least, from the sizes of all sets.

A list that many documents share is not scanned pair by pair. Its plainest set becomes the
hub: every member is compared to the hub and then listed under the n-grams in which it differs from
the hub. Two members close to the hub link through it; any other linked pair shares such a
difference, so nothing is lost, and those lists are short. Lists that are still long get
hubs again, until none is: a list loses its hub each time, so this ends, and no list is ever compared pair by pair.

Pairs pass a bound from parity sketches (never too strict), and an exact comparison follows.

The n-grams of the sets that are compared lie in a table bucketed by vertex, so a comparison moves its pairs to them and never
the table. Each step unlinks its shuffles when it ends and is itself unlinked when nothing reads it any more.
"""

from __future__ import annotations

import uuid
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import packed as P
from pricewell.llm import textops as T
from pricewell.llm.components import components
from pricewell.session import drop_dir, tidy_shuffles, work_dir

SMALL = 40
HOT_IN_TASK = 3
HOT_GRAMS = 1 << 17
GRAMS_AT_ONCE = 2_000_000
SCAN_AT_MOST = 64
SCAN_AT_MOST_DIFFERENT = 1024
PAIRS_AT_ONCE = 2_000_000
VERIFY_COST = 4.0
# Of documents whose n-grams are asked for, and of the hubs' n-grams: beyond it, texts or members are shuffled.
BROADCAST_ROWS = 1 << 20
BROADCAST_BYTES = 32 << 20

SETS = "doc_id long, vertex long, check long, n long, sketch binary, small array<long>"
LIST_KINDS = ("<u8", "<i8", "<i4", "<i4", "<i4")
FOUND = "wide boolean, key long, u long, v long, n int, rare int"
DIFFERENCE_KINDS = ("<u8", "<i8", "<i4", "<i4", "<i4", "?")


class Threshold:
    """Sets link when ``whole`` * common >= ``part`` * union; all bounds in whole numbers."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def common(self, n, m):
        """Least common elements of linked sets of sizes n and m."""
        return -(-self.part * (n + m) // (self.part + self.whole))

    def close(self, different, n, m):
        """Whether sets that differ in so many elements link."""
        return (self.part + self.whole) * different <= (self.whole - self.part) * (n + m)

    def differ(self, n):
        """Most elements in which a set of size n and one that links with it differ."""
        return (self.whole - self.part) * (n + n * self.whole // self.part) // (self.part + self.whole)

    def least(self, n):
        return -(-self.part * n // self.whole)

    def most(self, n):
        return n * self.whole // self.part


def _sets(piece: T.Piece, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of every document in order of their hash, and where each document begins."""
    found = T.words(piece)
    hashes = T.word_hashes(piece, found, lower=True)
    at = T.windows(found, words)
    short = np.flatnonzero((found.counts() > 0) & (found.counts() < words))
    starts = np.concatenate([at, found.bounds[short]])
    ends = np.concatenate([at + words, found.bounds[short + 1]])
    docs = np.concatenate([found.docs()[at], short]).astype(T.U)
    keys = np.unique((docs << T.U(56)) | (T.gram_hashes(hashes, starts, ends) >> T.U(8)))
    bounds = np.searchsorted(keys, np.arange(len(piece), dtype=T.U) << T.U(56))
    return keys & T.U((1 << 56) - 1), np.append(bounds, len(keys))


def _signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set, sums of the mixed elements."""
    sums = []
    for salt in (T.U(0x51), T.U(0x7F3)):
        total = np.concatenate([[T.U(0)], np.cumsum(T.mix(grams * T.U(2) + salt), dtype=T.U)])
        sums.append(T.mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _sketch(grams: np.ndarray) -> bytes:
    """Parity of the number of elements per slot. Sketches of two sets differ in at most as many bits as the sets in elements."""
    bits = 64
    while bits < len(grams):
        bits *= 2
    slots = np.bincount((T.mix(grams) & T.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(slots.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Differing bits, the larger sketch folded to the size of the smaller: a lower bound of the elements that differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _set_batches(batches, words: int):
    """One row per document, and rows of n-grams that several documents of the task hold (their doc_id null)."""
    held, size = [], 0
    empty = pa.nulls

    def common():
        names, counts = np.unique(np.concatenate(held), return_counts=True)
        hot = counts >= HOT_IN_TASK
        n = int(hot.sum())
        return pa.RecordBatch.from_arrays(
            [empty(n, pa.int64()), pa.array(names[hot].view(np.int64)), empty(n, pa.int64()), pa.array(counts[hot], pa.int64()),
             empty(n, pa.binary()), empty(n, pa.list_(pa.int64()))],
            names=["doc_id", "vertex", "check", "n", "sketch", "small"],
        )

    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            grams, bounds = _sets(piece, words)
            first, second = _signatures(grams, bounds)
            counts = np.diff(bounds)
            parts = [grams[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(piece.first, len(piece)), pa.array(first), pa.array(second), pa.array(counts, pa.int64()),
                    pa.array([_sketch(p) for p in parts], pa.binary()),
                    pa.array([p.view(np.int64).tolist() if len(p) <= SMALL else None for p in parts], pa.list_(pa.int64())),
                ],
                names=["doc_id", "vertex", "check", "n", "sketch", "small"],
            )
            held.append(grams)
            size += len(grams)
            if size >= GRAMS_AT_ONCE:
                yield common()
                held, size = [], 0
    if held:
        yield common()


def light_keys(n: int, limit: Threshold) -> int:
    """Subsets that a light set of size n enumerates."""
    return sum(comb(n, limit.common(n, m)) for m in range(limit.least(n), limit.most(n) + 1) if limit.common(n, m) <= n)


def boundary(sizes: dict[int, int], limit: Threshold) -> int:
    """Largest light size: the one of least cost, subsets to enumerate against list entries and comparisons."""
    best, best_cost = 1, float("inf")
    for x in range(1, SMALL + 1):
        light = sum(k * light_keys(n, limit) for n, k in sizes.items() if n <= x)
        heavy = sum(k * (n - limit.least(n) + 1) * VERIFY_COST for n, k in sizes.items() if n >= limit.least(x + 1))
        if light + heavy < best_cost:
            best, best_cost = x, light + heavy
    return best


def _subset_batches(batches, limit: Threshold):
    """Keys (sizes of both sets, subset) of light sets. A subset is hashed as the sum of its elements."""
    from itertools import combinations

    for batch in batches:
        vertex, low, high, keys = [], [], [], []
        for v, grams in zip(batch.column("vertex").to_pylist(), batch.column("small").to_pylist()):
            mixed = T.mix(np.array(grams, np.int64).view(T.U) + T.U(0x9D))
            n, total = len(mixed), mixed.sum(dtype=T.U)
            for m in range(limit.least(n), limit.most(n) + 1):
                left_out = n - limit.common(n, m)
                if left_out < 0:
                    continue
                pick = np.array(list(combinations(range(n), left_out)), np.int64).reshape(comb(n, left_out), left_out)
                found = T.mix((total - mixed[pick].sum(axis=1, dtype=T.U)) + T.U(min(n, m) * 4096 + max(n, m)))
                keys += found.view(np.int64).tolist()
                vertex += [v] * len(found)
                low += [n <= m] * len(found)
                high += [n >= m] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(vertex, pa.int64()), pa.array(low, pa.bool_()), pa.array(high, pa.bool_()), pa.array(keys, pa.int64())], names=["v", "low", "high", "key"]
        )


def light_links(vertices: DataFrame, limit: Threshold, largest: int) -> DataFrame:
    """Links (u, v) between light sets: the sets of either size that meet on a key link to the least set of the other size."""
    light = vertices.where(f"n between 1 and {largest}").select("vertex", "small")
    keyed = light.mapInArrow(lambda b: _subset_batches(b, limit), "v long, low boolean, high boolean, key long")
    ends = keyed.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("high"), F.col("v"))).alias("b"))
    met = keyed.join(ends, "key")
    links = met.where("low").select(F.col("b").alias("u"), "v").union(met.where("high").select(F.col("a").alias("u"), "v"))
    return links.where("u is not null and u != v").distinct()


class Order:
    """Order of n-grams: those not known as common first, then the common ones by how common; ties by hash."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, scan: int = SCAN_AT_MOST):
        order = np.argsort(grams)
        rank = np.empty(len(grams), np.int64)
        rank[np.lexsort((grams, counts))] = np.arange(1, len(grams) + 1)
        self.grams, self.rank = grams[order], rank[order]
        self.wide = counts[order] > scan

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.rank[at], 0)

    def is_wide(self, grams: np.ndarray) -> np.ndarray:
        return P.contains(self.grams[self.wide], grams)


def _list_batches(batches, words: int, least: int, limit: Threshold, order: Order, buckets: int):
    """The first n-grams of every heavy set, packed: n-gram, vertex, size (negative: a list known to be long), place, rare n-grams."""
    seen: set[int] = set()
    for batch in batches:
        held = []
        for piece in T.pieces(batch.column("text")):
            grams, bounds = _sets(piece, words)
            vertex, _ = _signatures(grams, bounds)
            sizes = np.diff(bounds)
            take = np.zeros(len(piece), bool)
            for i in np.flatnonzero(sizes >= least).tolist():
                if int(vertex[i]) not in seen:
                    seen.add(int(vertex[i]))
                    take[i] = True
            docs = np.repeat(np.arange(len(piece)), sizes)
            rank = order.ranks(grams)
            at = np.lexsort((rank, docs)) if len(rank) else np.zeros(0, np.int64)  # stable: equal ranks stay in hash order
            place = np.arange(len(grams)) - bounds[docs]
            keep = take[docs] & (place < (sizes - limit.least(sizes) + 1)[docs])
            rare = T.doc_sums(rank == 0, bounds)
            gram, doc = grams[at[keep]], docs[keep]
            n = sizes[doc].astype("<i4")
            held.append((gram, vertex[doc], np.where(order.is_wide(gram), -n, n), place[keep], rare[doc]))
        if held:
            gram, v, n, place, rare = map(np.concatenate, zip(*held))
            route = np.where(n < 0, gram ^ v.view(T.U), gram)
            yield P.rows([
                (b, P.join(gram[i], v[i], n[i].astype("<i4"), place[i].astype("<i4"), rare[i].astype("<i4"))) for b, i in P.by_bucket(route, buckets)
            ])


def _pairs_within(start: np.ndarray, length: np.ndarray):
    """All pairs (later, earlier) within runs, a bounded number at a time."""
    cost = np.cumsum(length * (length - 1) // 2)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        index = P.expand(start[at:to], length[at:to])
        nth = index - np.repeat(start[at:to], length[at:to])
        yield np.repeat(index, nth), P.expand(np.repeat(start[at:to], length[at:to]), nth)
        at = to


def _distinct_pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)]) if len(pairs) else np.zeros(0, bool)
    return pairs[new, 0], pairs[new, 1]


def _found(pairs: list, key, v, n, rare) -> pa.Table:
    """Candidate pairs and entries of lists too long to scan, in one table."""
    a, b = _distinct_pairs(*(np.concatenate([p[i] for p in pairs]) for i in range(2))) if pairs else (np.zeros(0, np.int64),) * 2
    k, m = len(a), len(v)
    zeros = np.zeros(k, np.int64)
    return pa.table({
        "wide": pa.array(np.concatenate([np.zeros(k, bool), np.ones(m, bool)])),
        "key": pa.array(np.concatenate([zeros, key.view(np.int64)])),
        "u": pa.array(np.concatenate([a, np.zeros(m, np.int64)])),
        "v": pa.array(np.concatenate([b, v])),
        "n": pa.array(np.concatenate([zeros, n]).astype(np.int32)),
        "rare": pa.array(np.concatenate([zeros, rare]).astype(np.int32)),
    })


def _once(key: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Indexes of distinct (key, vertex), ordered by both."""
    order = np.lexsort((v, key))
    k, w = key[order], v[order]
    return order[np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])] if len(order) else order


def _scan_lists(table: pa.Table, limit: Threshold, at_most: int) -> pa.Table:
    gram, v, n, place, rare = P.split(table.column("packed"), *LIST_KINDS)
    wide = n < 0
    long_ = [(gram[wide], v[wide], -n[wide], rare[wide])]
    gram, v, n, place, rare = (x[~wide] for x in (gram, v, n, place, rare))
    once = _once(gram, v)
    gram, v, n, place, rare = (x[once] for x in (gram, v, n, place, rare))
    start, length = P.groups(gram)
    much = length > at_most
    index = P.expand(start[much], length[much])
    long_.append((gram[index], v[index], n[index], rare[index]))
    n = n.astype(np.int64)
    pairs = []
    some = (length > 1) & ~much
    for i, j in _pairs_within(start[some], length[some]):
        need = limit.common(n[i], n[j])
        ok = need <= np.minimum(n[i] - place[i], n[j] - place[j])
        pairs.append((v[i[ok]], v[j[ok]]))
    return _found(pairs, *(np.concatenate([x[i] for x in long_]) for i in range(4)))


def _difference_batches(batches, limit: Threshold, order: Order, buckets: int):
    """Members against their hub, packed: key of a difference, vertex, size, place, differences, whether linked to the hub.

    Bucket -1 holds the links themselves."""
    for batch in batches:
        held, links = [], []
        columns = (batch.column(c) for c in ("hub", "hub_grams", "v", "grams"))
        for hub, theirs, v, own in zip(*(c.to_pylist() if pa.types.is_integer(c.type) else c for c in columns)):
            theirs, own = np.frombuffer(theirs.as_buffer(), "<u8"), np.frombuffer(own.as_buffer(), "<u8")
            added, gone = own[~P.contains(theirs, own)], theirs[~P.contains(own, theirs)]
            different = len(added) + len(gone)
            linked = bool(limit.close(different, len(own), len(theirs)))
            if linked:
                links.append((hub, v))
            added = added[np.argsort(order.ranks(added), kind="stable")]
            gone = gone[np.argsort(order.ranks(gone), kind="stable")]
            listed = np.concatenate([added, gone])[: limit.differ(len(own)) + 1]
            k = len(listed)
            key = T.mix(listed ^ T.mix(np.full(k, hub, np.int64).view(T.U)))
            held.append((key, np.full(k, v, np.int64), np.full(k, len(own)), np.arange(k), np.full(k, different), np.full(k, linked)))
        parts = []
        if links:
            hubs, members = np.array(links, np.int64).T
            parts.append((-1, P.join(hubs, members)))
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            kinds = [np.dtype(k) for k in DIFFERENCE_KINDS]
            parts += [(b, P.join(*(c[i].astype(k) for c, k in zip(columns, kinds)))) for b, i in P.by_bucket(columns[0], buckets)]
        yield P.rows(parts)


def _scan_differences(table: pa.Table, limit: Threshold, at_most: int) -> pa.Table:
    key, v, n, place, size, linked = P.split(table.column("packed"), *DIFFERENCE_KINDS)
    once = _once(key, v)
    key, v, n, place, size, linked = (x[once] for x in (key, v, n, place, size, linked))
    start, length = P.groups(key)
    apart = np.add.reduceat(~linked, start) > 0 if len(start) else np.zeros(0, bool)
    much = (length > at_most) & apart
    index = P.expand(start[much], length[much])
    long_ = (key[index], v[index], n[index], size[index])
    n, size = n.astype(np.int64), size.astype(np.int64)
    pairs = []
    some = (length > 1) & ~much & apart
    for i, j in _pairs_within(start[some], length[some]):
        ok = ~(linked[i] & linked[j])
        i, j = i[ok], j[ok]
        apart_by = size[i] + size[j] - 2 * np.minimum(size[i] - place[i], size[j] - place[j])
        ok = limit.close(np.maximum(apart_by, np.abs(size[i] - size[j])), n[i], n[j])
        pairs.append((v[i[ok]], v[j[ok]]))
    return _found(pairs, *long_)


def _sketch_batches(batches, limit: Threshold):
    for batch in batches:
        rows = zip(batch.column("n_u").to_pylist(), batch.column("n_v").to_pylist(), batch.column("s_u").to_pylist(), batch.column("s_v").to_pylist())
        keep = pa.array([bool(limit.close(sketch_distance(a, b), n, m)) for n, m, a, b in rows], pa.bool_())
        yield batch.select(["u", "v"]).filter(keep)


def _verify_batches(batches, limit: Threshold):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("g_u"), batch.column("g_v")):
            a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            common = int(P.contains(a, b).sum())
            keep.append(bool(limit.close(len(a) + len(b) - 2 * common, len(a), len(b))))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _gram_batches(batches, words: int):
    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            grams, bounds = _sets(piece, words)
            blobs = [grams[s:e].astype("<u8").tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            sketches = [_sketch(grams[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vertex").slice(piece.first, len(piece)), pa.array(np.diff(bounds), pa.int64()), pa.array(sketches, pa.binary()), pa.array(blobs, pa.binary())],
                names=["vertex", "n", "sketch", "grams"],
            )


class Join:
    """The steps of one join, each written to the shared folder before the next reads it."""

    def __init__(self, docs: DataFrame, words: int, limit: Threshold, folder: str, scan: int, scan_different: int):
        self.spark: SparkSession = docs.sparkSession
        self.words, self.limit, self.folder, self.scan, self.scan_different = words, limit, folder, scan, scan_different
        self.docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.buckets = P.bucket_count(self.docs)
        self.links = 0

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def add_links(self, links: DataFrame) -> None:
        links.select("u", "v").write.parquet(f"{self.folder}/links/{self.links}")
        self.links += 1

    def sets(self) -> DataFrame:
        words = self.words
        rows = self.stage(self.docs.mapInArrow(lambda b: _set_batches(b, words), SETS), "sets")
        self.common = rows.where("doc_id is null")
        return rows.where("doc_id is not null")

    def order(self) -> Order:
        top = self.common.groupBy("vertex").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "vertex").limit(HOT_GRAMS).toArrow()
        return Order(top.column("vertex").to_numpy().view(T.U) if len(top) else np.zeros(0, T.U), top.column("n").to_numpy(), self.scan)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_dir(self.spark, f"{self.folder}/{name}")

    def keep_grams(self, texts: DataFrame) -> DataFrame:
        """The sets of the texts in a table bucketed by vertex, known to the session by a temporary name until `forget`."""
        words, self.gram_buckets, self.name = self.words, max(12, self.buckets // 4), f"ngram_sets_{uuid.uuid4().hex}"
        rows = texts.mapInArrow(lambda b: _gram_batches(b, words), "vertex long, n long, sketch binary, grams binary").repartition(self.gram_buckets, "vertex")
        rows.write.bucketBy(self.gram_buckets, "vertex").sortBy("vertex").option("path", f"{self.folder}/grams").saveAsTable(self.name)
        return self.spark.table(self.name)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.drop("grams")

    def with_sets(self, rows: DataFrame, key: str, sets: DataFrame, **columns: str) -> DataFrame:
        """`columns` of the set that `key` names. The rows go to the buckets of the table."""
        side = sets.select(F.col("vertex").alias(key), *[F.col(c).alias(name) for c, name in columns.items()])
        return rows.repartition(self.gram_buckets, key).join(side, key)

    def near(self, sides: DataFrame) -> DataFrame:
        """Pairs that their sketches do not rule out."""
        limit = self.limit
        return sides.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(lambda b: _sketch_batches(b, limit), "u long, v long")

    def verify(self, pairs: DataFrame, grams: DataFrame) -> DataFrame:
        limit = self.limit
        sides = self.with_sets(self.with_sets(pairs, "u", grams, grams="g_u"), "v", grams, grams="g_v")
        return sides.select("u", "v", "g_u", "g_v").mapInArrow(lambda b: _verify_batches(b, limit), "u long, v long")

    def heavy(self, vertices: DataFrame, order: Order, least: int) -> None:
        words, limit, buckets, scan = self.words, self.limit, self.buckets, self.scan
        listed = self.docs.select("text").mapInArrow(lambda b: _list_batches(b, words, least, limit, order, buckets), P.SCHEMA)
        found = self.stage(listed.groupBy("bucket").applyInArrow(lambda t: _scan_lists(t, limit, scan), FOUND), "found")
        wide = self.stage(found.where("wide").select("key", "v", "n", "rare").distinct(), "wide-0")
        ends = vertices.select("vertex", "n", "sketch")
        pairs = found.where("not wide").select("u", "v").distinct()
        pairs = self.stage(self.near(pairs.join(ends.toDF("u", "n_u", "s_u"), "u").join(ends.toDF("v", "n_v", "s_v"), "v")), "pairs")
        self.drop("found")
        needed = pairs.select(F.col("u").alias("vertex")).union(pairs.select("v")).union(wide.select("v")).distinct()
        needed = self.stage(vertices.join(needed, "vertex", "left_semi").select("vertex", F.col("least_doc").alias("of_doc")), "needed")
        few = needed.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(needed) if few else needed, F.col("doc_id") == F.col("of_doc")).select("vertex", "text")
        try:
            grams = self.keep_grams(texts)
            self.add_links(self.verify(pairs, grams))
            self.drop("pairs", "needed")
            self.hubs(wide, grams, order)
        finally:
            self.forget()

    def hubs(self, wide: DataFrame, grams: DataFrame, order: Order) -> None:
        limit, buckets, scan = self.limit, self.buckets, self.scan_different
        self.rounds = 0
        while not wide.isEmpty():
            n, self.rounds = self.rounds, self.rounds + 1
            hubs = wide.groupBy("key").agg(F.min(F.struct("rare", "v"))["v"].alias("hub"), F.count("*").alias("k")).where("k > 1")
            members = self.stage(wide.join(hubs, "key").where("v != hub").select("hub", "v").distinct(), f"members-{n}")
            chosen = self.stage(self.with_sets(members.select("hub").distinct(), "hub", grams, grams="hub_grams"), f"hubs-{n}")
            few = (chosen.agg(F.sum(F.octet_length("hub_grams"))).first()[0] or 0) <= BROADCAST_BYTES
            sides = self.with_sets(members, "v", grams, grams="grams").join(F.broadcast(chosen) if few else chosen, "hub").select("hub", "hub_grams", "v", "grams")
            packed = self.stage(sides.mapInArrow(lambda b: _difference_batches(b, limit, order, buckets), P.SCHEMA), f"differences-{n}")
            self.add_links(packed.where("bucket = -1").mapInArrow(_link_batches, "u long, v long"))
            found = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: _scan_differences(t, limit, scan), FOUND)
            found = self.stage(found, f"found-{n}")
            self.drop(f"members-{n}", f"hubs-{n}", f"differences-{n}")
            ends = [self.stage(found.where("not wide").select("u", "v").distinct(), f"met-{n}")]
            for key, size, sketch in (("u", "n_u", "s_u"), ("v", "n_v", "s_v")):
                ends.append(self.with_sets(ends[-1], key, grams, n=size, sketch=sketch))
            pairs = self.stage(self.near(ends[-1]), f"pairs-{n}")
            self.add_links(self.verify(pairs, grams))
            wide = self.stage(found.where("wide").select("key", "v", "n", "rare").distinct(), f"wide-{n + 1}")
            self.drop(f"found-{n}", f"met-{n}", f"pairs-{n}")


def _link_batches(batches):
    for batch in batches:
        u, v = P.split(batch.column("packed"), "<i8", "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def group_ngrams(
    docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100, folder: str | None = None, scan: int = SCAN_AT_MOST,
    scan_different: int = SCAN_AT_MOST_DIFFERENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links, itself included.

    A document's set holds its distinct ``words``-word shingles, A-Z lowered; a shorter document has its whole
    word sequence as one, one without words (null and empty texts too) none, and links with nothing. Documents
    link when ``whole`` * common >= ``part`` * union. Equal sets are one vertex and are not
    expanded into pairs; no link between different sets is lost. Repeated rows give repeated rows. Rows
    with a null doc_id take no part and are left out. Other columns are not read; an empty table gives
    no rows. Shingles are told apart by 56 bits of hash, sets by 64. Lists longer than ``scan``, and lists of differences longer
    than ``scan_different``, get a hub; both decide only how links are found.
    """
    limit = Threshold(part, whole)
    join = Join(docs, words, limit, folder or work_dir(docs.sparkSession, "ngram-join"), scan, scan_different)
    with tidy_shuffles(join.spark):
        rows, named = _grouped(join)
    some = rows.where("n > 0").select("doc_id", "vertex", "n").join(named, "vertex").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def _grouped(join: Join) -> tuple[DataFrame, DataFrame]:
    """The sets of all documents, and the smallest document of each vertex's group."""
    limit, rows = join.limit, join.sets()
    vertices = join.stage(
        rows.where("n > 0").groupBy("vertex", "n").agg(F.min("doc_id").alias("least_doc"), F.min("sketch").alias("sketch"), F.min("small").alias("small")), "vertices"
    )
    sizes = {r["n"]: r["count"] for r in vertices.where(f"n <= {limit.most(SMALL) + 1}").groupBy("n").count().collect()}
    largest = boundary(sizes, limit)
    join.add_links(light_links(vertices, limit, largest))
    join.heavy(vertices, join.order(), limit.least(largest + 1))
    links = join.spark.read.schema("u long, v long").parquet(*[f"{join.folder}/links/{i}" for i in range(join.links)])
    # A component's name is its smallest document.
    of = components(links, f"{join.folder}/components")
    least = of.join(vertices.select(F.col("vertex").alias("u"), "least_doc"), "u").groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = of.join(least, "component").select(F.col("u").alias("vertex"), "component_id")
    named = join.stage(vertices.join(named, "vertex", "left").select("vertex", F.coalesce("component_id", "least_doc").alias("component_id")), "named")
    join.drop("vertices", "links", "components")
    return rows, named
