"""Exact top-k search by inner product: term-at-a-time accumulation over inverted lists.

Queries and candidates are dealt into blocks; every pair of blocks is one group of bounded
size. Inside it each dimension (term) of the candidates is a posting list, a query scatters
its weight times the postings into a dense score array, and a partition of that array gives
the block's best rows. A window over the few rows that each block returns merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
SCORED_AT_ONCE = 64


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def _postings(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of every non-zero component."""
    counts = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), dtype=np.int64)
    rows = np.repeat(np.arange(len(counts)), counts)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    live = values != 0
    return rows[live], dims[live], values[live]


def _by_dim(rows, dims, values):
    order = np.argsort(dims, kind="stable")
    rows, dims, values = rows[order], dims[order], values[order]
    names, starts = np.unique(dims, return_index=True)
    ends = np.append(starts[1:], len(dims))
    return {int(d): (rows[s:e], values[s:e]) for d, s, e in zip(names, starts, ends)}


def _best(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """Rows (query id, candidate id, score) of the k best of each column, ties to the smaller id."""
    own = ids[:, None] == query_ids[None, :]
    m = k + int(own.sum(0).max(initial=0))
    if m < len(ids):
        least = np.partition(scores, len(ids) - m, axis=0)[len(ids) - m]
        at, query = np.nonzero((scores >= least) & ~own)
    else:
        at, query = np.nonzero(~own)
    value = scores[at, query]
    order = np.lexsort((ids[at], ~value, query))
    at, query, value = at[order], query[order], value[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    keep = nth < k
    return query_ids[query[keep]], ids[at[keep]], value[keep]


def _score_block(table: pa.Table, k: int) -> pa.Table:
    asked = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    every, weights = table.column("id").to_numpy(), table.column("weights").combine_chunks()
    if isinstance(weights, pa.ChunkedArray):
        weights = weights.chunk(0)
    q_at, c_at = np.flatnonzero(asked), np.flatnonzero(~asked)
    parts = []
    if len(q_at) and len(c_at):
        ids = every[c_at]
        lists = _by_dim(*_postings(weights.take(pa.array(c_at))))
        for at in range(0, len(q_at), SCORED_AT_ONCE):
            part = q_at[at:at + SCORED_AT_ONCE]
            terms = _by_dim(*_postings(weights.take(pa.array(part))))
            scores = np.zeros((len(ids), len(part)), np.int64)
            for d, (queries, weight) in terms.items():
                if d not in lists:
                    continue
                rows, posted = lists[d]
                if len(queries) == len(part):
                    scores[rows] += posted[:, None] * weight[None, :]
                else:
                    scores[np.ix_(rows, queries)] += posted[:, None] * weight[None, :]
            parts.append(_best(scores, every[part], ids, k))
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest integer inner product for every row that ``is_query`` marks.

    Returns query_id, rank (from 1), vec_id, score; equal scores go to the smaller id, and a
    query with fewer candidates gets them all. Rows with a null id, or a vector that is null or holds
    a null or non-finite component, take no part. Candidates are all rows with another id
    than the query's. Vectors of unequal length count as padded with zeros; an empty vector
    scores 0. Repeated candidate rows each take a place; repeated query rows count once.
    Scores are 64-bit integers. Other columns are not read; an empty table gives no rows.
    """
    clean = (
        vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col)).alias("weights"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        .where(F.col("id").isNotNull() & F.col("weights").isNotNull())
    )
    size = clean.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    q_blocks, c_blocks = max(1, -(-size["q"] // QUERY_BLOCK)), max(1, -(-size["n"] // CANDIDATE_BLOCK))

    def block(blocks: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    asked = clean.where("is_query").dropDuplicates(["id", "weights"]).withColumn("q_block", block(q_blocks, 1)).withColumn("c_block", every(c_blocks))
    listed = clean.withColumn("is_query", F.lit(False)).withColumn("c_block", block(c_blocks, 2)).withColumn("q_block", every(q_blocks))
    best = asked.unionByName(listed).groupBy("q_block", "c_block").applyInArrow(
        lambda table: _score_block(table, k), "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
