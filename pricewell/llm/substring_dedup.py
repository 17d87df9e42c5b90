"""Removal of long repeated passages by a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of k words, a node the k-1 words it shares with the next.
Consecutive edges with the same smallest inner gram form one path piece, keyed by that gram (a
minimizer). Two documents that share an edge share its key, so pieces meet by one shuffle on the
key instead of one row for each word. If all holders of a key have the same piece, the path does
not branch and its smallest document settles it as a whole; a piece that branches is settled edge by
edge. Records carry their source coordinates (document, first word), and a join on the
document turns the repeated ones back into word ranges of the texts. All windows around one phrase have the same key, so an
edge is identified by 112 bits: 48 of its key and a 64-bit hash of all its words.

Keys that many documents hold are found first, over all documents; their edges are dealt
one by one. A task that sees an edge in several documents sends it once, and reports the larger
documents at once. So neither a common passage nor a group of copies gathers in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm import packed as P
from pricewell.llm import textops as T
from pricewell.llm.names import free_name

WORDS = 13
GRAM = 5
HOT_IN_PIECE = 8
HOT_KEYS = 1 << 16
EDGES_AT_ONCE = 600_000

# Key, document and first word, each from its low part up, as high parts compress; edges (negative: known to be repeated); marks of the edges.
KINDS = ("<u4", "<u2", "<u2", "<u2", "<i4", "<u2", "<i2", "<i2", "<u8")


class Edges:
    """Edges of a piece: row of the document, first word within it, key and 64-bit mark."""

    def __init__(self, piece: T.Piece, words: int):
        found = T.words(piece)
        hashes = T.word_hashes(piece, found)
        at = T.windows(found, words)
        gram = min(GRAM, words)
        inner = np.arange(max(0, len(hashes) - gram + 1))
        least, reach, span = T.gram_hashes(hashes, inner, inner + gram), 1, words - gram + 1
        while reach < span and len(least):  # running minimum over ``span`` grams by doubling
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        self.row = found.docs()[at]
        self.first = at - found.bounds[self.row]
        self.key = least[at] if len(at) else np.zeros(0, T.U)
        self.mark = T.gram_hashes(hashes, at, at + words, which=1) if len(at) else np.zeros(0, T.U)


def _hot_batches(batches, words: int):
    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            edges = Edges(piece, words)
            order = np.lexsort((edges.row, edges.key))
            key, row = edges.key[order], edges.row[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
            names, counts = np.unique(key[new], return_counts=True)
            hot = counts >= HOT_IN_PIECE
            yield pa.RecordBatch.from_arrays([pa.array(names[hot].view(np.int64)), pa.array(counts[hot], pa.int64())], names=["key", "n"])


def hot_keys(docs: DataFrame, words: int) -> np.ndarray:
    """The keys that most documents hold, at most HOT_KEYS of them, counted where a few hundred documents hold them often.

    They decide only how edges are dealt, not which edges match.
    """
    counts = docs.select("text").mapInArrow(lambda b: _hot_batches(b, words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toArrow().column("key").to_numpy()
    return np.sort(top.view(T.U) if len(top) else np.zeros(0, T.U))


def _packed(key, doc, first, n, marks) -> bytes:
    key, doc, first = key.astype(T.U) >> T.U(16), doc.astype(np.int64), first.astype(np.int64)
    parts = (key & T.U(0xFFFFFFFF), key >> T.U(32), doc & 0xFFFF, (doc >> 16) & 0xFFFF, doc >> 32, first & 0xFFFF, first >> 16, n, marks)
    return P.join(*(c.astype(k) for c, k in zip(parts, KINDS)))


def _unpacked(packed) -> tuple[np.ndarray, ...]:
    key, key_high, doc, doc_mid, doc_high, first, first_high, count, mark = P.split(packed, *KINDS)
    doc = doc.astype(np.int64) | (doc_mid.astype(np.int64) << 16) | (doc_high.astype(np.int64) << 32)
    return key.astype(T.U) | (key_high.astype(T.U) << T.U(32)), doc, first.astype(np.int64) | (first_high.astype(np.int64) << 16), count.astype(np.int64), mark


def _pack_edges(row, doc, first, key, mark, hot: np.ndarray, buckets: int):
    """Packed path pieces of the edges that no smaller document of this lot holds, and ranges of those that one does."""
    edge = T.mix(key ^ ((mark << T.U(31)) | (mark >> T.U(33))))
    order = np.argsort(edge, kind="stable")
    # Edges with one name but other marks are not the same; they only part a run.
    start = np.flatnonzero(np.concatenate([[True], (edge[order][1:] != edge[order][:-1]) | (mark[order][1:] != mark[order][:-1])]))
    length = np.diff(np.append(start, len(order)))
    least = np.empty(len(edge), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], start), length)
    send = doc == least
    single = P.contains(hot, key)
    key = np.where(single, edge, key)
    # A path piece ends where the document, the key or the run of sent edges does.
    same = (row[1:] == row[:-1]) & (key[1:] == key[:-1]) & (first[1:] == first[:-1] + 1) & (send[1:] == send[:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~same | single[1:] & send[1:]]))
    lengths = np.diff(np.append(begins, len(row)))
    sent = send[begins]
    at, n = begins[sent], lengths[sent]
    parts = []
    for bucket, of in P.by_bucket(key[at], buckets):
        parts.append((bucket, _packed(key[at[of]], doc[at[of]], first[at[of]], n[of], mark[P.expand(at[of], n[of])])))
    at, n = begins[~sent], lengths[~sent]
    none = np.zeros(0, "<u8")
    for bucket, of in P.by_bucket(doc[at], buckets):
        parts.append((bucket, _packed(np.zeros(len(of)), doc[at[of]], first[at[of]], -n[of], none)))
    return P.rows(parts)


def _edge_batches(batches, words: int, hot: np.ndarray, buckets: int):
    held, size, rows = [], 0, 0
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for piece in T.pieces(batch.column("text")):
            edges = Edges(piece, words)
            held.append((edges.row + rows, ids[piece.first + edges.row].astype(np.int64), edges.first, edges.key, edges.mark))
            size, rows = size + len(edges.row), rows + len(piece)
            if size >= EDGES_AT_ONCE:
                yield _pack_edges(*map(np.concatenate, zip(*held)), hot, buckets)
                held, size = [], 0
    if size:
        yield _pack_edges(*map(np.concatenate, zip(*held)), hot, buckets)


def _settle(table: pa.Table, buckets: int) -> pa.Table:
    """Ranges of edges that a smaller document holds too, packed by bucket of the document."""
    key, doc, first, count, mark = _unpacked(table.column("packed"))
    known = count < 0
    ranges = [(doc[known], first[known], -count[known])]
    key, doc, first, count = key[~known], doc[~known], first[~known], count[~known]
    at = np.cumsum(count) - count
    order = np.argsort(key, kind="stable")
    start, length = P.groups(key[order])
    many = order[P.expand(start[length > 1], length[length > 1])]
    if len(many):
        start, length = P.groups(key[many])
        path = T.gram_hashes(mark, at[many], at[many] + count[many])
        branches = np.minimum.reduceat(path, start) != np.maximum.reduceat(path, start)
        least = np.repeat(np.minimum.reduceat(doc[many], start), length)
        whole = many[~np.repeat(branches, length) & (doc[many] > least)]
        ranges.append((doc[whole], first[whole], count[whole]))
        open_ = many[np.repeat(branches, length)]
        n = count[open_]
        flat = P.expand(at[open_], n)
        e_key, e_doc, e_mark = np.repeat(key[open_], n), np.repeat(doc[open_], n), mark[flat]
        e_first = P.expand(first[open_].astype(np.int64), n)
        order = np.lexsort((e_mark, e_key))
        e_key, e_doc, e_mark, e_first = e_key[order], e_doc[order], e_mark[order], e_first[order]
        if len(order):
            start = np.flatnonzero(np.concatenate([[True], (e_key[1:] != e_key[:-1]) | (e_mark[1:] != e_mark[:-1])]))
            least = np.repeat(np.minimum.reduceat(e_doc, start), np.diff(np.append(start, len(order))))
            gone = e_doc > least
            ranges.append((e_doc[gone], e_first[gone], np.ones(int(gone.sum()), np.int64)))
    doc, first, count = (np.concatenate([r[i] for r in ranges]).astype(np.int64) for i in range(3))
    parts = [(b, P.join(doc[i], first[i], count[i])) for b, i in P.by_bucket(doc, buckets)]
    return pa.Table.from_batches([P.rows(parts)])


def _gather(table: pa.Table) -> pa.Table:
    """All ranges of each document of a bucket."""
    doc, first, count = P.split(table.column("packed"), "<i8", "<i8", "<i8")
    order = np.argsort(doc, kind="stable")
    doc, both = doc[order], np.stack([first[order], count[order]], axis=1).astype("<i4")
    start, length = P.groups(doc)
    blobs = [both[s:s + n].tobytes() for s, n in zip(start.tolist(), length.tolist())]
    return pa.table({"of_doc": pa.array(doc[start], pa.int64()), "ranges": pa.array(blobs, pa.binary())})


def _remove_batches(batches, words: int, ranges_col: str):
    for batch in batches:
        texts, totals, removed = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column(ranges_col).to_pylist()):
            found = (text.as_py() or "").encode().split()  # bytes split at the same breaks
            gone = 0
            totals.append(len(found))
            if ranges:
                span = np.frombuffer(ranges, "<i4").reshape(-1, 2)
                span = span[span[:, 0] + span[:, 1] + words - 1 <= len(found)]
                edge = np.zeros(len(found) + 1, np.int64)
                np.add.at(edge, span[:, 0], 1)
                np.add.at(edge, span[:, 0] + span[:, 1] + words - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone = len(found) - int(keep.sum())
                found = [found[i] for i in np.flatnonzero(keep).tolist()]
            texts.append(b" ".join(found).decode())
            removed.append(gone)
        names = [n for n in batch.schema.names if n != ranges_col]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
            names=[*names, "kept_text", "n_words", "n_removed"],
        )


def dedup_substrings(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Remove every word that a window of ``words`` words covers which also starts in a document of smaller doc_id.

    Needs doc_id and text; adds kept_text (kept words joined by one space), n_words and n_removed
    in place of columns of those names, and keeps all others. Windows are judged on the input. Null
    and empty texts have no words; texts under ``words`` words keep all. Rows of one doc_id
    count as one document that never removes from itself, and share their ranges, so ids should be unique. A null
    doc_id takes no part and keeps its words. An empty table gives no rows.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed")
    of_doc, ranges_col = free_name(docs.columns, "of_doc"), free_name(docs.columns, "ranges")
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = P.bucket_count(known)
    hot = hot_keys(known, words)
    edges = known.mapInArrow(lambda b: _edge_batches(b, words, hot, buckets), P.SCHEMA)
    settled = edges.groupBy("bucket").applyInArrow(lambda t: _settle(t, buckets), P.SCHEMA)
    ranges = settled.groupBy("bucket").applyInArrow(_gather, "of_doc long, ranges binary")
    ranges = ranges.toDF(of_doc, ranges_col)
    marked = docs.join(ranges, F.col("doc_id") == F.col(of_doc), "left").drop(of_doc)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.mapInArrow(lambda b: _remove_batches(b, words, ranges_col), f"{schema}, kept_text string, n_words long, n_removed long")
