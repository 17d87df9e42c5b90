"""Sampled segmentations into vocabulary pieces, reproducible by row key, and lossless decoding.

A text's bytes form a lattice: every vocabulary piece that matches at a place is an edge, and so is
every single byte, at a much lower weight, so that any text has a path. Forward filtering
sums the weights of all paths to each place; backward sampling walks from the end and draws each edge
by its share. No piece crosses into a space from another character, nor a line break, so the lattice falls apart into
segments, and equal segments of a batch share one filter. The random number at a place is a hash
of the row key and the place, so a text's sample depends on nothing else.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm import packed as P
from pricewell.llm import textops as T

SPACE = "▁"
BYTE_WEIGHT = -60.0
SHARPNESS = 1.0
SEED = 8
PIECE = {"docs": 2048, "size": 3 << 19}


class Vocabulary:
    """Pieces of a sentencepiece model as bytes, the space mark as a space, by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        byte_ids, by_length = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
                byte_ids[raw[0]] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw = b""
            else:
                raw = piece.replace(SPACE, " ").encode()
                # Weights follow Zipf's law over the rank at which the piece was merged.
                by_length.setdefault(len(raw), []).append((raw, i, -SHARPNESS * np.log(2.0 + min(-model.get_score(i), 1e6))))
            self.bytes.append(raw)
        if len(byte_ids) != 256:
            raise ValueError("the model needs a piece for every byte")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)])
        # Per length every prefix of a piece; the id is -1 where the prefix is not a piece itself.
        self.prefixes = []
        pieces_of = {raw: (i, weight) for found in by_length.values() for raw, i, weight in found}
        for length in range(1, max(by_length) + 1):
            found = sorted({raw[:length] for raw in pieces_of if len(raw) >= length})
            data = np.frombuffer(b"".join(found), np.uint8)
            starts = np.arange(len(found)) * length
            hashes = T.BYTES_OF[0].slices(T.BYTE_VALUES[0][data], starts, starts + length)
            order = np.argsort(hashes)
            known = [pieces_of.get(raw, (-1, 0.0)) for raw in found]
            self.prefixes.append((hashes[order], np.array([k[0] for k in known])[order], np.array([k[1] for k in known])[order]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """Lattices of many segments side by side, with the forward filter done. Node i + segment is place i of the joined bytes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, vocab: Vocabulary):
        starts, lengths = bounds[:-1], np.diff(bounds)
        segment = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(data))
        room = bounds[1:][segment] - at
        begins, ends, ids, weights = [at], [at + 1], [vocab.byte_ids[data]], [np.full(len(data), BYTE_WEIGHT)]
        values = T.BYTE_VALUES[0][data]
        longest = int(room.max(initial=0))
        sums = T.BYTES_OF[0]
        alive = at  # places where a piece may still begin: what follows is the start of one
        for length, (hashes, piece_ids, piece_weights) in enumerate(vocab.prefixes[:longest], 1):
            alive = alive[room[alive] >= length]
            own = sums.slices(values, alive, alive + length)
            where = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[where] == own
            alive, where = alive[hit], where[hit]
            if not len(alive):
                break
            whole = piece_ids[where] >= 0
            begins.append(alive[whole])
            ends.append(alive[whole] + length)
            ids.append(piece_ids[where[whole]])
            weights.append(piece_weights[where[whole]])
        # Longer pieces first, bytes last: the order in which a draw tries a node's edges.
        begin, end, self.id, weight = (np.concatenate(c[::-1]) for c in (begins, ends, ids, weights))
        of = segment[begin]
        depth = end - starts[of]
        self.begin, self.end = begin + of, end + of
        order = np.argsort(self.end, kind="stable")
        self.begin, self.end, self.id, weight, depth = self.begin[order], self.end[order], self.id[order], weight[order], depth[order]
        forward = np.full(len(data) + len(starts), -np.inf)
        self.first = starts + np.arange(len(starts))
        self.last = bounds[1:] + np.arange(len(starts))
        forward[self.first] = 0.0
        # Places at the same distance from their segment's start are filled together.
        by_depth = np.argsort(depth.astype(np.uint16) if longest < 1 << 16 else depth, kind="stable")
        step_first, step_length = P.groups(depth[by_depth])
        share = np.empty(len(order))
        for s, n in zip(step_first.tolist(), step_length.tolist()):
            e = by_depth[s:s + n]  # still ordered by end
            node_first, node_length = P.groups(self.end[e])
            path = forward[self.begin[e]] + weight[e]
            top = np.maximum.reduceat(path, node_first)
            part = np.exp(path - np.repeat(top, node_length))
            total = np.add.reduceat(part, node_first)
            forward[self.end[e[node_first]]] = top + np.log(total)
            share[e] = part / np.repeat(total, node_length)
        # Cumulative share of a node's incoming edges, summed node by node so that equal segments agree bit by bit.
        node_first, node_length = P.groups(self.end)
        self.cut = share
        more, nth = node_length > 1, 1
        while more.any():
            at = node_first[more] + nth
            self.cut[at] += self.cut[at - 1]
            nth += 1
            more = node_length > nth
        self.cut[node_first + node_length - 1] = 2.0
        self.into = np.zeros(len(forward), np.int64)
        self.into[self.end[node_first]] = node_first

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An incoming edge of each node, u uniform in [0, 1)."""
        edge = self.into[node]
        open_ = np.flatnonzero(self.cut[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.cut[edge[open_]] <= u[open_]]
        return edge


def _segment_starts(piece: T.Piece) -> np.ndarray:
    data = piece.data
    starts = np.zeros(len(data), bool)
    space, line = data == 0x20, data == 0x0A
    starts[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    starts[piece.offsets[:-1][np.diff(piece.offsets) > 0]] = True
    return np.flatnonzero(starts)


def sample(piece: T.Piece, keys: np.ndarray, vocab: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all documents of a piece end to end, and how many each has."""
    n = len(piece.data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(piece), np.int64)
    starts = _segment_starts(piece)
    ends = np.append(starts[1:], n)
    values = T.BYTES_OF[1].slices(T.BYTE_VALUES[1][piece.data], starts, ends)
    _, where, back = np.unique(values, return_index=True, return_inverse=True)
    lengths = (ends - starts)[where]
    lattice = Lattice(piece.data[P.expand(starts[where], lengths)], np.concatenate([[0], np.cumsum(lengths)]), vocab)
    doc = np.searchsorted(piece.offsets, starts, side="right") - 1
    row_key = T.mix(T.mix(keys.astype(np.int64).view(T.U) + T.U(seed)))[doc]
    shift = starts - piece.offsets[doc]
    node, stop, offset = lattice.last[back], lattice.first[back], starts - lattice.first[back]
    shift = shift - lattice.first[back]
    out = np.full(n, -1, np.int32)
    while len(node):
        place = (node + shift).astype(T.U)
        u = (T.mix(row_key + place * T.U(0x9E3779B97F4A7C15)) >> T.U(11)).astype(np.float64) * 2.0**-53
        edge = lattice.draw(node, u)
        out[node + offset - 1] = lattice.id[edge]
        node = lattice.begin[edge]
        live = node > stop
        node, stop, offset, shift, row_key = node[live], stop[live], offset[live], shift[live], row_key[live]
    used = out >= 0
    return out[used], T.doc_sums(used.astype(np.int64), piece.offsets)


def _encode_batches(batches, at: int, key_at: int, path: str, seed: int):
    vocab = vocabulary(path)
    for batch in batches:
        keys = np.asarray(batch.column(key_at).fill_null(0), dtype=np.int64)
        for piece in T.pieces(batch.column(at), **PIECE):
            ids, counts = sample(piece, keys[piece.first:piece.first + len(piece)], vocab, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c.slice(piece.first, len(piece)) for c in batch.columns), lists], names=[*batch.schema.names, "piece_ids"])


def encode(docs: DataFrame, model_path: str, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``piece_ids`` (array of int) in place of a column of that name: a sampled segmentation of text.

    The sample follows doc_id (null as 0) and the text alone, so reruns and copies under one id agree. Null and empty texts have
    no ids. An empty table gives no rows.
    """
    docs = docs.drop("piece_ids").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at, key_at = docs.columns.index("text"), docs.columns.index("doc_id")
    return docs.mapInArrow(lambda b: _encode_batches(b, at, key_at, model_path, seed), f"{schema}, piece_ids array<int>")


def _decode_batches(batches, at: int, path: str):
    vocab = vocabulary(path)
    for batch in batches:
        texts = []
        for i in range(batch.num_rows):
            ids = batch.column(at)[i].values
            texts.append(vocab.decode(np.asarray(ids).tolist()).decode() if ids is not None else "")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``rows`` with ``decoded``, the exact text that piece_ids came from (null: empty)."""
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index("piece_ids")
    return rows.mapInArrow(lambda b: _decode_batches(b, at, model_path), f"{schema}, decoded string")


def _round_trip_batches(batches, path: str, seed: int):
    vocab = vocabulary(path)
    for batch in batches:
        keys = np.asarray(batch.column("doc_id").fill_null(0), dtype=np.int64)
        for piece in T.pieces(batch.column("text"), **PIECE):
            ids, counts = sample(piece, keys[piece.first:piece.first + len(piece)], vocab, seed)
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])]
            same = [vocab.decode(ids[s:e].tolist()) == piece.text(i) for i, (s, e) in enumerate(zip(at[:-1], at[1:]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(piece.first, len(piece)), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "ids_crc32", "lossless"],
            )


def round_trip(docs: DataFrame, model_path: str, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids that ``encode`` gives, as little-endian 32-bit integers) and whether decoding them gives the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _round_trip_batches(b, model_path, seed), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
