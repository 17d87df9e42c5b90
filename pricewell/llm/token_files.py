"""Token ids as Parquet list columns, for selective reads of ids or of metadata.

Texts are dealt by ranges of the document id, encoded, and written in id order: one row per
document with its shard, its place in the shard, its length and its ids. Ids repeat,
so the list column is dictionary-encoded; the ordered number columns are delta-encoded by the
version-2 writer. Row groups and pages are small enough that page indexes let a reader
fetch a few documents, or only lengths, without the ids. Spark's own committer writes the
files, so a lost executor costs a rerun of its tasks.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.llm import textops as T

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 2000
KNOWN_AT_MOST = 600_000
WORDS_AT_ONCE = 4096
WORD_END = "</w>"
SHARD_BYTES = 16 << 20
MIN_SHARDS = 12

WRITER = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.writer.version": "v2",
}

# A text may be cut between a letter or digit and one of these marks, either way round, or at
# white space: the tokenizer's own pattern cuts there too. Marks that belong to a contraction
# or to a special token are not in the list.
SAFE_MARKS = b".,;:!?*#$%&()[]{}\"/+-=_@~"


def _segments(piece: T.Piece) -> T.Words:
    """Words of a piece, cut again between ASCII or Latin-1 letters, digits and safe marks."""
    found, data = T.words(piece), piece.data
    mark = np.zeros(256, bool)
    mark[list(SAFE_MARKS)] = True
    is_mark = mark[data]
    lower = T.LOWER[data]
    alnum = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57))
    lead = np.zeros(len(data), bool)
    if len(data) > 1:
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[1:-1] = ((alnum | tail)[:-1] & is_mark[1:]) | (is_mark[:-1] & (alnum | lead)[1:])
    cut[found.starts] = True
    # A cut inside a word ends one segment and begins the next; a word's end only ends one.
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    word = np.searchsorted(found.starts, starts, side="right") - 1
    ends = np.minimum(ends, found.ends[word]) if len(starts) else ends[:0]
    return T.Words(starts, ends, np.searchsorted(starts, piece.offsets))


def _folded(data: np.ndarray, seg: T.Words) -> np.ndarray:
    """The bytes, ASCII letters lowered in segments that are ASCII throughout. The tokenizer composes
    marks with their letter before it lowers, so other segments keep their case."""
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data >= 128, out=wide[1:])
    kept = wide[seg.ends] > wide[seg.starts]
    step = np.zeros(len(data) + 1, np.int8)
    step[seg.starts[kept]] += 1
    step[seg.ends[kept]] -= 1
    return np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, data, T.LOWER[data])


def _is_word(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a segment is ASCII and Latin-1 letters throughout, which the tokenizer takes as one word."""
    other = ~IS_LETTER[T.LOWER[data]]
    if len(data) > 1:
        pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        other[pair] = other[pair + 1] = False
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(other, out=sums[1:])
    return sums[ends] == sums[starts]


IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = True


class Encoder:
    """Ids of whole texts; segments seen before are looked up instead of encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # Marks the last id of a word, if the vocabulary tells word ends apart.
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for entry, i in vocabulary.items() if entry.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, T.U)
        self.check = np.zeros(0, T.U)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has: many words as one text, cut behind the ids that end a word."""
        flat, counts = [], []
        for at in range(0, len(texts), WORDS_AT_ONCE):
            part = texts[at:at + WORDS_AT_ONCE]
            ids = np.array(self._encode([" ".join(part)])[0], np.int32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == len(part) and len(ids) and ends[-1] == len(ids) - 1:
                count = np.diff(ends, prepend=-1)
            else:  # no such marks in this vocabulary
                ids, count = _flat(self._encode(part))
            flat.append(ids)
            counts.append(count)
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _learn(self, hashes, checks, texts: list[str], is_word: np.ndarray) -> None:
        words, others = ([texts[i] for i in np.flatnonzero(which).tolist()] for which in (is_word, ~is_word))
        parts = [self._words(words), _flat(self._encode(others))]
        order = np.concatenate([np.flatnonzero(is_word), np.flatnonzero(~is_word)])
        hashes, checks = hashes[order], checks[order]
        flat, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, flat])
        order = np.argsort(hashes)
        hashes, checks, first, count = hashes[order], checks[order], first[order], count[order]
        at = np.searchsorted(self.known, hashes)
        self.known, self.check = np.insert(self.known, at, hashes), np.insert(self.check, at, checks)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)

    def piece(self, piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a piece end to end, and how many each has."""
        raw = piece.data.tobytes()
        if b"<|" in raw:  # a special token may be spelt out; leave the texts whole
            found = self._encode([piece.text(i).decode() for i in range(len(piece))])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts
        seg = _segments(piece)
        lower = _folded(piece.data, seg)
        hashes = T.BYTES_OF[0].slices(T.BYTE_VALUES[0][lower], seg.starts, seg.ends)
        names, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        checks = T.BYTES_OF[1].slices(T.BYTE_VALUES[1][lower], seg.starts[where], seg.ends[where])
        if len(self.known) > KNOWN_AT_MOST:
            self.clear()
        at = np.searchsorted(self.known, names)
        there = np.zeros(len(names), bool)
        there[at < len(self.known)] = self.known[at[at < len(self.known)]] == names[at < len(self.known)]
        new = np.flatnonzero(~there)
        if len(new):
            low = lower.tobytes()
            starts, ends = seg.starts[where[new]], seg.ends[where[new]]
            self._learn(names[new], checks[new], [low[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())], _is_word(lower, starts, ends))
            at = np.searchsorted(self.known, names)
        if not np.array_equal(self.check[at], checks):  # two segments with one hash: forget and start again
            self.clear()
            found = self._encode([piece.text(i).decode() for i in range(len(piece))])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts
        rows = at[back]
        count = self.count[rows]
        ends = np.cumsum(count)
        source = np.repeat(self.first[rows] - (ends - count), count) + np.arange(int(count.sum()))
        return self.ids[source], T.doc_sums(count, seg.bounds)


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.int32, int(count.sum())), count


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.int32), counts + 1


def _encode_batches(batches, path: str, end_id: int):
    model = encoder(path)
    written = 0
    for batch in batches:
        ids = batch.column("doc_id")
        for piece in T.pieces(batch.column("text"), docs=1024):
            tokens, counts = _with_end(*model.piece(piece), end_id)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(piece.first, len(piece)),
                    pa.array(written + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens, pa.int32())),
                ],
                names=["doc_id", "local_start", "n_tokens", "ids"],
            )
            written += int(counts.sum())


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id`` and write the ids under ``folder`` in id order.

    Columns: shard, doc_id, local_start (ids of the shard before this document), n_tokens, ids. The number of shards follows the bytes of the texts.
    Shards ascend with the document id, null first; repeated ids stay together, in text order.
    An empty table writes an empty folder with the same schema.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = (
        rows.repartitionByRange(max(MIN_SHARDS, -(-size // SHARD_BYTES)), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    encoded = ordered.mapInArrow(
        lambda batches: _encode_batches(batches, tokenizer_path, end_id), "doc_id long, local_start long, n_tokens long, ids array<int>"
    )
    encoded.select(F.spark_partition_id().alias("shard"), "*").write.options(**WRITER).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the files; select only the columns needed, the others are not read."""
    return spark.read.schema("shard int, doc_id long, local_start long, n_tokens long, ids array<int>").parquet(folder)


def with_start(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add ``start``, ids of all documents before: the shard's offset plus the place in the shard.

    The offsets come from one row per shard.
    """
    offset = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = lengths.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", offset.cast("long").alias("offset"))
    return rows.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("local_start")).drop("offset")


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of a list of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(column: pa.Array) -> pa.Array:
        flat = np.asarray(column.flatten(), dtype="<u4")
        at = np.asarray(column.offsets) - column.offsets[0].as_py()
        return pa.array([zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())

    return crc(ids)
