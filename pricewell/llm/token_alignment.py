"""Alignment of two tokenizers: byte groups that both cut at, and how often ids are linked across the corpus.

Tokens of both streams are intervals of the same bytes. Every token points to the token overlapping it that
reaches farthest right; doubling the pointers until nothing moves brings each token to the last one of its
component, which labels the group. Neither tokenizer merges across a word's leading space, nor from a letter to a mark, so texts are cut
there and equal segments of a worker's texts are encoded and aligned once.

Counts of id pairs are summed in the tasks before the shuffle. Pairs frequent enough to be among the first million are looked up
in a broadcast table of that size at most; the rest, none of which holds more than about a millionth of all links, are joined.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm import packed as P
from pricewell.llm import textops as T
from pricewell.session import work_dir

SPACE = "▁"
KNOWN_AT_MOST = 400_000
LINES_AT_ONCE = 4096
KNOWN_PAIRS_AT_MOST = 4 << 20
COUNTED_AT_ONCE = 2 << 20
# Pairs of the broadcast table at most (16 bytes each), and how finely their frequency is chosen.
TABLE_PAIRS = 1 << 20
STEPS = 8
PAIRS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
WRITER = {"parquet.block.size": str(16 << 20), "parquet.writer.version": "v2", "parquet.enable.dictionary#pairs.list.element": "false"}


def byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: visible Latin-1 characters are
    themselves, the other bytes in ascending order follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Table:
    """Byte strings by number, end to end."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[P.expand(self.first[ids], self.size[ids])]


class Tokenizers:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        mark = byte_of_mark()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(mark[c] for c in entry) if all(c in mark for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_table, self.b_table = Table(self.a_bytes), Table(self.b_bytes)
        self.number = Table([b"%d," % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        self.space = self.b.piece_to_id(SPACE)
        self.a_line, self.b_line = self.a_bytes.index(b"\n"), self.b_bytes.index(b"\n")
        texts = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        # A cut is safe where no piece goes on: before spaces and around line ends, and before marks that follow a letter.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in texts)
        going_on = {y for p in texts for x, y in zip(p, p[1:]) if x.isalpha()}
        self.mark = np.zeros(256, bool)
        self.mark[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in going_on]] = True

    def encode(self, texts: list[str], simple: np.ndarray) -> tuple[tuple, tuple]:
        """Ids of segments end to end and how many each has, by both tokenizers. Simple segments go as lines of one text, since
        neither tokenizer merges over a line end; the others alone."""
        parts = [self._lines([t for t, s in zip(texts, simple.tolist()) if s])]
        others = [t for t, s in zip(texts, simple.tolist()) if not s]
        if not others:
            return parts[0]
        parts.append((_flat(self._alone_a(others)), _flat(self._alone_b(others))))
        order = np.argsort(np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)]))
        both = []
        for side in (0, 1):
            ids, counts = (np.concatenate([p[side][i] for p in parts]) for i in (0, 1))
            first = np.cumsum(counts) - counts
            both.append((ids[P.expand(first[order], counts[order])], counts[order]))
        return both[0], both[1]

    def _lines(self, lines: list[str]) -> tuple[tuple, tuple]:
        a, b = [], []
        for at in range(0, len(lines), LINES_AT_ONCE):
            part = lines[at:at + LINES_AT_ONCE]
            text = "\n" + "\n".join(part)
            found = _split(self._alone_a([text])[0], self.a_line), _split(self.b.encode(text), self.b_line)
            if len(found[0][1]) != len(part) or len(found[1][1]) != len(part):  # a line end was merged after all
                found = _flat(self._alone_a(part)), _flat(self._alone_b(part))
            a.append(found[0])
            b.append(found[1])
        if not lines:
            return ((np.zeros(0, np.int64),) * 2,) * 2
        return tuple(tuple(np.concatenate([x[i] for x in side]) for i in (0, 1)) for side in (a, b))

    def _alone_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone_b(self, texts: list[str]) -> list[list[int]]:
        """A segment's own leading space is the one that the tokenizer adds; before other segments a line end takes it, and goes."""
        found = self.b.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        return [(ids or [self.space]) if t[0] == " " else ids[2:] for t, ids in zip(texts, found)]


def _split(ids: list[int], line: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids behind line ends, without these, and how many lie behind each."""
    ids = np.array(ids, np.int64)
    at = np.flatnonzero(ids == line)
    behind = ids[at[0]:] if len(at) else ids[:0]
    return behind[behind != line], np.diff(np.append(at, len(ids))) - 1


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(counts.sum())), counts


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """Kept by a worker for its next tasks."""
    return Aligner(tokenizers(a_path, b_path))


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group label of every token of two streams that tile the same bytes, given by where their tokens end.

    Labels ascend. A token of A points to the token of B over its last byte, one of B to the token of A over its last byte if that
    reaches farther, else to itself: the terminal token of its component.
    """
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends)
    over_b = np.searchsorted(a_ends, b_ends)
    own = np.arange(len(b_ends))
    successor = np.concatenate([n + over_a, np.where(a_ends[over_b] > b_ends, over_b, n + own)])
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor[:n], successor[n:]
        successor = farther


def _distinct(labels: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, id and how often, of every id that a label has."""
    key, times = np.unique(labels * size + ids, return_counts=True)
    return key // size, key % size, times


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, times) in order, each pair of an owner once."""
    key = owner * pairs + pair
    order = np.argsort(key)
    key, times = key[order], times[order]
    first, _ = P.groups(key)
    return key[first] // pairs, key[first] % pairs, np.add.reduceat(times, first) if len(first) else times


def _same(table: Table, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the entries of each segment's ids are its bytes."""
    segment = np.repeat(np.arange(len(counts)), counts)
    sized = np.bincount(segment, table.size[ids], len(counts)).astype(np.int64) == lengths
    own = np.repeat(sized, lengths)
    differ = table.joined(ids[sized[segment]]) != data[own]
    sized[np.repeat(np.arange(len(lengths)), lengths)[own][differ]] = False
    return sized


def _simple(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Segments without white space but for one leading space before a character that is none; they can stand as lines of one text."""
    ends = np.cumsum(lengths)
    odd = (data < 0x21) | (data == 0x7F) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
    odd[(ends - lengths)[(data[ends - lengths] == 0x20) & (lengths > 1)]] = False
    return T.doc_sums(odd.astype(np.int64), np.append(ends - lengths, len(data))) == 0


class Aligner:
    """Alignments of segments, kept for the next texts of the task."""

    def __init__(self, models: Tokenizers):
        self.models, self.width = models, len(models.b_bytes)
        self.pairs = len(models.a_bytes) * self.width
        self.clear()

    def clear(self) -> None:
        self.known, self.check, self.index = np.zeros(0, T.U), np.zeros(0, T.U), np.zeros(0, np.int64)
        # n_a, n_b, n_groups, n_links, whether the bytes come back, first pair, number of pairs
        self.facts = np.zeros((0, 7), np.int64)
        self.text: list[bytes] = []
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, raw: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Facts, group text (each group ended by a semicolon) and pairs of segments."""
        models, n = self.models, len(raw)
        data, lengths = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, n)
        (a_ids, n_a), (b_ids, n_b) = models.encode([r.decode() for r in raw], _simple(data, lengths))
        whole = _same(models.a_table, a_ids, n_a, data, lengths) & _same(models.b_table, b_ids, n_b, data, lengths)
        if not whole.all():
            a_ids, b_ids = a_ids[np.repeat(whole, n_a)], b_ids[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        a_label, b_label = jump(np.cumsum(models.a_table.size[a_ids]), np.cumsum(models.b_table.size[b_ids]))
        segment = np.repeat(np.arange(n), n_a)
        a_first, a_count = P.groups(a_label)
        b_first, b_count = P.groups(b_label)
        of = segment[a_first]
        n_groups = np.bincount(of, minlength=n)
        n_links = np.bincount(of, a_count * b_count, n).astype(np.int64)
        # Tokens in the order of the text: a group's of A, then its of B, each with what follows it.
        before = np.cumsum(b_count) - b_count
        place = np.empty(len(a_ids) + len(b_ids), np.int64)
        group_a, group_b = np.repeat(np.arange(len(a_first)), a_count), np.repeat(np.arange(len(b_first)), b_count)
        at_a, at_b = np.arange(len(a_ids)) + before[group_a], np.arange(len(b_ids)) + (a_first + a_count)[group_b]
        place[at_a], place[at_b] = a_ids, b_ids
        sizes = models.number.size[place]
        written, ends = models.number.joined(place), np.cumsum(sizes)
        written[ends[at_a[a_first + a_count - 1]] - 1] = ord("|")
        written[ends[at_b[b_first + b_count - 1]] - 1] = ord(";")
        written, stops = written.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        text = [written[s:e] for s, e in zip(stops[:-1], stops[1:])]
        label_a, id_a, times_a = _distinct(group_a, a_ids, len(models.a_bytes))
        label_b, id_b, times_b = _distinct(group_b, b_ids, self.width)
        low, high = np.searchsorted(label_b, label_a, side="left"), np.searchsorted(label_b, label_a, side="right")
        left, right = np.repeat(np.arange(len(label_a)), high - low), P.expand(low, high - low)
        owner, pair, times = _summed(of[label_a[left]], id_a[left] * self.width + id_b[right], times_a[left] * times_b[right], self.pairs)
        n_pairs = np.bincount(owner, minlength=n)
        facts = np.stack([n_a, n_b, n_groups, n_links, whole, np.cumsum(n_pairs) - n_pairs, n_pairs], axis=1).astype(np.int64)
        return facts, text, pair, times

    def learn(self, hashes: np.ndarray, checks: np.ndarray, raw: list[bytes]) -> None:
        facts, text, pair, times = self.align(raw)
        facts[:, 5] += len(self.pair)
        at = np.searchsorted(self.known, hashes)
        self.known, self.check = np.insert(self.known, at, hashes), np.insert(self.check, at, checks)
        self.index = np.insert(self.index, at, len(self.text) + np.arange(len(raw)))
        self.facts, self.text = np.concatenate([self.facts, facts]), self.text + text
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])

    def segments(self, piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
        """Where segments start and end: at texts; before a space or line end behind a character that is surely not white space; behind
        such a line end; and before a mark that follows a letter."""
        data = piece.data
        starts = np.zeros(len(data) + 2, bool)
        starts[piece.offsets[:-1][np.diff(piece.offsets) > 0]] = True
        if self.models.cuts:
            blank = np.flatnonzero((data == 0x20) | (data == 0x0A))
            blank = blank[~starts[blank] & (blank >= 4)]
            one, two, three, four = (data[blank - n] for n in (1, 2, 3, 4))
            wide, wider, widest = ((x & 0xC0) == 0x80 for x in (one, two, three))
            safe = ((one > 0x20) & (one < 0x7F)) | (wide & (two >= 0xC3) & (two < 0xE0)) | (wide & wider & (three >= 0xE4) & (three < 0xF0)) | (wide & wider & widest & (four >= 0xF0))
            blank = blank[safe]
            starts[blank] = True
            line = blank[data[blank] == 0x0A] + 1
            line = line[line < len(data)]
            starts[line[(data[line] > 0x20) & (data[line] < 0x7F)]] = True
            mark = np.flatnonzero(self.models.mark[data])
            mark = mark[mark >= 2]
            one, two = T.LOWER[data[mark - 1]], data[mark - 2]
            letter = ((one >= 97) & (one <= 122)) | ((two == 0xC3) & (one >= 0x80) & (data[mark - 1] != 0x97) & (data[mark - 1] != 0xB7))
            starts[mark[letter]] = True
        starts = np.flatnonzero(starts[:len(data)])
        return starts, np.append(starts[1:], len(data))

    def rows(self, piece: T.Piece) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per document n_a, n_b, n_groups, n_links and the digest; then its distinct pairs: how many, which, and how often linked."""
        n = len(piece)
        starts, ends = self.segments(piece)
        hashes = T.BYTES_OF[0].slices(T.BYTE_VALUES[0][piece.data], starts, ends)
        names, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        checks = T.BYTES_OF[1].slices(T.BYTE_VALUES[1][piece.data], starts[where], ends[where])
        if len(self.known) > KNOWN_AT_MOST or len(self.pair) > KNOWN_PAIRS_AT_MOST:
            self.clear()
        new = np.flatnonzero(~P.contains(self.known, names))
        raw = piece.data.tobytes()
        if len(new):
            self.learn(names[new], checks[new], [raw[s:e] for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
        at = np.searchsorted(self.known, names)
        if len(names) and not np.array_equal(self.check[at], checks):  # two segments with one hash: align every one of them for itself
            facts, text, pair, times = self.align([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())])
            index = np.arange(len(starts))
        else:
            facts, text, pair, times, index = self.facts, self.text, self.pair, self.times, self.index[at][back]
        doc = np.searchsorted(piece.offsets, starts, side="right") - 1
        bounds = np.searchsorted(doc, np.arange(n + 1))
        whole = (T.doc_sums(1 - facts[index, 4], bounds) == 0) & (np.diff(bounds) > 0)
        numbers = np.stack([T.doc_sums(facts[index, c], bounds) * whole for c in range(4)], axis=1)
        at, lists = bounds.tolist(), index.tolist()
        digest = [
            hashlib.sha256(b"".join(map(text.__getitem__, lists[at[i]:at[i + 1]]))[:-1]).hexdigest() if ok else "" for i, ok in enumerate(whole.tolist())
        ]
        live = whole[doc]
        used, often = np.unique(doc[live] * max(1, len(facts)) + index[live], return_counts=True)
        doc, segment = np.divmod(used, max(1, len(facts)))
        first, count = facts[segment, 5], facts[segment, 6]
        source = P.expand(first, count)
        doc, pair, times = _summed(np.repeat(doc, count), pair[source], times[source] * np.repeat(often, count), self.pairs)
        return numbers, digest, np.bincount(doc, minlength=n), pair, times


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))


def _align_batches(batches, a_path: str, b_path: str):
    model = aligner(a_path, b_path)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            numbers, digest, counts, pair, times = model.rows(piece)
            columns = [pa.array(row + np.arange(len(piece)), pa.int64()), batch.column("doc_id").slice(piece.first, len(piece))]
            columns += [pa.array(numbers[:, c], pa.int64()) for c in range(4)] + [pa.array(digest, pa.string()), _lists(counts, pair), _lists(counts, times)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            row += len(piece)


def _count_batches(batches):
    """Pairs of many documents with how many hold each, summed a bounded number of pairs at a time."""
    kept, total = [], 0

    def summed() -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        n = np.bincount(at, np.concatenate([k[1] for k in kept]), len(pair)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    for batch in batches:
        pair, n = np.unique(np.asarray(batch.column("pairs").flatten(), np.int64), return_counts=True)
        kept.append((pair, n))
        total += len(pair)
        if total > COUNTED_AT_ONCE:
            part = summed()
            if part.num_rows > COUNTED_AT_ONCE // 2:
                yield part
                kept, total = [], 0
            else:
                kept, total = [(part.column(0).to_numpy(), part.column(1).to_numpy())], part.num_rows
    if kept:
        yield summed()


def _known(table, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the table a pair stands, and whether it does."""
    at = np.minimum(np.searchsorted(table, pairs), max(0, len(table) - 1))
    return at, table[at] == pairs if len(table) else np.zeros(len(pairs), bool)


def _look_up(batches, table, width: int):
    pairs, counts, best = table.value
    for batch in batches:
        lists = batch.column("pairs")
        bounds = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        pair, times = np.asarray(lists.flatten(), np.int64), np.asarray(batch.column("times").flatten(), np.int64)
        at, there = _known(pairs, pair)
        n = np.where(there, counts[at] if len(counts) else 0, 0)
        top = there & (n == best[pair // width])
        sums = [T.doc_sums(times * top, bounds), T.doc_sums(times * n, bounds)]
        names = [c for c in batch.schema.names if c not in ("pairs", "times")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(s, pa.int64()) for s in sums)], names=[*names, "n_best", "count_sum"])


def _rare(batches, table):
    for batch in batches:
        lists = batch.column("pairs")
        pair, times = np.asarray(lists.flatten(), np.int64), np.asarray(batch.column("times").flatten(), np.int64)
        row = np.repeat(np.asarray(batch.column("row"), np.int64), np.diff(np.asarray(lists.offsets)))
        rare = ~_known(table.value[0], pair)[1]
        yield pa.RecordBatch.from_arrays([pa.array(x[rare], pa.int64()) for x in (row, pair, times)], names=["row", "pair", "times"])


def _least_count(counts: DataFrame, at_most: int) -> tuple[int, bool]:
    """The least count that at most ``at_most`` pairs reach, to a step of an eighth of a doubling, and whether some pairs lie below."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    left = at_most
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least = None
    for row in sorted(found, reverse=True):
        left -= row["pairs"]
        if left < 0:
            return (least if least is not None else 1 << 62), True
        least = row["least"]
    return least or 1, False


def align(docs: DataFrame, a_path: str, b_path: str, table_pairs: int = TABLE_PAIRS, folder: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A encodes a space and the text, B the text, to which it adds the space; special tokens are plain text. Byte offsets at which tokens of both end
    cut them into groups; every token of A is linked with every one of B of its group. An id pair counts the rows that hold it
    linked; ``n_best`` are links whose pair has the highest count of its A id, ``count_sum`` sums the counts over the links. Null and empty
    texts, and those whose bytes a tokenizer does not give back, have no tokens: zeros and an empty digest. Repeated rows and
    ids are rows of their own; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "alignment")
    models = tokenizers(a_path, b_path)
    width = len(models.b_bytes)
    text = F.col("text").cast("string")
    spaced = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).alias("text"))
    spaced.mapInArrow(lambda batches: _align_batches(batches, a_path, b_path), PAIRS).write.options(**WRITER).parquet(f"{folder}/rows")
    rows = spark.read.schema(PAIRS).parquet(f"{folder}/rows")
    rows.select("pairs").mapInArrow(_count_batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("pair long, n long").parquet(f"{folder}/counts")

    # One number per id of A, so the size of the vocabulary bounds it.
    a_id = F.expr(f"pair div {width}").alias("a")
    highest = counts.groupBy(a_id).agg(F.max("n").alias("best"))
    best = np.zeros(len(models.a_bytes), np.int64)
    for a, n in highest.collect():
        best[a] = n
    least, some_below = _least_count(counts, table_pairs)
    first = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(first.column("pair").to_numpy())
    table = spark.sparkContext.broadcast((first.column("pair").to_numpy()[order], first.column("n").to_numpy()[order], best))

    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    looked_up = rows.mapInArrow(
        lambda batches: _look_up(batches, table, width),
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long",
    )
    if not some_below:
        return looked_up.select(*result)
    below = counts.where(F.col("n") < least).select("pair", "n", a_id).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    more = (
        rows.select("row", "pairs", "times").mapInArrow(lambda batches: _rare(batches, table), "row long, pair long, times long")
        .join(below, "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    )
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return looked_up.join(more, "row", "left").withColumns(added).select(*result)
