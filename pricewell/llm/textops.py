"""Array helpers that run inside tasks: words, lines and shingles of a batch of texts as hashes.

A batch is taken apart in pieces of a few hundred documents, so memory follows the
piece, or the longest single text. Words are runs of bytes other than space, tab and
the other ASCII breaks; in UTF-8 that is the same as runs of code points. A hash is
a polynomial over random byte values, modulo 2**64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"
PIECE_DOCS = 256
PIECE_BYTES = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Poly:
    """Hashes of many slices of one array at once, by prefix sums of value * base**i."""

    def __init__(self, seed: int):
        self.base = int(seeded(seed, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = np.ones(1, U)
        self.inverses = np.ones(1, U)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            self.powers = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, self.base, U)]), dtype=U)
            self.inverses = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, self.inverse, U)]), dtype=U)

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.powers[: len(values)], dtype=U, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U))


BYTE_VALUES = (seeded(1, 256), seeded(2, 256))
BYTES_OF = (Poly(3), Poly(4))
GRAMS_OF = (Poly(5), Poly(6))


@dataclass
class Piece:
    """Some documents of a batch: ``data`` their bytes end to end, ``offsets`` where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def pieces(column: pa.Array, docs: int = PIECE_DOCS, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a column, null as empty, a bounded number at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), at + docs, len(column))
        yield Piece(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a piece: byte ranges, and ``bounds`` so that document i has words bounds[i]:bounds[i+1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def words(piece: Piece, is_break: np.ndarray = IS_BREAK) -> Words:
    """Runs of bytes other than those that ``is_break`` marks, which must be ASCII."""
    inside = ~is_break[piece.data]
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = piece.offsets[(piece.offsets > 0) & (piece.offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def word_hashes(piece: Piece, found: Words, lower: bool = False, which: int = 0) -> np.ndarray:
    data = LOWER[piece.data] if lower else piece.data
    return BYTES_OF[which].slices(BYTE_VALUES[which][data], found.starts, found.ends)


def gram_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of slices of a sequence of word hashes."""
    return GRAMS_OF[which].slices(hashes, starts, ends)


def windows(found: Words, size: int) -> np.ndarray:
    """Index of the first word of every window of ``size`` words that lies in one document."""
    ends = np.repeat(found.bounds[1:], found.counts())
    at = np.arange(len(found.starts))
    return at[at + size <= ends]


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: bytes that do not continue a UTF-8 sequence."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums


def doc_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's slice of ``values``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
