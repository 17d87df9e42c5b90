"""Records dealt by hash to buckets and shuffled as packed arrays instead of as single rows.

A task packs its records per bucket into a few binary rows, which halves the bytes that a
shuffle of small rows writes. Buckets grow in number with the input, so a bucket's
size stays the same at every scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm import textops as T

SCHEMA = "bucket int, packed binary"
BUCKET_BYTES = 12 << 20


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets for records that grow with the bytes of all texts; one cheap aggregate."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(12, -(-total // BUCKET_BYTES))


def by_bucket(route: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes of its records) for every bucket that has any."""
    bucket = (T.mix(route.astype(T.U)) % T.U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    first, length = groups(bucket[order])
    for s, n in zip(first.tolist(), length.tolist()):
        yield int(bucket[order[s]]), order[s:s + n]


def rows(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["bucket", "packed"]
    )


def join(*columns: np.ndarray) -> bytes:
    """Columns end to end after their byte lengths."""
    head = np.array([len(columns), *(c.nbytes for c in columns)], "<i8")
    return head.tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def split(blobs, *kinds: str) -> list[np.ndarray]:
    """The columns of many packed values, each end to end."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        raw = blob.as_buffer()
        head = np.frombuffer(raw, "<i8", len(kinds) + 1)[1:]
        at = 8 * (len(kinds) + 1)
        for part, kind, size in zip(parts, kinds, head.tolist()):
            part.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
            at += size
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]


def groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return first, np.diff(np.append(first, len(ordered)))


def expand(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indexes of many ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(int(length.sum()))


def contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values
