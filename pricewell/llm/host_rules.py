"""Quality rules by host: failures per document and rule, shrunk failure rates per host, verdicts joined back.

Every rule's failures of a host are summed (partial sums first, so a host with a third of all
documents sends one row per task), each rate is shrunk towards all hosts by a beta prior fitted to
the hosts' own rates of that rule, and a host with a shrunk rate above its rule's limit takes its documents with it.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm import textops as T
from pricewell.session import work_dir

LEAST_WORDS = 50
MOST_REPEATED = 0.5
REPEAT_WINDOW = 3
# Share of a host's documents that may fail a rule. A document that fails one of the first two is out by itself; the
# others tell of a host rather than of a document.
HOST_MOST_FAILED = {"base": 0.5, "short": 0.5, "repeats": 0.4, "symbols": 0.7, "lines": 0.6, "lengths": 0.7}
MOST_SYMBOLS = 0.25
MOST_REPEATED_LINES = 0.25
WORD_CHARS = (2, 15)

# Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeated_words(hashes: np.ndarray, found: T.Words, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, words that lie in a window found twice or more in it."""
    at = T.windows(found, size)
    if not len(at):
        return np.zeros(len(found.bounds) - 1, np.int64)
    grams = T.gram_hashes(hashes, at, at + size)
    docs = found.docs()[at].astype(T.U)
    keys = (docs << T.U(56)) | (grams >> T.U(8))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(found.starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + size, -1)
    return T.doc_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), found.bounds)


def _repeated_lines(text: bytes) -> int:
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(T.BREAKS):
            seen.add(line)
    return repeated


def _counts_of_batches(batches):
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            found = T.words(piece)
            chars = T.code_points(piece.data)
            columns = [
                found.counts(),
                T.doc_sums(chars[found.ends] - chars[found.starts], found.bounds),
                T.doc_sums(symbol[piece.data], piece.offsets),
                np.array([_repeated_lines(piece.text(i)) for i in range(len(piece))], np.int64),
                _repeated_words(T.word_hashes(piece, found), found),
            ]
            keep = [batch.column(n).slice(piece.first, len(piece)) for n in ("doc_id", "host")]
            yield pa.RecordBatch.from_arrays(
                [*keep, *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )


def document_counts(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts that the rules read, one row per row of ``docs``."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col("text"))
    counted = columns.mapInArrow(_counts_of_batches, f"doc_id long, host string, {COUNTS}")
    failed = rule_failures()
    return counted.withColumn("base_failed", failed["base"])


def rule_failures() -> dict[str, Column]:
    """Whether a document fails each rule, from its counts. The limits are whole-number comparisons but for the shares."""
    words, chars = F.col("n_words"), F.col("word_chars")
    short, repeats = words < LEAST_WORDS, F.col("n_repeat_words") > MOST_REPEATED * words
    return {
        "base": short | repeats, "short": short, "repeats": repeats, "symbols": F.col("n_symbols") > MOST_SYMBOLS * words,
        "lines": F.col("n_dup_lines") > MOST_REPEATED_LINES * words,
        "lengths": (chars < WORD_CHARS[0] * words) | (chars > WORD_CHARS[1] * words),
    }


def host_verdicts(counted: DataFrame, most_failed: Mapping[str, float] = HOST_MOST_FAILED) -> DataFrame:
    """One row per host: documents, ``rates`` (shrunk, by rule), the rules it ``broke`` and whether its documents may stay.

    A rule's prior is beta(m * s, (1 - m) * s): m the mean of the hosts' rates of that rule and s from their
    variance (method of moments), between 1 and 10,000. With one host or equal rates s is large and the rate
    is the mean. A null host is a host of its own.
    """
    rules = sorted(most_failed)
    failed = rule_failures()
    hosts = counted.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(failed[r]).alias(f"failed_{r}") for r in rules])
    rate = {r: F.col(f"failed_{r}") / F.col("n_docs") for r in rules}
    moments = hosts.agg(*[F.avg(rate[r]).alias(f"m_{r}") for r in rules], *[F.coalesce(F.var_pop(rate[r]), F.lit(0.0)).alias(f"v_{r}") for r in rules])

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        s = F.greatest(F.least(m * (1 - m) / F.greatest(v, F.lit(1e-6)) - 1, F.lit(1e4)), F.lit(1.0))
        return (F.col(f"failed_{r}") + m * s) / (F.col("n_docs") + s)

    # The moments are one row: a global aggregate.
    rated = hosts.join(F.broadcast(moments)).withColumns({f"rate_{r}": shrunk(r) for r in rules})
    broke = F.array_compact(F.array(*[F.when(F.col(f"rate_{r}") > most_failed[r], F.lit(r)) for r in rules]))
    return rated.select("host", "n_docs", F.struct(*[F.col(f"rate_{r}").alias(r) for r in rules]).alias("rates"), broke.alias("broke"), (F.size(broke) == 0).alias("host_ok"))


def judge(docs: DataFrame, host_col: str = "source", folder: str | None = None, most_failed: Mapping[str, float] = HOST_MOST_FAILED) -> DataFrame:
    """doc_id, host, the counts, base_failed, the host's ``rates`` and the rules it ``broke``, and ``kept``.

    A document fails with under 50 words, or if more than half of its words lie in 3-word windows
    it holds twice or more. It is kept if it does not fail and its host's shrunk rate of failures of every rule
    in ``most_failed`` is at most the rule's limit. Null and empty texts have no words and fail. Repeated rows
    count each; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "host-rules")
    document_counts(docs, host_col).write.parquet(folder)
    counted = spark.read.schema(f"doc_id long, host string, {COUNTS}, base_failed boolean").parquet(folder)
    verdicts = host_verdicts(counted, most_failed).select(F.col("host").alias("of_host"), "rates", "broke", "host_ok")
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
