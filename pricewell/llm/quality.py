"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of each text become features that approximate a Gaussian kernel. Tasks sum
the normal equations of their rows, the sums (fixed in size) are added up and solved, scores of
rows left out of the fit give an increasing calibration from score to probability. The fit reads a bounded
sample of labelled rows; scoring reads every text once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm import textops as T
from pricewell.llm.host_rules import _repeated_words
from pricewell.session import work_dir

SAMPLE = 24_000
FIT_TASKS = 8
FEATURES = 320
KERNEL_WIDTH = 2.5
RIDGE = 1e-3
CALIBRATE_ONE_IN = 4
BINS = 512
SEED = 11

# Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = """
the of and to in is that for it was on are as with be by at this from or an
de la le et les des en un une du que est pour qui dans par au sur pas
der die und das von zu mit den für auf ist im ein eine nicht sich
el los las del se por con una su al lo como
""".split()

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "letters", "digits", "marks", "symbols", "bars", "stop_words",
    "distinct", "repeated_windows", "same_as_before", "top_word", "lines_per_word", "repeated_lines", "byte_entropy", "loud_words",
)


def _class_counts(piece: T.Piece, members: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(members)] = 1
    return T.doc_sums(table[piece.data], piece.offsets)


def statistics(piece: T.Piece) -> np.ndarray:
    """One row of STATISTICS per document; an empty text has zeros."""
    found = T.words(piece)
    hashes = T.word_hashes(piece, found)
    low = T.word_hashes(piece, found, lower=True)
    docs, counts = found.docs(), found.counts()
    chars = T.code_points(piece.data)
    lengths = chars[found.ends] - chars[found.starts]
    total_chars = np.maximum(chars[piece.offsets[1:]] - chars[piece.offsets[:-1]], 1)
    words = np.maximum(counts, 1)
    mean = T.doc_sums(lengths, found.bounds) / words
    square = T.doc_sums(lengths * lengths, found.bounds) / words
    upper = bytes(range(65, 91))
    letters = upper + bytes(range(97, 123)) + bytes(range(0xC0, 0xF8))
    stop = np.sort(T.word_hashes(*_piece_of(" ".join(STOP_WORDS))))
    is_stop = np.isin(low, stop).astype(np.int64)
    before = np.zeros(len(low), np.int64)
    before[1:] = (low[1:] == low[:-1]) & (docs[1:] == docs[:-1])
    keys = (docs.astype(T.U) << T.U(56)) | (low >> T.U(8))
    names, times = np.unique(keys, return_counts=True)
    # The bound after document 255 would be 2**64.
    at = np.append(np.searchsorted(names, np.arange(len(piece), dtype=T.U) << T.U(56)), len(names))
    top = np.zeros(len(piece))
    some = np.diff(at) > 0
    if some.any():
        top[some] = np.maximum.reduceat(times, at[:-1][some])
    uppers = np.zeros(256, np.int64)
    uppers[list(upper)] = 1
    up = np.concatenate([[0], np.cumsum(uppers[piece.data])])
    loud = ((up[found.ends] - up[found.starts]) >= 2).astype(np.int64)
    lines, repeated, entropy = np.zeros(len(piece)), np.zeros(len(piece)), np.zeros(len(piece))
    for i in range(len(piece)):
        text = piece.text(i)
        parts = [x for x in text.split(b"\n") if x.strip(T.BREAKS)]
        lines[i] = len(parts)
        repeated[i] = 1 - len(set(parts)) / len(parts) if parts else 0
        share = np.bincount(np.frombuffer(text, np.uint8), minlength=1) / max(1, len(text))
        share = share[share > 0]
        entropy[i] = -(share * np.log2(share)).sum()
    columns = [
        np.log1p(counts), mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        _class_counts(piece, upper) / total_chars, _class_counts(piece, letters) / total_chars, _class_counts(piece, b"0123456789") / total_chars,
        _class_counts(piece, b".,;:!?") / words, _class_counts(piece, b"#*$%&<>!") / words, _class_counts(piece, b"|") / words,
        T.doc_sums(is_stop, found.bounds) / words, np.diff(at) / words, _repeated_words(hashes, found) / words,
        T.doc_sums(before, found.bounds) / words, top / words, np.log1p(lines / words), repeated, entropy, T.doc_sums(loud, found.bounds) / words,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _piece_of(text: str):
    piece = next(T.pieces(pa.array([text])))
    return piece, T.words(piece)


def _statistics_batches(batches):
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        for piece in T.pieces(batch.column("text")):
            rows = statistics(piece)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(piece.first, len(piece)) for n in others), flat], names=[*others, "statistics"])


@dataclass
class Model:
    """Everything that scoring needs; a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.concatenate([waves, x, np.ones((len(x), 1))], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.knots, self.levels)


def _matrix(batches, name: str = "statistics") -> np.ndarray:
    parts = [np.asarray(b.column(name).flatten(), dtype=np.float64).reshape(-1, len(STATISTICS)) for b in batches if b.num_rows]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _normal_batches(batches, model: Model):
    """One row: the sums of f f' and f y over the task's rows, f the features with y appended."""
    size = model.directions.shape[1] + len(STATISTICS) + 2
    total = np.zeros((size, size))
    for batch in batches:
        f = model.features(_matrix([batch]))
        y = np.asarray(batch.column("label"), dtype=np.float64)
        f = np.concatenate([f, y[:, None]], axis=1)
        total += f.T @ f
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _bin_batches(batches, model: Model):
    for batch in batches:
        at = np.clip((model.raw(_matrix([batch])) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.float64())], names=["bin", "label"])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing fit by pooling adjacent violators: mean x and mean y of every pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    pools_ = np.array(pools)
    return pools_[:, 0] / pools_[:, 2], pools_[:, 1] / pools_[:, 2]


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, folder: str | None = None, sample: int = SAMPLE) -> Model | None:
    """A model of ``labels.quality``, from at most ``sample`` labelled rows for which ``learn_from`` holds (a column of doc_id).

    The sample is the rows of least hash. None if no labelled document is there. Rows of null label or id
    take no part; repeated labels of one document count once, the least.
    """
    folder = folder or work_dir(docs.sparkSession, "quality")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn_from).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    # At most ``sample`` rows of two numbers.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("of"), "label"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of")).select("doc_id", "label", "text")
    rows.mapInArrow(_statistics_batches, "doc_id long, label double, statistics array<double>").repartition(FIT_TASKS, "doc_id").write.parquet(folder)
    rows = docs.sparkSession.read.schema("doc_id long, label double, statistics array<double>").parquet(folder)
    each = [F.element_at("statistics", i + 1) for i in range(len(STATISTICS))]
    sums = rows.agg(F.count("*").alias("n"), F.array(*map(F.avg, each)).alias("mean"), F.array(*map(F.stddev_pop, each)).alias("scale")).first()
    if not sums["n"]:
        return None
    draw = np.random.default_rng(SEED)
    scale = np.array(sums["scale"])
    model = Model(
        np.array(sums["mean"]), np.where(scale > 1e-9, scale, 1.0), draw.normal(size=(len(STATISTICS), FEATURES)) / KERNEL_WIDTH,
        draw.uniform(0, 2 * math.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0),
    )
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(CALIBRATE_ONE_IN)) == 0
    learn = rows.where(~calibrate) if sums["n"] >= 10 * CALIBRATE_ONE_IN else rows
    # One matrix per file of the bounded sample, its size set by the number of features.
    parts = learn.coalesce(FIT_TASKS).mapInArrow(lambda b: _normal_batches(b, model), "sums binary").toArrow().column("sums").to_pylist()
    size = FEATURES + len(STATISTICS) + 2
    total = sum(np.frombuffer(p).reshape(size, size) for p in parts)
    n = total[-2, -2]
    penalty = np.eye(size - 1) * RIDGE * n / FEATURES
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])
    held = rows.where(calibrate) if sums["n"] >= 10 * CALIBRATE_ONE_IN else rows
    bins = held.mapInArrow(lambda b: _bin_batches(b, model), "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("y")).orderBy("bin").toArrow()
    x = (bins.column("bin").to_numpy() + 0.5) / BINS * 2 - 0.5
    model.knots, model.levels = isotonic(x, bins.column("y").to_numpy(), bins.column("n").to_numpy().astype(float))
    # A hair of slope keeps the order of scores where the calibration is flat.
    model.levels = np.clip(model.levels, 0, 1) * (1 - 1e-6)
    return model


def _score_batches(batches, model: Model | None):
    for batch in batches:
        for piece in T.pieces(batch.column("text")):
            rows = statistics(piece)
            if model is None:
                scores = np.full(len(rows), 0.5)
            else:
                raw = model.raw(rows)
                scores = np.interp(raw, model.knots, model.levels) + 1e-6 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_key").slice(piece.first, len(piece)), pa.array(np.clip(scores, 0, 1))], names=["doc_key", "score"])


def _with_score_batches(batches, model: Model | None):
    for batch in batches:
        keyed = batch.select(["text"])
        keyed = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), keyed.column(0)], names=["doc_key", "text"])
        scores = [r.column("score") for r in _score_batches([keyed], model)]
        score = pa.concat_arrays(scores) if scores else pa.array([], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` in place of a column of that name: 0 to 1, higher for likelier good.

    Only the text is an input. Null and empty texts are scored like any other, from statistics of zero. Without a
    model every score is 0.5. Repeated rows score alike; an empty table gives no rows.
    """
    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda b: _with_score_batches(b, model), f"{schema}, score double")
