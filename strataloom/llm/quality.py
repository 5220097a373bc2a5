"""Quality scores by random Fourier features and isotonic calibration (operator 2).

Document statistics go through random cosine features, whose inner products approximate a Gaussian
kernel; ridge regression on them needs only the sums ZᵀZ and Zᵀy, which each partition adds up by
itself.  Isotonic regression on another fold turns the raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, sliced, written
from .tokens import mix, shingles, words

#: Kinds of bytes that are counted.
_KINDS = ("other", "lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "shout", "bar", "high")
_KIND = np.zeros(256, dtype=np.int32)
for _k, _chars in enumerate(("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:'()-?", "#$%&*+<=>@[]^_`{}~\\/\"", "!", "|")):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[0x80:] = len(_KINDS) - 1
N_STATISTICS = len(_KINDS) + 9


@dataclass(frozen=True)
class QualityParams:
    """``max_labels`` bounds the labelled sample; one in ``calibration`` of it calibrates."""

    max_labels: int = 20_000
    features: int = 256
    width: float = 3.0
    ridge: float = 1.0
    calibration: int = 4
    bins: int = 512
    seed: int = 7


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.mean) / self.scale, self.directions, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # a thousandth of the raw score keeps the order of scores within a calibrated step
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _fourier(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.sqrt(2 / len(phases)) * np.cos(np.clip(x, -8, 8) @ directions + phases)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics a text: shares of byte kinds, lengths, and how much is repeated."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    plain = plain.combine_chunks() if isinstance(plain, pa.ChunkedArray) else plain
    _, offsets, data = plain.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(plain) + 1, offset=8 * plain.offset)
    data = (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    n, size = len(plain), np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int32) * len(_KINDS), size)
    kinds = np.bincount(owner + _KIND[data], minlength=n * len(_KINDS)).reshape(n, -1)
    out = np.zeros((n, N_STATISTICS))
    out[:, : len(_KINDS)] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
    w = words(texts)
    docs, count = w.docs, np.diff(w.bounds)
    some = np.maximum(count, 1)
    letters = np.bincount(docs, w.ends - w.starts, n)
    squares = np.bincount(docs, (w.ends - w.starts).astype(float) ** 2, n)
    k = len(_KINDS)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = letters / some
    out[:, k + 3] = np.sqrt(np.maximum(squares / some - (letters / some) ** 2, 0))
    out[:, k + 4] = _distinct(w.hashes, docs, n) / some
    same = np.zeros(len(w.hashes), dtype=bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (docs[1:] == docs[:-1])
    out[:, k + 5] = np.bincount(docs[same], minlength=n) / some
    threes, bounds = shingles(w, 3)
    of = np.repeat(np.arange(n), np.diff(bounds))
    out[:, k + 6] = _distinct(threes, of, n) / np.maximum(np.diff(bounds), 1)
    out[:, k + 7] = np.log1p(count / (kinds[:, _KINDS.index("stop")] + 1))
    out[:, k + 8] = np.log1p(count / (kinds[:, _KINDS.index("line")] + 1))
    return out


def _distinct(hashes: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    keys = np.sort(mix(hashes + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(0xFFFFF) | docs.astype(np.uint64))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] & np.uint64(0xFFFFF)).astype(np.int64), minlength=n)


def _rows(batches: Iterator[pa.RecordBatch], label: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        yield np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, N_STATISTICS), batch.column(label).to_numpy().astype(float), batch.column("fold").to_numpy()


def _partition_sums(made, label: str):
    """One row a partition: the sum of what ``made`` returns for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, y, fold in _rows(batches, label):
            own = made(x[fold > 0], y[fold > 0])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

    return run


def _add_up(rows: DataFrame, made, label: str) -> np.ndarray:
    """Sums over all partitions; sixteen tasks add the partitions' sums before the driver does."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                own = np.frombuffer(data, "<f8")
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(_partition_sums(made, label), "sums binary").repartition(16).mapInArrow(add, "sums binary").collect()
    return sum((np.frombuffer(r.sums, "<f8") for r in parts), np.zeros(1))


def _isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their non-decreasing values."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, mean, weight, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    total = np.array(blocks)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def fit(labelled: DataFrame, label: str = "quality", params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on (doc_id, label 0/1, text) rows; other rows are left out, a null text is empty.

    The driver receives sums of (features + 1)² numbers and ``bins`` counts, whatever the input.
    Without rows of both labels every score is the mean label, or 0.5 without any.
    """
    rows = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.coalesce("text", F.lit("")).alias("text"), F.col(label).cast("int").alias(label), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(params.calibration)).cast("int").alias("fold"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(label), batch.column("fold")], ["x", label, "fold"])

    rows = written(rows.mapInArrow(lean(measure), f"x array<double>, {label} int, fold int"), "quality-statistics")
    moments = _add_up(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x**2).sum(0)]), label)
    rng = np.random.default_rng(params.seed)
    k = N_STATISTICS
    directions = rng.standard_normal((k, params.features)) / params.width
    phases = rng.uniform(0, 2 * np.pi, params.features)
    if len(moments) == 1 or not 0 < moments[1] < moments[0]:
        base = moments[1] / moments[0] if len(moments) > 1 and moments[0] else 0.5
        return QualityModel(np.zeros(k), np.ones(k), directions, phases, np.zeros(params.features + 1), np.array([0.0]), np.array([base]))
    n = moments[0]
    mean = moments[2 : 2 + k] / n
    scale = np.sqrt(np.maximum(moments[2 + k :] / n - mean**2, 1e-8))
    d = params.features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _fourier((x - mean) / scale, directions, phases)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _add_up(rows, normal, label)
    penalty = params.ridge * np.eye(d)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + penalty, sums[d * d :])
    model = QualityModel(mean, scale, directions, phases, weights, np.array([0.0]), np.array([0.5]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, fold in _rows(batches, label):
            x, y = x[fold == 0], y[fold == 0]
            raw = model.raw(x)
            slot = np.clip((raw + 0.5) / 2 * params.bins, 0, params.bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(raw), pa.array(y)], ["slot", "raw", "y"])

    bins = rows.mapInArrow(binned, "slot int, raw double, y double").groupBy("slot").agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("slot").collect()
    if bins:
        at, y, w = (np.array([float(r[c]) for r in bins]) for c in ("raw", "y", "n"))
        # half a row of either label keeps the ends off 0 and 1
        model.knots, model.values = _isotonic(at, (y + 0.01) / (w + 0.02), w)
    return model


def scored(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``, the probability of label 1 (null text: as an empty one).

    One pass without a shuffle; every row stays, repeated ones too, and other columns are kept but
    for one of that name, which is replaced.  Texts of any length are read whole.
    """
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            p = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), schema)
