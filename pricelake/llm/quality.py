"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

cos(w.x + b) with Gaussian w and uniform b gives features whose products approximate a Gaussian kernel. Each
partition sums its part of the normal equations, parts are summed up in a tree, and one small system is solved. The
scores of a fold that the fit leaves out are calibrated by isotonic regression over at most BINS bins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, fold, written

FEATURES, WIDTH, RIDGE, SEED, BINS = 256, 4.0, 1e-3, 11, 500
N_STATISTICS = 22
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


def statistics(text: bytes) -> list[float]:
    """Shares, lengths and repeats that describe a whole text; all 0 for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
    share = counts / n
    present = share[share > 0]
    words = text.lower().split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(1 for x in words if not _LETTERS.search(x))
    ascii_letters = counts[65:91].sum() + counts[97:123].sum()
    return [
        np.log1p(n), np.log1p(w), counts[65:91].sum() / max(1.0, ascii_letters), share[48:58].sum(), share[33], share[[35, 36, 37, 38, 42]].sum(), share[124],
        share[[44, 46]].sum(), share[[34, 39, 58, 59, 60, 61, 62, 64, 91, 92, 93, 94, 95, 123, 125, 126]].sum(), share[128:].sum(), share[[9, 10, 13, 32]].sum(),
        -(present * np.log2(present)).sum(), lengths.mean(), lengths.std(), distinct / w, repeats / w, pairs / w, marked / w, np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)) / 100, counts[46] / w,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1024):
        made = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def fourier(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant of rows of statistics."""
    rng = np.random.default_rng(SEED)
    w, b = rng.standard_normal((N_STATISTICS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    scaled = np.clip((x - mean) / deviation, -8, 8)
    return np.hstack([np.cos(scaled @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches_of(batches, 8):
        for part in batch.column(0):
            values = np.frombuffer(part.as_buffer(), dtype=np.float64)
            total = values.copy() if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def summed(parts: DataFrame, partitions: int) -> np.ndarray | None:
    """The sum of equally long arrays of double, given as bytes, a few for each partition; added up in a tree."""
    parts = parts.mapInArrow(_added, "part binary")
    while partitions > 1:
        partitions = -(-partitions // 16)
        parts = written(parts.repartition(partitions).mapInArrow(_added, "part binary"))
    found = parts.collect()  # one row, or none
    return np.frombuffer(found[0]["part"], dtype=np.float64) if found else None


def _pooled(blocks: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Neighbouring blocks (sum of points, positive, n) put together until their shares of positives rise."""
    out: list[tuple[float, float, float]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            right, left = out.pop(), out.pop()
            out.append((left[0] + right[0], left[1] + right[1], left[2] + right[2]))
    return out


def isotonic(at: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and rising probabilities, for bins in ascending order.

    Adjacent violators are pooled; then half a positive and half a negative is added to each block, and since a small
    block moves further than a large one, they are pooled once more.
    """
    blocks = _pooled(list(zip(at * n, positive, n, strict=True)))
    blocks = _pooled([(x / c * (c + 1), p + 0.5, c + 1) for x, p, c in blocks])
    return np.array([x / c for x, _, c in blocks]), np.array([p / c for _, p, c in blocks])


class Model:
    """A fitted classifier; without both labels in training, every score is the share of label 1, or a half."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None
        self.mean, self.deviation = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
        self.points, self.chances = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.deviation) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        # The plain score in small, so that calibration makes no ties.
        return np.clip(np.interp(raw, self.points, self.chances) * 0.999 + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50))), 0, 1)


def fitted(rows: DataFrame, partitions: int) -> Model:
    """The model of rows (x, y, calibrates): y is 0 or 1, and rows that calibrate are kept from the fit."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(np.float64)
            values = np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["part"])

    learnt = rows.where("NOT calibrates").select("x", "y")
    total = summed(learnt.mapInArrow(moments, "part binary"), partitions)
    if total is None or not total[0]:
        return Model()
    n, model = total[0], Model(total[1] / total[0])
    if total[1] in (0, n):
        return model
    model.mean = total[2 : 2 + N_STATISTICS] / n
    model.deviation = np.sqrt(np.maximum(total[2 + N_STATISTICS :] / n - model.mean**2, 1e-8))
    mean, deviation, size = model.mean, model.deviation, FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = fourier(_matrix(batch.column(0)), mean, deviation)
            values = np.concatenate([(z.T @ z).ravel(), z.T @ batch.column(1).to_numpy().astype(np.float64)])
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["part"])

    total = summed(learnt.mapInArrow(equations, "part binary"), partitions)
    normal = total[: size * size].reshape(size, size) + RIDGE * n / FEATURES * np.eye(size)
    model.weights = np.linalg.solve(normal, total[size * size :])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.rint((np.clip(model.raw(_matrix(batch.column(0))), -0.5, 1.5) + 0.5) / 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "y"])

    bins = rows.where("calibrates").select("x", "y").mapInArrow(raw, "bin long, y int").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    found = sorted((r["bin"], r["p"], r["n"]) for r in bins.collect())  # at most BINS + 1 rows
    if found:
        at, p, c = (np.array(v, dtype=np.float64) for v in zip(*found, strict=True))
        model.points, model.chances = isotonic(at / BINS * 2 - 0.5, p, c)
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out_of: int = 5, limit: float = 0.3) -> DataFrame:
    """A score for each whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= limit).

    Needs doc_id and text, and labels with doc_id and ``label``; labels that are null or not 0 or 1 don't count. Learns
    only from rows whose crc32(doc_id) mod ``held_out_of`` is not 0; of these, remainder 1 calibrates. Null texts count
    as empty and get a score like any other; equal texts get equal scores; repeated rows are scored each. A null doc_id
    is never learnt from, and held_out is null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    x = written(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>"))
    y = labels.select(F.col("doc_id").alias("_doc"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)")
    part = F.pmod(fold("_doc"), F.lit(held_out_of))
    y = y.withColumn("_part", part).where("_part <> 0")
    rows = written(x.join(y, F.col("doc_id") == F.col("_doc")).select("x", "y", (F.col("_part") == 1).alias("calibrates")))
    model = spark.sparkContext.broadcast(fitted(rows, rows.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(_matrix(batch.column(1))))], names=["doc_id", "score"])

    out = x.mapInArrow(run, "doc_id long, score double")
    held = (F.pmod(fold(), F.lit(held_out_of)) == 0).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= limit).cast("int").alias("predicted"))
