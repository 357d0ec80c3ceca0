"""Toxicity: non-negative positive-unlabelled learning on hashed words and word beginnings.

Only confirmed toxic texts are trusted as labels for training; a sample of all texts, toxic ones among it, is the
unlabelled side. The risk of calling the unlabelled clean, less what the toxic among them account for at the class
prior, can't truly be negative; a batch where it gets so is overfitted, and the step goes the other way (Kiryo et al.,
2017). A logistic curve fitted to labelled texts that training left out turns scores into probabilities: a hashed fifth
of the labels, each class sampled by itself and weighted by how many labels a sampled one stands for.

The samples are bounded by ``bounds`` (POSITIVE, UNLABELLED and CALIBRATION ids, those with the smallest hashes; half of
CALIBRATION for each class; of an id that repeats, one text); every text is scored, whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import batches_of, fold, written
from .quality import summed

POSITIVE, UNLABELLED, CALIBRATION = 5_000, 10_000, 5_000
Bounds = tuple[int, int, int]
BOUNDS: Bounds = (POSITIVE, UNLABELLED, CALIBRATION)
#: The sample, which is bounded, is dealt into so many partitions.
SAMPLE_PARTS = 12
SIZE = 1 << 18
#: A feature needs so many texts, and so many standard deviations between toxic and other texts.
LEAST_TEXTS, LEAST_Z = 5, 4.0
_WORDS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6)


def hashes(word: str) -> list[int]:
    """The features of a word: itself and its beginnings."""
    out = [zlib.crc32(word.encode()) % SIZE]
    return out + [zlib.crc32(f"^{word[:n]}".encode()) % SIZE for n in _BEGINNINGS if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 256):
        made = [np.array([h for w in words_of(t.as_py()) for h in hashes(w)], dtype=np.int32) for t in batch.column(1)]
        made = [np.sort(m).tobytes() for m in made]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "x"])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the toxic and the unlabelled texts of a partition have each feature, and how many texts there are."""
    total = np.zeros(2 * SIZE + 2)
    for batch in batches_of(batches, 256):
        for k in (0, 1):
            own = batch.column(0).filter(batch.column(k + 1))
            features = np.frombuffer(b"".join(x.as_py() for x in own), dtype=np.int32)
            total[k * SIZE : (k + 1) * SIZE] += np.bincount(features, minlength=SIZE)
            total[2 * SIZE + k] += len(own)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def _only(place):
    """The features with a place that isn't negative, as those places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place.value[np.frombuffer(x.as_buffer(), dtype=np.int32)] for x in batch.column(1)]
            made = pa.array([f[f >= 0].tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made, *batch.columns[2:]], names=batch.schema.names)

    return run


class Rows:
    """Sparse rows: features one after another, and the row that each is in."""

    def __init__(self, rows: list[bytes]):
        self.n = len(rows)
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=self.n) // 4
        self.feature = np.frombuffer(b"".join(rows), dtype=np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.start = np.concatenate([[0], np.cumsum(sizes)])

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take = np.concatenate([np.arange(self.start[r], self.start[r + 1]) for r in rows])
        return self.feature[take], np.repeat(np.arange(rows.size), self.start[rows + 1] - self.start[rows])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def screened(p: np.ndarray, u: np.ndarray, n_positive: float, n_unlabelled: float) -> np.ndarray:
    """Values of the features that toxic texts have significantly more or less often; 0 for all others.

    ``p`` and ``u`` are how often toxic and unlabelled texts have each feature. A value is the log ratio of the shares of
    texts, so that what tells more also learns faster.
    """
    share = np.minimum((p + u + 1) / (n_positive + n_unlabelled + 2), 0.999)
    z = (p - n_positive * share) / np.sqrt(n_positive * share * (1 - share))
    ratio = np.log((p + 1) / (n_positive + 2)) - np.log((u + 1) / (n_unlabelled + 2))
    return np.where((p + u >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z), np.abs(ratio), 0.0)


def fit(positive: Rows, unlabelled: Rows, scale: np.ndarray, prior: float, epochs: int = 60, batches: int = 10, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam.

    The rows' features are places in ``scale``, their values.
    """
    size = scale.size
    w = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        p_order, u_order = rng.permutation(positive.n), rng.permutation(unlabelled.n)
        for p_rows, u_rows in zip(np.array_split(p_order, batches), np.array_split(u_order, batches), strict=True):
            if not p_rows.size or not u_rows.size:
                continue
            (pf, pr), (uf, ur) = positive.part(p_rows), unlabelled.part(u_rows)
            pz = np.bincount(pr, weights=(w[:size] * scale)[pf], minlength=p_rows.size) + w[size]
            uz = np.bincount(ur, weights=(w[:size] * scale)[uf], minlength=u_rows.size) + w[size]
            if np.logaddexp(0, uz).mean() >= prior * np.logaddexp(0, pz).mean():
                toxic, plain = np.full(p_rows.size, -prior / p_rows.size), _sigmoid(uz) / u_rows.size
            else:  # the clean risk can't be negative: a step the other way
                toxic, plain = prior * _sigmoid(pz) / p_rows.size, -_sigmoid(uz) / u_rows.size
            g = (np.bincount(pf, weights=toxic[pr], minlength=size) + np.bincount(uf, weights=plain[ur], minlength=size)) * scale
            g = np.append(g + decay * w[:size], toxic.sum() + plain.sum())
            step += 1
            mean = 0.9 * mean + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:size] * scale, float(w[size])


def logistic_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the chance of label 1 over weighted scores, by Newton's method with a slight ridge."""
    scale = max(1.0, float(np.abs(z).max(initial=0)))
    x = np.stack([z / scale, np.ones(z.size)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * beta), -5, 5)
    return max(float(beta[0]) / scale, 1e-3), float(beta[1])


class Model:
    """A fitted scorer; without toxic texts to learn from, every score is the prior."""

    def __init__(self, prior: float = 0.0):
        self.prior, self.weights, self.bias, self.curve = prior, None, 0.0, (1.0, 0.0)


def fitted(docs: DataFrame, labels: DataFrame, bounds: Bounds = BOUNDS) -> Model:
    """Learn from labels (doc_id, y) and docs that are already those of the training fold."""
    most_positive, most_unlabelled, most_calibrating = bounds
    first = lambda df, salt, n: df.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(n)
    seen = labels.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    if not seen["p"]:
        return Model()
    model = Model(seen["p"] / seen["n"])
    samples = first(docs, 1, most_unlabelled).withColumn("part", F.lit(0))
    samples = samples.union(first(labels.where("y = 1"), 2, most_positive).withColumn("part", F.lit(1)))
    fifth = labels.groupBy("doc_id").agg(F.max("y").alias("y")).where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0)
    for y in (0, 1):
        samples = samples.union(first(fifth.where(F.col("y") == y), 4, most_calibrating // 2).withColumn("part", F.lit(2)))
    samples = written(samples)
    parts = samples.groupBy("doc_id").agg(F.collect_set("part").alias("parts"))
    parts = parts.join(labels.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", "left")
    chosen = docs.join(F.broadcast(parts), "doc_id")  # at most as many ids as the bounds add up to
    keyed = chosen.select("doc_id", "text").mapInArrow(_features, "doc_id long, x binary")
    rows = keyed.join(F.broadcast(parts), "doc_id").repartition(SAMPLE_PARTS, "doc_id")
    # What calibrates is kept from training.
    in_part = lambda k: F.array_contains("parts", k) & ~F.array_contains("parts", 2)
    calibrates = F.array_contains("parts", 2)
    rows = rows.select("doc_id", "x", "y", in_part(1).alias("positive"), in_part(0).alias("unlabelled"), calibrates.alias("calibrates"))
    rows = written(rows.groupBy("doc_id").agg(F.min(F.struct(*rows.columns[1:])).alias("one")).select("doc_id", "one.*"))
    # Features are screened where the rows are; only the few that tell anything reach the driver.
    total = summed(rows.select("x", "positive", "unlabelled").mapInArrow(_seen, "part binary"), SAMPLE_PARTS)
    p, u, sizes = np.split(total if total is not None else np.zeros(2 * SIZE + 2), [SIZE, 2 * SIZE])
    if not sizes[0]:
        return Model()
    value = screened(p, u, sizes[0], sizes[1])
    chosen_features = np.flatnonzero(value)
    place = np.full(SIZE, -1, dtype=np.int32)
    place[chosen_features] = np.arange(chosen_features.size)
    shared = docs.sparkSession.sparkContext.broadcast(place)
    few = rows.mapInArrow(_only(shared), rows.schema).collect()
    few.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    pick = lambda role: Rows([r["x"] for r in few if r[role]])
    weights, model.bias = fit(pick("positive"), pick("unlabelled"), value[chosen_features], min(max(model.prior, 0.01), 0.9))
    known = pick("calibrates")
    raw = np.bincount(known.row, weights=weights[known.feature], minlength=known.n) + model.bias
    y = np.array([r["y"] for r in few if r["calibrates"]], dtype=np.int64)
    whole = {r["y"]: r["n"] for r in fifth.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if y.any() and not y.all():  # without both classes the risk's own log odds stand
        stands = np.array([whole[k] / max(1, (y == k).sum()) for k in (0, 1)])[y]
        model.curve = logistic_curve(raw, y.astype(np.float64), stands * y.size / stands.sum())
    model.weights = np.zeros(SIZE)
    model.weights[chosen_features] = weights
    return model


def scored(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, limit: float = 0.3, bounds: Bounds = BOUNDS
) -> DataFrame:
    """A score for each whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= limit).

    Needs doc_id and text, and labels with doc_id and ``label``; labels that are null or not 0 or 1 don't count. Learns
    only from rows whose crc32(doc_id) mod ``folds`` is not ``held_out``. Null texts count as empty and get a score like
    any other; equal texts get equal scores; repeated rows are scored each. A null doc_id is never learnt from, and its
    held_out is null. An empty table gives an empty result. ``bounds`` are the most toxic, unlabelled and calibrating ids
    that the fit takes.
    """
    rows = with_scores(docs.select("doc_id", "text"), labels, label, folds, held_out, bounds=bounds).select("doc_id", F.col("_score").alias("score"))
    held = (F.pmod(fold(), F.lit(folds)) == held_out).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def with_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, name: str = "_score", bounds: Bounds = BOUNDS
) -> DataFrame:
    """The input's columns and the score as ``name``, which must not be one of them."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    spark = docs.sparkSession
    learns = F.pmod(fold(), F.lit(folds)) != held_out
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IN (0, 1)").where(learns)
    model = fitted(docs.select("doc_id", "text").where(learns), y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), bounds)
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.curve, model.prior))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, (slope, offset), prior = shared.value
        known: dict[str, float] = {}
        for batch in batches_of(batches, 1024):
            raw = []
            for text in batch.column(at):
                words = words_of(text.as_py()) if weights is not None else ()
                if len(known) > 300_000:
                    known.clear()
                for word in words:
                    if word not in known:
                        known[word] = float(weights[hashes(word)].sum())
                raw.append(math.fsum(map(known.__getitem__, words)))
            scores = _sigmoid(slope * (np.array(raw) + bias) + offset) if weights is not None else np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The documents whose score is under ``limit``, with their own columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, labels, name=name).where(F.col(name) < limit).drop(name)
