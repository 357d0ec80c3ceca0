"""Document fingerprints by improbable features: the rarest byte windows of a text in a chain of Bloom filters.

Each window of WINDOW bytes has an entropy. How many windows of the whole corpus share an entropy level says how rare
that level is, and ranks the windows. A window is selected if it is the rarest of enough of the runs of NEIGHBOURS
windows that it is in, so that selection depends on the text nearby alone, and an edit changes only what is near it.
Selected windows are inserted into Bloom filters of FILTER bytes, a new one begun whenever one has FULL features. Two
fingerprints are compared filter by filter: the bits in common, less what chance gives, over the most there could be.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import batches_of

WINDOW, NEIGHBOURS, POPULAR = 12, 16, 6
FILTER, FULL, HASHES = 256, 160, 5
LEVELS = 512

# c*log2(c) for the counts c in a window as whole numbers, so that a window's level does not depend on where it is.
_SCALE = 1 << 16
_TERMS = np.rint([_SCALE * c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)]).astype(np.int64)
_GAINS = np.diff(_TERMS)
_MIX = np.random.default_rng(29).integers(1, 2**63, size=(HASHES, WINDOW), dtype=np.uint64) | np.uint64(1)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window of the bytes ``data``, which are at least a window long."""
    n = data.size
    before = np.zeros(n, dtype=np.uint8)  # how often a byte is among the WINDOW - 1 before it
    after = np.zeros(n, dtype=np.uint8)  # and among those after it
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    # Moving a window by one byte, the old first byte leaves, then a new last one enters.
    change = _GAINS[before[WINDOW:]] - _GAINS[after[: n - WINDOW]]
    first = _TERMS[np.bincount(data[:WINDOW], minlength=256)].sum()
    total = np.concatenate([[first], first + np.cumsum(change)])
    entropy = np.log2(WINDOW) - total / (_SCALE * WINDOW)
    return np.clip(np.rint(entropy / np.log2(WINDOW) * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64)


def padded(text: bytes) -> np.ndarray:
    """The bytes of a text, a window of zeros before and after, so that short texts have windows too."""
    return np.frombuffer(b"\0" * WINDOW + text + b"\0" * WINDOW, dtype=np.uint8)


def selected(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the selected windows, ascending."""
    order = rank[levels(data)]
    key = (order << np.int64(32)) | np.arange(order.size)  # the leftmost of equally rare ones
    run, reach = key, 1
    while reach < NEIGHBOURS and run.size > 1:
        step = min(reach, NEIGHBOURS - reach, run.size - 1)
        run = np.minimum(run[:-step], run[step:])
        reach += step
    winner = run & np.int64(0xFFFFFFFF)
    starts = np.flatnonzero(np.concatenate([[True], winner[1:] != winner[:-1]]))
    popular = np.diff(np.append(starts, winner.size))
    kept = winner[starts[popular >= min(POPULAR, winner.size)]]
    return np.unique(kept)


def fingerprint(text: bytes, rank: np.ndarray) -> bytes:
    """The chain of Bloom filters of a text, a filter after another; empty for an empty text."""
    if not text:
        return b""
    data = padded(text)
    starts = selected(data, rank)
    out = []
    for at in range(0, starts.size, FULL):
        rows = data[starts[at : at + FULL][:, None] + np.arange(WINDOW)].astype(np.uint64)
        filter_ = np.zeros(FILTER * 8, dtype=np.uint8)
        for mix in _MIX:
            h = (rows * mix).sum(axis=1, dtype=np.uint64)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            filter_[(h >> np.uint64(53)).astype(np.int64)] = 1
        out.append(np.packbits(filter_).tobytes())
    return b"".join(out)


def likeness(a: bytes, b: bytes) -> float:
    """Normalised overlap of two fingerprints, 0 to 1: the mean of the shorter chain's best matches."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(v, dtype=np.uint64).reshape(-1, FILTER // 8) for v in sorted((a, b), key=lambda v: (len(v), v)))
    bits = FILTER * 8
    nx, ny = np.bitwise_count(x).sum(axis=1).astype(np.float64), np.bitwise_count(y).sum(axis=1).astype(np.float64)
    scores = np.zeros(len(x))
    for i in range(len(x)):
        both = np.bitwise_count(x[i][None, :] & y).sum(axis=1)
        most, chance = np.minimum(nx[i], ny), nx[i] * ny / bits
        # A nearly empty filter finds all its bits in a full one easily; what counts is the overlap beyond chance.
        value = np.clip((both - chance) / np.maximum(most - chance, 1.0), 0, 1)
        scores[i] = value.max()
    weight = nx / nx.sum()
    size = min(nx.sum(), ny.sum()) / max(nx.sum(), ny.sum())
    return float(np.clip((scores * weight).sum() * size**0.25, 0, 1))


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS, dtype=np.int64)
    for batch in batches_of(batches, 256):
        for text in batch.column(0):
            if text.is_valid and len(raw := text.as_buffer().to_pybytes()):
                counts += np.bincount(levels(padded(raw)), minlength=LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(counts)], names=["level", "n"])


def ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level by how many windows of all texts have it, the rarest first.

    Levels are counted in each partition and summed; LEVELS rows reach the driver. Levels of windows with hardly any
    variety, like runs of one letter, are put last: they are rare but tell nothing.
    """
    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_level_counts, "level long, n long")
    found = np.zeros(LEVELS, dtype=np.int64)
    for row in counts.groupBy("level").agg(F.sum("n").alias("n")).collect():
        found[row["level"]] = row["n"]
    plain = np.arange(LEVELS) < LEVELS // 3
    order = np.lexsort((np.arange(LEVELS), found, plain))
    rank = np.zeros(LEVELS, dtype=np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """The input's columns and the fingerprint, a text in base64; a column that is called ``name`` already is replaced.

    Null texts count as empty; equal texts have equal fingerprints. Levels are counted over all texts of ``docs``.
    """
    rank = docs.sparkSession.sparkContext.broadcast(ranks(docs))
    rest = [f for f in docs.schema.fields if f.name != name]
    at = docs.columns.index("text")
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            made = [_in_base64(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", rank.value)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(made, pa.string())], names=[*(f.name for f in rest), name])

    return docs.mapInArrow(run, StructType([*rest, StructField(name, StringType())]))


def _in_base64(print_: bytes) -> str:
    return base64.b64encode(print_).decode()


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    """A row of the result for each (doc_id, text, its fingerprint, the next text, its fingerprint, rank)."""
    out = []
    for doc_id, text, own, after, next_, rank in rows:
        cut = len(text) // 3
        edited = (text[: len(text) - cut] + after[:cut]).encode()
        changed = fingerprint(edited, rank)
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), _in_base64(own), _in_base64(changed), likeness(own, changed), likeness(own, next_)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def _within(rank):
    """Results of each range's rows but the last, whose next document is in another range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, range_ = None, None
        for batch in batches_of(batches, 256):
            rows = []
            for part, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(text.encode(), rank.value)
                if held is not None and part == range_:
                    rows.append((*held, text, own, rank.value))
                held, range_ = (doc_id, text, own), part
            yield _result(rows)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: the text of its first row, the id and text of its last one."""

    def told(first: pa.RecordBatch, last: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([first.column(0), first.column(2), last.column(1), last.column(2)], names=["part", "first_text", "doc_id", "text"])

    first = last = None
    for batch in batches:
        parts = batch.column(0).to_numpy()
        for at in np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1)).tolist():
            if at:
                last = batch.slice(at - 1, 1)
            if first is not None and first.column(0)[0].as_py() != parts[at]:
                yield told(first, last)
                first = None
            first = first or batch.slice(at, 1)
        if batch.num_rows:
            last = batch.slice(batch.num_rows - 1)
    if first is not None:
        yield told(first, last)


def _across(rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            prints = [fingerprint(t.encode(), rank.value) for k in (1, 2) for t in batch.column(k).to_pylist()]
            n = batch.num_rows
            yield _result([(i, text, prints[j], after, prints[n + j], rank.value) for j, (i, text, after) in enumerate(rows)])

    return run


def edit_likeness(docs: DataFrame) -> DataFrame:
    """How alike each text's fingerprint is to that of an edited copy, and of the next document.

    Needs doc_id and text; more columns are ignored. The next document is the one with the next lower doc_id, after the
    last the first; the edited copy has the last third of the code points replaced by the first as many of the next.
    Null texts count as empty; rows with equal doc_id follow each other by a hash of their texts; null doc_ids come last. A
    document alone is its own next one. An empty table gives an empty result.

    Rows are dealt out by ranges of doc_id, that hash and a number, so ids may be sparse, and rows that repeat are in many
    ranges. Their bounds are taken once, and each row tells its range, so both uses of the ranges agree however they are planned.
    Besides its own rows, a range needs the first text of the next one, which a row for each range tells.
    """
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(ranks(docs))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    # Ascending by this is descending by doc_id, nulls last.
    rows = rows.withColumn("key", F.struct(F.col("doc_id").isNull(), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), F.xxhash64("text"), F.col("salt")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", _range_of(F.col("key"), _bounds(rows.select("key"), parts)))
    line = rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "key").select("part", "doc_id", "text")
    ends = line.mapInArrow(_ends, "part int, first_text string, doc_id long, text string")
    by_place = Window.orderBy("part")  # as many rows as ranges
    after = F.coalesce(F.lead("first_text").over(by_place), F.first("first_text").over(by_place))
    across = ends.select("doc_id", "text", after.alias("next_text")).mapInArrow(_across(rank), _SCHEMA)
    return line.mapInArrow(_within(rank), _SCHEMA).union(across)


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """Upper bounds of ranges of about equal size, from a sample of some 60 rows a range; only their balance depends on it."""
    share = min(1.0, 60 * parts / max(1, keys.count()))
    found = sorted(tuple(r["key"]) for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000)).collect())
    return [found[i * len(found) // parts] for i in range(1, parts)] if found else []


def _range_of(key: Column, bounds: list[tuple]) -> Column:
    """How many bounds are not over the key: found among groups of them, then in its group."""
    if not bounds:
        return F.lit(0)
    literal = lambda b: F.struct(*[F.lit(v).cast(t) for v, t in zip(b, ("boolean", "long", "long", "long"), strict=True)])
    step = math.isqrt(len(bounds)) + 1
    groups = F.array(*[F.array(*map(literal, bounds[at : at + step])) for at in range(0, len(bounds), step)])
    heads = F.array(*[literal(bounds[at]) for at in range(0, len(bounds), step)])
    group = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(groups, F.greatest(group, F.lit(1))), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside)
