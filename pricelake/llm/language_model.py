"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

A word's chance is a product of three. Leaves are the TOP most frequent words, and GROUPS groups of all others by their
endings. The class of a leaf is drawn by a softmax over sums of weights of hashed features: the leaf before, the leaf two
before (a skip), and the pair of both. Then the leaf, a member of the class, by a feature for each leaf and leaf
before; then the word, for words in a group, by a feature for each word and span of leaves that the one before is in.
Features of the last kind are as many as training has seen, so the model grows with the corpus.

Weights of the classes are trained by STEPS distributed gradient updates over the whole corpus. Their contexts are counted
in one pass over all training texts; a step's tasks hold the contexts that begin with some of the leaves, add up what the
model expects there, and the weights move by seen minus expected, scaled by the expected counts. Of the other
features just one holds for each word, so the gradient is zero at a closed form, (n(feature) + prior * share) /
(n(context) + prior), that needs no steps. Scoring runs over numpy batches of words, of which only the weights of
the features that are present are looked up.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, fold, written

CLASSES, MEMBERS = 48, 32
LEAVES = CLASSES * MEMBERS
GROUPS = 256
TOP = LEAVES - GROUPS
PAIRS = 8192
STEPS, RATE, DAMPING, RIDGE, LONGEST = 8, 0.5, 2.0, 3.0, 1.0
LEAF_PRIOR, WORD_PRIOR = 30.0, 10_000.0
#: Counts of about so many words, the most frequent of at most so many bytes, go to every task; all others are joined.
KNOWN, KNOWN_BYTES = 100_000, 64
#: Tasks of a step.
BANDS = 8
_START = LEAVES  # the leaf before a text
_WIDTH = LEAVES + 1
_SPAN = 96
_SPANS = LEAVES // _SPAN + 1  # spans of a leaf before: those of the leaves, and the start
_CHUNK = 8192
END = b""


def words_of(text: bytes) -> list[bytes]:
    """The tokens of a text: its words in lower case, then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def table() -> pa.RecordBatch:
        words = list(seen)
        columns = [pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([group_of(w) for w in words], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["token", "n", "word_group"])

    for batch in batches_of(batches, 256):
        for text in batch.column(0):
            seen.update(words_of(_bytes(text)))
        if len(seen) > 60_000:
            yield table()
            seen.clear()
    yield table()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, word_group, c) over all texts."""
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counts, "token binary, n long, word_group int")
    return parts.groupBy("token", "word_group").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, most: int = KNOWN) -> list[tuple[bytes, int]]:
    """About the ``most`` most frequent words of at most KNOWN_BYTES bytes with their counts, the most frequent first.

    The least count is read off a table of how many words are in each 16th of a power of two. Of the step that would be
    too many, the words with the smallest hashes are taken, so that some are known however many words are tied.
    """
    short = counts.where(F.length("token") <= KNOWN_BYTES).withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    left, least, share = most, -1, 0
    for r in short.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # under 1,024 rows
        if r["n"] > left:
            least, share = r["step"], left * 1_000_000 // r["n"]
            break
        left -= r["n"]
    some = (F.col("step") == least) & (F.pmod(F.xxhash64("token"), F.lit(1_000_000)) < share)
    found = short.where((F.col("step") > least) | some).select("token", "c").toArrow()
    words = list(zip(found.column("token").to_pylist(), found.column("c").to_pylist(), strict=True))
    return sorted(((bytes(w), c) for w, c in words), key=lambda x: (-x[1], x[0]))


class Words:
    """The most frequent words with their counts, and the leaf of each code: a word's place, or KNOWN and a group."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int):
        frequent = frequent[:KNOWN]
        self.place = {w: i for i, (w, _) in enumerate(frequent)}
        self.count = np.array([c for _, c in frequent] or [0], dtype=np.float64)
        self.group = np.array([group_of(w) for w, _ in frequent], dtype=np.int64)
        self.leaf_of = np.full(KNOWN + GROUPS, TOP, dtype=np.int32)
        self.leaf_of[: len(frequent)] = np.where(np.arange(len(frequent)) < TOP, np.arange(len(frequent)), TOP + self.group)
        self.leaf_of[KNOWN:] = TOP + np.arange(GROUPS)
        self.base = np.log10((self.count + 1) / (total + distinct + 1))


def _encoded(words: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        get, unknown = known.place.get, repeat(-1)
        for batch in batches_of(batches, 32):
            codes, rare, before, times, base, sizes, seen = [], [], [], [], [], [], []
            for cell in batch.column(2):
                text = words_of(_bytes(cell))
                at = np.fromiter(map(get, text, unknown), dtype=np.int32, count=len(text))
                others = np.flatnonzero(at < 0)
                own = [text[i] for i in others.tolist()]
                base.append(known.base[at[at >= 0]].sum())
                at[others] = [KNOWN + group_of(w) for w in own]
                spans = np.concatenate([[_START], known.leaf_of[at]])[others] // _SPAN
                counted = Counter(zip(own, spans.tolist(), strict=True))
                codes.append(at.tobytes())
                rare.append([w for w, _ in counted])
                before.append([k for _, k in counted])
                times.append(list(counted.values()))
                sizes.append(len(text))
                seen.append(len(text) - len(own))
            columns = [
                pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(before, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())),
                pa.array(base, pa.float64()), pa.array(sizes, pa.int64()), pa.array(seen, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "trains", "codes", "rare", "before", "times", "base", "n_tokens", "n_frequent"])

    return run


_ENCODED = "doc_id long, trains boolean, codes binary, rare array<binary>, before array<int>, times array<int>, base double, n_tokens long, n_frequent long"


def pair_rows(one: np.ndarray | int, two: np.ndarray) -> np.ndarray:
    """Rows of the hashed pairs of leaves; no two of a leaf ``one`` share a row."""
    return (one * 40503 + two) % PAIRS


def contexts(leaves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaf before and the leaf two before of each, of texts of ``sizes`` leaves one after another."""
    line = np.full(leaves.size + 2 * sizes.size, _START, dtype=np.int64)
    here = np.arange(leaves.size) + 2 * np.repeat(np.arange(1, sizes.size + 1), sizes)
    line[here] = leaves
    return line[here - 1], line[here - 2]


#: Numbers counted for each leaf before: of leaves two before, and of leaves.
_ROW = _WIDTH + LEAVES
#: And those counted besides: pairs and classes, leaves two before and classes, groups and spans before, known words and spans before.
_SHARED = np.cumsum([0, PAIRS * CLASSES, _WIDTH * CLASSES, GROUPS * _SPANS, KNOWN * _SPANS])


def _gathered(words: Broadcast):
    """Counts of a partition's contexts: rows (chunk, places, counts) of those that aren't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_of = words.value.leaf_of
        rows, shared = np.zeros((_WIDTH, _ROW), dtype=np.int32), np.zeros(_SHARED[-1], dtype=np.int32)
        flat = rows.reshape(-1)
        held: list[np.ndarray] = []
        some = False

        def add() -> None:
            codes = np.concatenate(held)
            leaf = leaf_of[codes].astype(np.int64)
            one, two = contexts(leaf, np.array([h.size for h in held]))
            kind, last = leaf // MEMBERS, one // _SPAN
            for key in (one * _ROW + two, one * _ROW + _WIDTH + leaf):
                found, n = np.unique(key, return_counts=True)
                flat[found] += n.astype(np.int32)
            grouped = codes >= TOP
            group, last = leaf[grouped] - TOP, last[grouped]
            word = np.flatnonzero(codes[grouped] < KNOWN)
            keys = (pair_rows(one, two) * CLASSES + kind, two * CLASSES + kind, group * _SPANS + last, codes[grouped][word] * _SPANS + last[word])
            for start, key in zip(_SHARED, keys, strict=False):
                found, n = np.unique(key, return_counts=True)
                shared[start + found] += n.astype(np.int32)
            held.clear()

        def sparse(chunk: int, numbers: np.ndarray) -> tuple | None:
            found = np.flatnonzero(numbers)
            return (chunk, found.astype(np.int32).tobytes(), numbers[found].tobytes()) if found.size else None

        waiting = 0
        for batch in batches_of(batches, 256):
            for cell in batch.column(0):
                held.append(np.frombuffer(cell.as_buffer(), dtype=np.int32))
                waiting, some = waiting + held[-1].size, True
                if waiting > 200_000:
                    add()
                    waiting = 0
        if held:
            add()
        if not some:
            return
        out = [sparse(one, rows[one]) for one in range(_WIDTH)]
        out += [sparse(_WIDTH + i, shared[i * _CHUNK : (i + 1) * _CHUNK]) for i in range(-(-shared.size // _CHUNK))]
        out = [x for x in out if x]
        for at in range(0, len(out), 256):
            columns = list(zip(*out[at : at + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "places", "counts"])

    return run


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk; one row of all its numbers for each."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "numbers"])

    chunk, total = None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        for now, places, counts in zip(*batch.columns, strict=True):
            if now.as_py() != chunk:
                if chunk is not None:
                    yield row()
                chunk = now.as_py()
                total = np.zeros(_ROW if chunk < _WIDTH else _CHUNK, dtype=np.int64)
            total[np.frombuffer(places.as_buffer(), dtype=np.int32)] += np.frombuffer(counts.as_buffer(), dtype=np.int32)
    if chunk is not None:
        yield row()


def gathered(rows: DataFrame, words: Broadcast) -> tuple[DataFrame, list[np.ndarray]]:
    """The counts of contexts by leaf before, in BANDS files, and those that all leaves share."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sparse = rows.where("trains").select("codes").mapInArrow(_gathered(words), "chunk int, places binary, counts binary")
    sums = written(sparse.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_chunk_sums, "chunk int, numbers binary"))
    shared = np.zeros(-(-_SHARED[-1] // _CHUNK) * _CHUNK, dtype=np.float32)
    found = sums.where(F.col("chunk") >= _WIDTH).toArrow()  # as many numbers as the model has places, whatever the input
    for chunk, numbers in zip(found.column("chunk").to_pylist(), found.column("numbers"), strict=True):
        shared[(chunk - _WIDTH) * _CHUNK :][:_CHUNK] = np.frombuffer(numbers.as_buffer(), dtype=np.int64)
    split = [shared[a:b] for a, b in zip(_SHARED[:-1], _SHARED[1:], strict=True)]
    return written(sums.where(F.col("chunk") < _WIDTH).repartition(BANDS)), split


def _moved(seen: np.ndarray, made: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A step along the gradient, seen minus expected less the ridge's pull, scaled by the expected counts."""
    return (RATE * np.clip((seen - made - RIDGE * weights) / (made + DAMPING), -LONGEST, LONGEST)).astype(np.float32)


class Model:
    """Weights of the classes; biases are the logarithms of the classes' shares of the training tokens."""

    def __init__(self, counts: np.ndarray):
        share = ((counts + 0.5) / (counts.sum() + 0.5 * LEAVES)).reshape(CLASSES, MEMBERS)
        self.bias, self.member = np.log(share.sum(axis=1)).astype(np.float32), (share / share.sum(axis=1, keepdims=True)).ravel()
        self.one, self.two, self.pair = (np.zeros((n, CLASSES), dtype=np.float32) for n in (_WIDTH, _WIDTH, PAIRS))

    def class_weights(self, one: int, two: np.ndarray) -> np.ndarray:
        """exp of the sums of weights of each class, a row for each leaf two before."""
        return np.exp(self.bias + self.one[one] + self.two[two] + self.pair[pair_rows(one, two)])

    def leaf_chances(self, seen: np.ndarray) -> np.ndarray:
        """log10 of each leaf's chance in its class, from the counts of leaves after one leaf."""
        by_class = seen.reshape(CLASSES, MEMBERS).sum(axis=1)
        found = (seen + LEAF_PRIOR * self.member) / np.repeat(by_class + LEAF_PRIOR, MEMBERS)
        return np.log10(found).astype(np.float32)

    def complete(self, leaves: np.ndarray) -> None:
        """Keep the leaves' chances, a row for each leaf before, and a table of the classes' normalisers: chances are then looked up."""
        self.leaves, self.total = leaves, np.empty((_WIDTH, _WIDTH), dtype=np.float32)
        for one in range(_WIDTH):
            self.total[one] = np.log(self.class_weights(one, np.arange(_WIDTH)).sum(axis=1))

    def log10(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        kind = leaf // MEMBERS
        chosen = self.bias[kind] + self.one[one, kind] + self.two[two, kind] + self.pair[pair_rows(one, two), kind] - self.total[one, two]
        return chosen.astype(np.float64) / np.log(10) + self.leaves[one, leaf]


def _expected(shared: Broadcast):
    """A step's sums over the contexts that a task has: what the model expects of each weight, and what was seen of those of the leaf before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        one_seen, one_sum, two_sum, pair_sum = (np.zeros((n, CLASSES)) for n in (_WIDTH, _WIDTH, _WIDTH, PAIRS))
        some = False
        for batch in batches_of(batches, 64):
            for one, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = True
                counts = np.frombuffer(numbers.as_buffer(), dtype=np.int64)
                before = counts[:_WIDTH]
                two = np.flatnonzero(before)
                p = m.class_weights(one, two)
                p *= (before[two] / p.sum(axis=1))[:, None].astype(np.float32)
                one_seen[one] = counts[_WIDTH:].reshape(CLASSES, MEMBERS).sum(axis=1)
                one_sum[one] = p.sum(axis=0)
                two_sum[two] += p
                pair_sum[pair_rows(one, two)] += p
        if some:
            sums = np.concatenate([x.ravel() for x in (one_seen, one_sum, two_sum, pair_sum)])
            yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["part"])

    return run


def _leaf_rows(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 64):
            made = [shared.value.leaf_chances(np.frombuffer(n.as_buffer(), dtype=np.int64)[_WIDTH:]).tobytes() for n in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["one", "chances"])

    return run


def trained(bands: DataFrame, seen_pair: np.ndarray, seen_two: np.ndarray, leaf_counts: np.ndarray, steps: int = STEPS) -> Model:
    """The model after ``steps`` gradient updates, each over all contexts of the corpus."""
    sc, model = bands.sparkSession.sparkContext, Model(leaf_counts)
    seen_pair, seen_two = seen_pair.reshape(PAIRS, CLASSES), seen_two.reshape(_WIDTH, CLASSES)
    for _ in range(steps):
        sent = sc.broadcast(model)
        parts = bands.mapInArrow(_expected(sent), "part binary").toArrow().column("part")  # BANDS rows, each as long as the weights are
        sent.destroy()
        if not len(parts):
            break
        total = np.zeros(3 * model.one.size + model.pair.size)
        for part in parts:
            total += np.frombuffer(part.as_buffer(), dtype=np.float32)
        one_seen, one, two, pair = (x.reshape(-1, CLASSES) for x in np.split(total, np.cumsum([model.one.size, model.one.size, model.two.size])))
        for weights, seen, made in ((model.one, one_seen, one), (model.two, seen_two, two), (model.pair, seen_pair, pair)):
            weights += _moved(seen, made, weights)
    sent = sc.broadcast(model)
    leaves = np.tile(model.leaf_chances(np.zeros(LEAVES)), (_WIDTH, 1))
    found = bands.mapInArrow(_leaf_rows(sent), "one int, chances binary").toArrow()  # as many numbers as the model has places
    sent.destroy()
    for one, row in zip(found.column("one").to_pylist(), found.column("chances"), strict=True):
        leaves[one] = np.frombuffer(row.as_buffer(), dtype=np.float32)
    model.complete(leaves)
    return model


class WordChances:
    """log10 of the chance of a known word of a group, by the span of the leaf before; groups' counts for all other words."""

    def __init__(self, words: Words, mass: np.ndarray, group_counts: np.ndarray, word_counts: np.ndarray):
        n = len(words.place)
        self.least = np.log10(group_counts.reshape(GROUPS, _SPANS) + WORD_PRIOR)
        share = (words.count[:n] + 1) / mass[words.group]
        found = word_counts.reshape(KNOWN, _SPANS)[:n] + (WORD_PRIOR * share)[:, None]
        self.known = (np.log10(found) - self.least[words.group]).astype(np.float32)


def _scores(words: Broadcast, model: Broadcast, chances: Broadcast):
    """The sum over a text's tokens, but for the counts of words that aren't known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_of, m, inside = words.value.leaf_of, model.value, chances.value
        for batch in batches_of(batches, 128):
            texts = [np.frombuffer(v.as_buffer(), dtype=np.int32) for v in batch.column(1)]
            if texts:
                sizes, codes = np.array([t.size for t in texts]), np.concatenate(texts)
                leaf = leaf_of[codes].astype(np.int64)
                one, two = contexts(leaf, sizes)
                value = m.log10(leaf, one, two)
                known = np.flatnonzero((codes >= TOP) & (codes < KNOWN))
                value[known] += inside.known[codes[known], one[known] // _SPAN]
                rare = np.flatnonzero(codes >= KNOWN)
                value[rare] -= inside.least[codes[rare] - KNOWN, one[rare] // _SPAN]
                made = np.add.reduceat(value, np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["row", "model_score"])

    return run


def _rare_parts(rows: DataFrame, total: int, distinct: int, mass: np.ndarray) -> DataFrame:
    """By row: what words that aren't known add to its sums. All of a word's rows meet in one task, which counts it."""
    each = rows.select("row", "trains", F.explode(F.arrays_zip("rare", "before", "times")).alias("r"))
    each = each.select("row", F.col("r.rare").alias("token"), F.col("r.before").alias("k"), F.col("r.times").alias("m"), F.when(F.col("trains"), F.col("r.times")).otherwise(0).alias("learnt"))
    each = each.withColumn("n", F.sum("learnt").over(Window.partitionBy("token", "k")))
    each = each.withColumn("c", F.sum("learnt").over(Window.partitionBy("token")))
    ending = F.when(F.length("token") > 3, F.expr("substring(token, length(token) - 2, 3)")).otherwise(F.col("token"))
    masses = F.array(*[F.lit(float(m)) for m in mass])
    share = (F.col("c") + 1) / masses[F.pmod(F.crc32(ending), F.lit(GROUPS)).cast("int")]
    return each.groupBy("row").agg(
        F.sum(F.col("m") * (F.log10(F.col("c") + 1) - float(np.log10(total + distinct + 1)))).alias("more_base"),
        F.sum(F.col("m") * F.log10(F.col("n") + WORD_PRIOR * share)).alias("more_score"),
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known"),
    )


def scored(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """log10 probabilities of each whole text by a unigram baseline and by the model.

    Needs doc_id and text; more columns are ignored. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Learns from rows whose crc32(doc_id) mod ``folds`` is not ``held_out``; a null doc_id is not
    learnt from and its held_out is null. Null and empty texts have the end token alone. Repeated rows are scored each, and
    count each. Without training tokens every base probability is 1. An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    trains = F.coalesce(F.pmod(fold(), F.lit(folds)) != held_out, F.lit(False))
    counts = written(token_counts(docs.where(trains)))
    groups = counts.groupBy("word_group").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # GROUPS rows at most
    total, distinct = sum(r["c"] for r in groups), sum(r["v"] for r in groups)
    known = Words(frequent_words(counts), total, distinct)
    # A group's mass is that of its words that are no leaves, and one word more for all that training has not seen.
    mass, leaf_counts, top = np.ones(GROUPS), np.zeros(LEAVES), min(TOP, len(known.place))
    leaf_counts[:top] = known.count[:top]
    for r in groups:
        mass[r["word_group"]] += r["c"] + r["v"]
        leaf_counts[TOP + r["word_group"]] += r["c"]
    np.subtract.at(mass, known.group[:top], known.count[:top] + 1)
    np.subtract.at(leaf_counts, TOP + known.group[:top], known.count[:top])

    words = sc.broadcast(known)
    rows = docs.select("doc_id", trains.alias("trains"), F.col("text").cast("binary").alias("text")).mapInArrow(_encoded(words), _ENCODED)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    bands, shared = gathered(rows, words)
    chances = sc.broadcast(WordChances(known, mass, shared[2], shared[3]))
    model = trained(bands, shared[0], shared[1], leaf_counts)
    sums = rows.select("row", "codes").mapInArrow(_scores(words, sc.broadcast(model), chances), "row long, model_score double")
    out = rows.select("row", "doc_id", "n_tokens", "n_frequent", "base").join(written(sums), "row").join(_rare_parts(rows, total, distinct, mass), "row", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id",
        (F.pmod(fold(), F.lit(folds)) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_frequent") + more("more_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base")).alias("base_score"),
        (F.col("model_score") + more("more_score")).alias("score"),
    )
