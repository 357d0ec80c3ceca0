"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in a shuffled order that depends on their ids alone, form a line of words that is walked at
most twice and cut into blocks, which have the same number of words in all sources. Slot i of the schedule gets the
point i*phi mod 1, which falls into one source's share of the cumulative targets; the k-th slot of a source takes its
k-th block. How many slots a source is dealt says how much of it the mix takes, and any stretch of the schedule has
nearly the target mix. Only a source that is dealt less or more than its target by over NEAR of it (small sources are,
as their targets are few blocks) gets slots after the others, or is cut within a block, to meet it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running_sum, written

#: The golden ratio's fractional part.
GOLDEN = (math.sqrt(5) - 1) / 2
#: Words of a block; there are at least so many blocks, which are smaller for small corpora.
BLOCK_WORDS, LEAST_BLOCKS = 65_536, 16_384
#: The share of its target by which what a source is dealt may differ from it.
NEAR = 0.005
#: The sources' totals come to the driver, so their number is checked.
MOST_SOURCES = 1_000_000
#: Slots of the schedule that are numbered together.
_STRETCH = 50_000


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is above is shared again by weight."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if rest * weights[i] / weight >= most * sizes[i]}
        if not full:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in full:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in full)
        free -= full
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(t.as_buffer().to_pybytes().split()) if t.is_valid else 0 for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "size"])


def _scheduled(ends, golden: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.modf(batch.column(0).to_numpy() * golden)[0] * ends.value[-1]
            number = np.minimum(np.searchsorted(ends.value, at, side="right"), len(ends.value) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int64))], names=["slot", "number"])

    return run


def _shuffled(seed: int) -> Column:
    """A text that puts rows in a random order which depends on their ids alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, seed: int = 7, golden: float = GOLDEN) -> tuple[DataFrame, DataFrame]:
    """The documents with their places, and the pieces that the mix takes, each with its slot.

    Needs doc_id, text and source, and keeps ``row`` if there is one; more columns are ignored. The first: doc_id, source,
    row, size (words), source_size, target, number (of the source), begin (its place in its source's line). The second:
    number, begin, lap (0 or 1), slot, words. Sources are taken in code point order, null last, with the weights in
    turn. Null and empty texts have no words and are never taken. Rows that repeat have places of their own. Empty
    tables, and tables without words, give no pieces. Reruns agree.
    """
    spark = docs.sparkSession
    row = F.col("row") if "row" in docs.columns else F.lit(0).cast("long").alias("row")
    rows = docs.select(F.col("text").cast("binary").alias("text"), "doc_id", "source", F.xxhash64("text").alias("content"), row)
    rows = written(rows.mapInArrow(_sizes, "doc_id long, source string, content long, row long, size long"))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total * sum(sizes))
    words = [min(2 * s, math.floor(g + 0.5)) for s, g in zip(sizes, goals, strict=True)]

    block = max(1, min(BLOCK_WORDS, -(-sum(words) // LEAST_BLOCKS)))
    slots = -(-sum(words) // block)
    ends = spark.sparkContext.broadcast(np.cumsum(np.array(words or [0], dtype=np.float64)))
    schedule = spark.range(slots).mapInArrow(_scheduled(ends, golden), "slot long, number long")
    schedule = written(running_sum(schedule, ["number"], [F.col("slot")], F.lit(1), F.floor(F.col("slot") / _STRETCH), max(1, -(-slots // _STRETCH)), "rank"))
    got = {r["number"]: r["n"] for r in schedule.groupBy("number").agg(F.count("*").alias("n")).collect()}
    table, late = [], []
    for i, r in enumerate(found):
        dealt = got.get(i, 0) * block
        near = dealt <= 2 * sizes[i] and abs(dealt - words[i]) <= NEAR * words[i]
        take = dealt if near else words[i]
        late += [(i, k) for k in range(got.get(i, 0), -(-take // block))]
        table.append((r["source"], i, sizes[i], float(goals[i]), take, max(1, math.isqrt(r["docs"]))))
    if late:  # one after another: the first of each source, then the second of each
        late.sort(key=lambda x: (x[1] - got.get(x[0], 0), x[0]))
        more = [(slots + j, i, k) for j, (i, k) in enumerate(late)]
        schedule = schedule.select("slot", "number", "rank").union(spark.createDataFrame(more, "slot long, number long, rank long"))
    sources = spark.createDataFrame(table, "source_name string, number long, source_size long, target double, take long, buckets long")

    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name").withColumn("key", _shuffled(seed))
    # Buckets of neighbours in the order, as many as a bucket has rows: a source with a third of all rows is in many tasks.
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("bucket", F.shiftright(high * F.col("buckets"), 32))
    inside = Window.partitionBy("number", "bucket").orderBy("key", "doc_id", "content", "row").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("number", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("number", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["number", "bucket"])
    placed = written(placed.withColumn("begin", (F.col("base") + F.col("inner")).cast("long")).drop("key", "bucket", "buckets", "base", "inner", "content"))

    laps = placed.where("size > 0").withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<int>")))
    laps = laps.withColumn("from", F.col("begin") + F.col("lap") * F.col("source_size")).where("from < take")
    laps = laps.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
    blocks = laps.withColumn("rank", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
    part = F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)
    taken = blocks.withColumn("words", part).join(schedule.select("number", "rank", "slot"), ["number", "rank"])
    return placed.drop("take"), taken.select("number", "begin", "lap", "slot", "words")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, and first_slot (null if it isn't taken); see ``mixture``."""
    placed, pieces = mixture(docs.select("doc_id", "text", "source"), **options)
    sums = pieces.groupBy(F.col("number").alias("n"), F.col("begin").alias("b")).agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"))
    on = (F.col("number") == F.col("n")) & (F.col("begin") == F.col("b")) & (F.col("size") > 0)
    return placed.join(sums, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame, with_slot: bool = False, **options) -> DataFrame:
    """The documents of the mix, with their own columns: one row for each lap that takes words of one.

    A document that the mix takes in part is cut after the last word taken. Each file or partition is in the order of
    the schedule, by the slot of a row's first word; ``with_slot`` adds it as _slot, to sort by. Rows that repeat are taken
    each by itself. Columns of any name are kept as they are, and n_chars, if there is one, follows the text.
    """
    rows = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    placed, pieces = mixture(rows.select("doc.doc_id", "doc.text", "doc.source", "row"), **options)
    laps = pieces.groupBy("number", "begin", "lap").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    laps = laps.join(placed.where("size > 0").select("number", "begin", "row", "size"), ["number", "begin"]).select("row", "lap", "words", "slot", "size")
    rows = rows.join(laps, "row").sortWithinPartitions("slot", "lap")
    parts = F.split("doc.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    head = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("doc.text"))
    out = []
    for field in docs.schema.fields:
        own = {"text": text, "n_chars": F.length(text).cast(field.dataType)}.get(field.name, F.col("doc").getField(field.name))
        out.append(own.alias(field.name))
    return rows.select(*out, *([F.col("slot").alias("_slot")] if with_slot else []))
