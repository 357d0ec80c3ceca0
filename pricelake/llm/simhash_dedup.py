"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared as vertical bit planes.

Fingerprints that differ in at most r bits agree on all but r of k blocks of bits, so some choice of k-r blocks is equal
in both: those choices are the exact candidate keys. Within a key, fingerprints are stored vertically, 64 to a machine
word and plane. A query's distances to the 64 lanes of a block are counted together by carry-save counters, one
XOR, AND and OR per plane; a block is abandoned as soon as each of its lanes is over the radius.

Only distinct fingerprints are compared. A key with more of them than a tile holds is split into tiles, each pair
of tiles a group of its own, so a hot key is spread over many tasks; a task returns a spanning forest, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, one_of_each, written
from .components import connected_components, forest

TILE = 4096
_PAIRS = 1 << 16
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text: a bit is set if it is in over half the shingles' XXH64; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return print_of(np.fromiter((digest(s, 42) for s in shingles), dtype="<u8"))


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes: a bit is set if it is in over half of them; 0 for none."""
    hashes = hashes.astype("<u8", copy=False)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2048):
            made = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null texts count as empty."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def planes_of(prints: np.ndarray, place: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes [64, blocks] of fingerprints put at lanes ``place``, 64 to a block, and each block's lanes in use."""
    padded, used = np.zeros(blocks * 64, dtype="<u8"), np.zeros(blocks * 64, dtype=np.uint8)
    padded[place], used[place] = prints, 1
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T.reshape(64, blocks, 64), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    return planes, np.packbits(used.reshape(blocks, 64), axis=1, bitorder="little").view("<u8")[:, 0]


def within_radius(queries: np.ndarray, planes: np.ndarray, used: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """Of (query, block) pairs those with a lane within ``radius``: query, block and the word of such lanes."""
    counters = [np.zeros(query.size, dtype=np.uint64) for _ in range(max(1, (radius + 1).bit_length()))]
    over = np.zeros(query.size, dtype=np.uint64)
    for k in range(64):
        wanted = np.where((queries >> np.uint64(k)) & np.uint64(1), _ONES, np.uint64(0))
        carry = planes[k][block] ^ wanted[query]
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        more = carry
        above = np.full(query.size, _ONES)
        for i in reversed(range(len(counters))):
            if (radius + 1) >> i & 1:
                above &= counters[i]
            else:
                more = more | (above & counters[i])
        over |= more | above
        if k % 4 == 3:
            alive = (over | ~used[block]) != _ONES
            if not alive.all():
                query, block, over = query[alive], block[alive], over[alive]
                counters = [c[alive] for c in counters]
        if not query.size:
            break
    return query, block, ~over & used[block]


def linked_rows(prints: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Labels that join the rows of a group that are within ``radius``; ``group`` is ascending from 0.

    Rows of side 0 are only queries, of side 1 only lanes, of side 2 both. Each group has blocks of its own, and all
    (query, block) pairs of all groups are compared together.
    """
    label = np.arange(prints.size)
    groups = int(group[-1]) + 1 if group.size else 0
    lanes, asks = np.flatnonzero(side != 0), np.flatnonzero(side != 1)
    sizes = np.bincount(group[lanes], minlength=groups)
    blocks = -(-sizes // 64)
    first_block, first_lane = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
    place = first_block[group[lanes]] * 64 + np.arange(lanes.size) - first_lane[group[lanes]]
    if not lanes.size or not asks.size:
        return label
    planes, used = planes_of(prints[lanes], place, int(blocks.sum()))
    row_at = np.zeros(used.size * 64, dtype=np.int64)
    row_at[place] = lanes
    each = blocks[group[asks]]
    ends = np.cumsum(each)
    at = 0
    while at < asks.size:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
        own, n = asks[at:to], each[at:to]
        q = np.repeat(np.arange(own.size), n)
        b = first_block[group[own]][q] + np.arange(q.size) - np.repeat(np.cumsum(n) - n, n)
        q, b, hit = within_radius(prints[own], planes, used, q, b, radius)
        bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        label = forest(prints.size, own[q[i]], row_at[b[i] * 64 + lane], label)
        at = to
    return label


def _edges(radius: int):
    """Rows come sorted by group; a group is compared when its last row is seen."""

    def made(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[False], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])[: len(rows)]
        label = linked_rows(rows[:, 5].astype(np.int64).view(np.uint64), np.cumsum(starts), rows[:, 4], radius)
        apart = np.flatnonzero(label != np.arange(label.size))
        return pa.RecordBatch.from_arrays([pa.array(rows[apart, 5]), pa.array(rows[label[apart], 5])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 6), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
                last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1]) + 1 if (rows[0, :4] != rows[-1, :4]).any() else 0
                rest = rows[last:]
                yield made(rows[:last])
        yield made(rest)

    return run


def _block_keys(fp, blocks: int, radius: int):
    """A struct (choice, key) for each choice of blocks - radius of the blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).cast("long").alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*out)


def components_of(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(fp, group, component) of distinct fingerprints; ``prints`` has doc_id and fp.

    group is the smallest fingerprint reachable, and component the smallest doc_id, null if all there are null.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(linked(distinct, radius, tile))
    rooted = written(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    least = rooted.groupBy("group").agg(F.min("rep").alias("component"))
    return rooted.select("fp", "group").join(least, "group").select("fp", "group", "component")


def linked(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): a forest, task by task, of the fingerprints within ``radius`` bits of each other; ``distinct`` is a written table of fp."""
    n = distinct.count()
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > 64:  # longer keys, and more of them, for more fingerprints
        blocks += 1
    keyed = distinct.select("fp", F.explode(_block_keys(F.col("fp"), blocks, radius)).alias("k")).select("k.choice", "k.key", "fp")
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("m")).where("m > 1")
    rows = keyed.join(sizes, ["choice", "key"]).withColumn("tiles", F.ceil(F.col("m") / tile).cast("long"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    rows = rows.select("choice", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "fp")
    group = ["choice", "key", "lo", "hi"]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """Group documents whose fingerprints are linked by steps of at most ``radius`` differing bits.

    Needs doc_id and text; other columns are ignored. Returns doc_id, fingerprint (16 hex digits), component_id and
    kept (doc_id = component_id) for each row. Null and empty texts, and texts of white space, have fingerprint zero
    and link like any other; texts of fewer words than a shingle count as one shingle. Repeated rows are in one group.
    A null doc_id gets a component only from its group, and links others like any row. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, width))
    groups = components_of(prints, radius)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    out = prints.join(groups, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The documents of which one stays for each group: that with the smallest doc_id, once.

    Groups are of fingerprints, whatever the ids: of a group with null ids alone one document stays, and unlike texts
    that share an id are each in their own group.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"))  # so that columns of any name are kept
    rows = written(packed.withColumn("_row", F.monotonically_increasing_id()))
    numbered = rows.select(F.col("_row").alias("doc_id"), F.col("doc.text").cast("binary").alias("text"))
    prints = written(numbered.mapInArrow(_fingerprints(width), "doc_id long, fp long").select(F.col("doc_id").alias("_row"), "fp"))
    ids = prints.join(rows.select("_row", F.col("doc.doc_id").alias("doc_id")), "_row").select("doc_id", "fp")
    groups = prints.join(components_of(ids, radius).select("fp", "group"), "fp").select("_row", F.col("group").alias("_group"))
    return one_of_each(rows.join(groups, "_row"), F.col("_group"))
