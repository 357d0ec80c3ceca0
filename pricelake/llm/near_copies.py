"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash bands name candidates, exact sets decide.

Texts with equal sets of shingles are one node. Nodes whose SimHash fingerprints differ in at most RADIUS bits are
candidates, found by the bit planes of ``simhash_dedup``. At a similarity of 0.8 fingerprints are some ten bits apart, which no
block keys reach, so MinHash names the others: a node's BANDS keys are each of ROWS minimum hashes; two nodes of
similarity s share a key with a chance of 1 - (1 - s^ROWS)^BANDS, which is 1 - 5e-8 at 0.8. Only the sets
themselves, made anew from the texts of the candidates, say whether two are near copies.

A key with m nodes has m^2 pairs, so first each node is compared with the key's smallest. Keys whose nodes are then in one
component are done; in all others every pair is compared, in tiles that return a spanning forest and not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import batches_of, written
from .components import connected_components, forest
from .simhash_dedup import linked, print_of

BANDS, ROWS = 32, 4
#: Bits in which the fingerprints of SimHash candidates differ at most.
RADIUS = 3
#: A task compares at most so many nodes with as many, over so many shingles at once.
TILE, _COLUMNS = 512, 4096
_PER_HUB = 500
_random = np.random.default_rng(11)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct XXH64 of a text's runs of ``width`` words, ascending; fewer words are one run, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.array(sorted({xxhash.xxh64_intdigest(r, 42) for r in runs}), dtype=np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A hash for each band of the minimum hashes of a set, as signed longs."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, own.size, 1024):
        mixed = (own[None, at : at + 1024] * _FACTORS[:, None] + _TERMS[:, None]) >> np.uint64(32)
        np.minimum(low, mixed.min(axis=1).astype(np.uint32), out=low)
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def alike(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    both = np.intersect1d(left, right, assume_unique=True).size
    return both >= similarity * (left.size + right.size - both) - 1e-9


def alike_pairs(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets that reach ``similarity``; sets of side 0 are only compared with sets of side 1, those of side 2 with each other."""
    sizes = np.array([s.size for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(times.size, -1)
    place[shared] = np.arange(shared.size)
    row, column = row[place[column] >= 0], place[column][place[column] >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, shared.size, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        has = np.zeros((len(sets), min(_COLUMNS, shared.size - at)), dtype=np.float32)
        has[row[a:b], column[a:b] - at] = 1
        both += has @ has.T
    fits = both >= similarity * (sizes[:, None] + sizes[None, :] - both.astype(np.float64)) - 1e-9
    fits &= (side[:, None] == 2) | (side[:, None] != side[None, :])
    return np.nonzero(np.triu(fits, 1))


def _nodes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            nodes, keys, prints = [], [], []
            for text in batch.column(0).field("text"):
                own = shingles(_bytes(text), width)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                keys.append(band_keys(own))
                prints.append(print_of(own))
            every = pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64))
            starts = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            columns = [*batch.columns, pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(starts, every), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_node", "_keys", "_print"])

    return run


def _verified(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches_of(batches, 256):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (hub, node) in enumerate(zip(a, b, strict=True)):
                if len(known) > 200:
                    known.clear()
                for k, column in ((hub, 2), (node, 3)):
                    if k not in known:
                        known[k] = shingles(_bytes(batch.column(column)[i]), width)
                keep[i] = alike(known[hub], known[node], similarity)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _tiles_linked(width: int, similarity: float):
    """Rows come sorted by group; a group is compared when its last row is seen."""

    def made(held: list[tuple]) -> pa.RecordBatch:
        nodes = np.array([h[0] for h in held], dtype=np.int64)
        left, right = alike_pairs([h[2] for h in held], np.array([h[1] for h in held]), similarity)
        label = forest(nodes.size, left, right)
        apart = np.flatnonzero(label != np.arange(label.size))
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[label[apart]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches_of(batches, 256):
            for key, lo, hi, side, node, text in zip(*batch.columns, strict=True):
                now = (key.as_py(), lo.as_py(), hi.as_py())
                if held and now != group:
                    yield made(held)
                    held = []
                group = now
                held.append((node.as_py(), side.as_py(), shingles(_bytes(text), width)))
        if held:
            yield made(held)

    return run


def simhash_candidates(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hub, node): nodes of one fingerprint with the smallest of them, and those of fingerprints that ``linked`` names; ``nodes`` has node and print."""
    hubs = written(nodes.groupBy(F.col("print").alias("fp")).agg(F.min("node").alias("hub")))
    same = nodes.join(hubs.hint("merge"), F.col("print") == F.col("fp")).select("hub", "node").where("hub <> node")
    end = lambda name: hubs.select(F.col("fp").alias(name), F.col("hub").alias(f"{name}_hub")).hint("merge")
    near = linked(hubs, radius).join(end("a"), "a").join(end("b"), "b").select(F.least("a_hub", "b_hub").alias("hub"), F.greatest("a_hub", "b_hub").alias("node"))
    return same.union(near)


def components(rows: DataFrame, width: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(node, component) of the nodes that have a near copy; ``rows`` is a written table with _node, _keys, text, and a _row of its own for each row (given here if there is none).

    With a column _print, the nodes' fingerprints, they name candidates too.

    Texts cross the network for nodes that share a key alone. The tables joined here grow with the input, and what Parquet
    or a shuffle says of their size is compressed, so each is merged and none is left to an automatic broadcast.
    """
    if "_row" not in rows.columns:
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    nodes = written(rows.groupBy("_node").agg(F.min("_row").alias("_row"), *[F.first(c).alias(c) for c in ("_keys", "_print") if c in rows.columns]))  # equal sets have equal keys and fingerprints
    keyed = nodes.select(F.col("_node").alias("node"), F.explode("_keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub")).where("m > 1")
    members = written(keyed.join(buckets.hint("merge"), "key"))
    star, wanted = members.where("node <> hub").select("hub", "node"), members.select("node")
    if "_print" in rows.columns:
        near = written(simhash_candidates(nodes.select(F.col("_node").alias("node"), F.col("_print").alias("print"))))
        star, wanted = star.union(near), wanted.union(near.select("hub")).union(near.select("node"))
    wanted = nodes.select(F.col("_node").alias("node"), "_row").join(wanted.distinct().hint("merge"), "node", "left_semi")
    texts = written(rows.select("_row", "text").join(wanted.hint("merge"), "_row").select("node", "text"))
    star = star.distinct()
    # A hub with many nodes is dealt to a task for each _PER_HUB of them.
    parts = star.groupBy("hub").agg(F.ceil(F.count("*") / _PER_HUB).cast("long").alias("parts"))
    hubs = parts.join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")).hint("merge"), "hub")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    star = star.join(parts.hint("merge"), "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    pairs = star.join(hubs.hint("merge"), ["hub", "part"]).join(texts.hint("merge"), "node").select("hub", "node", "hub_text", "text")
    edges = written(pairs.mapInArrow(_verified(width, similarity), "hub long, node long").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    found = written(connected_components(edges))

    # Keys with nodes in several components; of keys with the same nodes one is enough.
    members = members.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    same = [F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor("node").alias("xor")]
    open_ = members.groupBy("key").agg(*same, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_ = open_.groupBy("m", "sum", "xor").agg(F.min("key").alias("key")).select("key", "m")
    tiles = members.select("key", "node").join(open_.hint("merge"), "key").withColumn("tiles", F.ceil(F.col("m") / tile).cast("long"))
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    tiles = tiles.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "node")
    tiles = tiles.join(texts.hint("merge"), "node").select("key", "lo", "hi", "side", "node", "text")
    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["key", "lo", "hi"]
    more = written(tiles.repartition(count, *group).sortWithinPartitions(*group).mapInArrow(_tiles_linked(width, similarity), "a long, b long"))
    if more.isEmpty():
        return found
    return connected_components(found.toDF("a", "b").union(more))  # the stars that are found stand for their edges


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents of which one stays for each group of near copies: that with the smallest doc_id.

    Documents are grouped by steps between texts whose shingles of ``width`` words have a Jaccard similarity of
    ``similarity`` or more, whatever their ids. Null and empty texts, and texts of white space, have no shingles and are one
    group; texts of fewer words than a shingle are one shingle. Of a group with null ids alone one document stays too;
    null ids come last, and ids that repeat with unlike texts are documents of their own.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"))  # so that columns of any name are kept
    schema = StructType([*packed.schema.fields, StructField("_node", LongType()), StructField("_keys", ArrayType(LongType())), StructField("_print", LongType())])
    rows = written(packed.mapInArrow(_nodes(width), schema).withColumn("_row", F.monotonically_increasing_id()))
    groups = components(rows.select("_node", "_keys", "_print", "_row", F.col("doc.text").alias("text")), width, similarity)
    groups = groups.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    # Who stays is decided on ids and hashes; whole documents are shuffled once, by the number of their row.
    doc_id = F.col("doc.doc_id")
    order = F.struct(doc_id.isNull().alias("null"), doc_id.alias("id"), F.xxhash64("doc").alias("content"), F.col("_row").alias("row"))
    firsts = rows.select("_node", order.alias("first")).groupBy("_node").agg(F.min("first").alias("first"))
    firsts = firsts.join(groups.hint("merge"), "_node", "left").groupBy(F.coalesce("_component", "_node").alias("_group")).agg(F.min("first").alias("first"))
    kept = firsts.select(F.col("first.row").alias("_row"))
    return rows.select("doc", "_row").join(kept.hint("merge"), "_row", "left_semi").select("doc.*")
