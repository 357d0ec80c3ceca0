"""Linking the same product across retailers: barcodes, text and vector similarity, decisions, review."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.codes import jaccard, normalize_barcode, trigrams
from ..functions.text import is_generic_brand, normalize_unit, remove_diacritics
from ..session import scratch_folder
from ..sources.workbooks import file_system

# Thresholds, and how much an item's data are worth as its product's.
LEAST_NAME_JACCARD, LEAST_TRIGRAM, MOST_TRIGRAM = 0.3, 0.1, 200
AUTO_LINK, REVIEW, KEPT = 0.95, 0.80, 5
WORTH = {"image": 100, "brand": 5, "category": 3}


def unlinked(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items without a product."""
    return items.join(links.select("item_id"), "item_id", "left_anti")


def unmatched(items: DataFrame, links: DataFrame, queue: DataFrame) -> DataFrame:
    """Items without a product that wait in no queue."""
    return unlinked(items, links).join(queue.where("status = 'pending'").select("item_id"), "item_id", "left_anti")


def barcode_groups(items: DataFrame) -> DataFrame:
    """Items by normalised barcode; codes that identify nothing are left out."""
    return items.withColumn("code", normalize_barcode(F.col("barcode"))).where("code <> ''")


def barcode_counts(items: DataFrame) -> DataFrame:
    """One row: items, those whose code identifies something, those left out, and different codes."""
    code = normalize_barcode(F.col("barcode"))
    has = F.coalesce(code != "", F.lit(False))
    return items.agg(F.count("*").alias("items"), F.count_if(has).alias("coded"), F.count_if(~has).alias("skipped"), F.countDistinct(F.when(has, code)).alias("codes"))


def barcode_sanity(grouped: DataFrame) -> DataFrame:
    """Whether the items of a barcode can be one product: names like the first's, one brand, one unit."""
    anchors = grouped.groupBy("code").agg(F.min_by("name", "item_id").alias("_anchor"))  # before the shuffle, so a hot code is a row for each task
    brand = F.when(~is_generic_brand(F.col("brand")), F.lower(F.trim("brand")))
    rows = grouped.join(anchors, "code").withColumn("_like", jaccard(F.lower("name"), F.lower("_anchor")))
    units = F.collect_set(normalize_unit(F.col("unit"), F.col("unit_quantity")))
    sums = rows.groupBy("code").agg(F.count("*").alias("n_items"), F.min("_like").alias("least"), F.size(F.collect_set(brand)).alias("brands"), F.size(units).alias("units"))
    reason = (
        F.when(F.col("n_items") == 1, "ok").when(F.col("least") < LEAST_NAME_JACCARD, "name_mismatch")
        .when(F.col("brands") > 1, "brand_conflict").when(F.col("units") > 1, "unit_mismatch").otherwise("ok")
    )
    return sums.select("code", "n_items", reason.alias("sanity"))


def canonical_items(grouped: DataFrame, preference: Column) -> DataFrame:
    """The item of each barcode whose data are worth most: image, chain preference, brand, category; ties by id."""
    worth = (
        F.when(F.col("image_url").isNotNull() & (F.col("image_url") != ""), WORTH["image"]).otherwise(0) + preference
        + F.when(~is_generic_brand(F.col("brand")), WORTH["brand"]).otherwise(0) + F.when(F.coalesce("category", F.lit("")) != "", WORTH["category"]).otherwise(0)
    )
    return grouped.groupBy("code").agg(F.min(F.struct((-worth).alias("w"), F.col("item_id"))).alias("b")).select("code", F.col("b.item_id").alias("item_id"))


def barcode_outcomes(sanity: DataFrame, known: DataFrame) -> DataFrame:
    """What to do with each barcode: link to its known product, queue for review, or create a product."""
    joined = sanity.join(known.select("code", "product_id"), "code", "left")
    outcome = F.when(F.col("product_id").isNotNull(), "link").when(F.col("sanity") != "ok", "queue").otherwise("create")
    return joined.select("code", "n_items", "sanity", outcome.alias("outcome"))


#: Texts of a block on either side of a trigram search, and left texts whose matches are looked at at once.
LEFT_BLOCK, RIGHT_BLOCK, ROWS = 2048, 8192, 128

_BLOCK = "ids binary, sizes binary, grams binary, starts binary, owners binary"


def _by_gram(grams: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Of a block: the sizes of its sets, its different grams, where the texts of each begin (and the last ends), and those texts."""
    sizes = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    flat = grams.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    flat, owners = flat[order], np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)[order]
    starts = np.append(0, np.flatnonzero(np.diff(flat)) + 1)
    return sizes, flat[starts], np.append(starts, flat.size).astype(np.int32), owners


def _blocks(size: int, slack: int, made: Callable) -> Callable:
    """What ``made`` yields for each block (ids, grams) of ``size`` rows, or ``slack`` more if that many end a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > size + slack:
                yield from made(*(c.combine_chunks() for c in held.slice(0, size).columns))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield from made(*(c.combine_chunks() for c in held.columns))

    return run


def _written_block(ids: pa.Array, grams: pa.ListArray) -> Iterator[pa.RecordBatch]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("b", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], names=["b"]))
    row = [sink.getvalue().to_pybytes(), *(x.tobytes() for x in _by_gram(grams))]
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "sizes", "grams", "starts", "owners"])


def _read_blocks(folder: str, columns: list[str]) -> Iterator[list[bytes]]:
    """The blocks of a folder in the order of their ids."""
    system, path = file_system(folder)
    part = re.compile(r"part-(\d+)")
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if part.match(f.base_name)]
    for file in sorted(files, key=lambda f: int(part.match(f.rsplit("/", 1)[-1])[1])):
        with system.open_input_file(file) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(1, columns=columns):
                yield [batch.column(c)[0].as_buffer() for c in columns]


def _shared(left: tuple, right: tuple) -> np.ndarray:
    """How many grams each left text shares with each right one: common grams by a product of matrices, the others text by text."""
    (sizes, grams, starts, owners), (r_sizes, r_grams, r_starts, r_owners) = left, right
    _, i, j = np.intersect1d(grams, r_grams, assume_unique=True, return_indices=True)
    pairs = (starts[i + 1] - starts[i]).astype(np.int64) * (r_starts[j + 1] - r_starts[j])
    dense = pairs * 1e-8 + 3e-5 > sizes.size * r_sizes.size * 4e-11  # seconds, about
    ones, r_ones = np.zeros((sizes.size, dense.sum()), np.float32), np.zeros((dense.sum(), r_sizes.size), np.float32)
    for at, (g, h) in enumerate(zip(i[dense], j[dense], strict=True)):
        ones[owners[starts[g] : starts[g + 1]], at] = 1
        r_ones[at, r_owners[r_starts[h] : r_starts[h + 1]]] = 1
    common = ones @ r_ones
    for g, h in zip(i[~dense].tolist(), j[~dense].tolist(), strict=True):
        common[owners[starts[g] : starts[g + 1], None], r_owners[r_starts[h] : r_starts[h + 1]]] += 1
    return common


def _search(folder: str, least: float, most: int) -> Callable:
    """The best matches of a block of left texts among all right blocks, which are read one after another.

    Blocks come in the order of ids, so of equal matches those that are held come first, and a text that has ``most`` takes only better ones.
    """

    def run(ids: pa.Array, grams: pa.ListArray) -> Iterator[pa.RecordBatch]:
        left = _by_gram(grams)
        sizes, n = left[0].astype(np.int64), len(ids)
        over = np.full(n, least)  # what a match must exceed
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * -(-n // ROWS)  # text, similarity, place of the match
        base = 0
        for block in _read_blocks(folder, ["sizes", "grams", "starts", "owners"]):
            right = tuple(np.frombuffer(x, t) for x, t in zip(block, (np.int32, np.int64, np.int32, np.int32), strict=True))
            common, r_sizes = _shared(left, right), right[0].astype(np.int64)
            for k in range(len(held)):
                first = k * ROWS
                part, own, limit = common[first : first + ROWS], sizes[first : first + ROWS], over[first : first + ROWS]
                share = (limit / (1 + limit))[:, None]
                bound = (share * own[:, None]).astype(np.float32) + share.astype(np.float32) * r_sizes.astype(np.float32)
                hit = part > bound * np.float32(1 - 1e-5) - np.float32(1e-3)  # a little less than it, for the rounding; exact below
                if np.count_nonzero(hit) > 4 * most * len(own):  # most of them don't count: the limit is raised first
                    alike = part.astype(np.float64) / (own[:, None] + r_sizes - part)
                    if most < r_sizes.size:
                        hit &= alike >= np.partition(alike, r_sizes.size - most, axis=1)[:, r_sizes.size - most, None]
                row, match = np.nonzero(hit)
                shared = part[row, match].astype(np.float64)
                alike = shared / (own[row] + r_sizes[match] - shared)
                kept = alike > limit[row]
                if not kept.any():
                    continue
                row, alike, match = (np.concatenate(x) for x in zip(held[k], (row[kept], alike[kept], match[kept] + base), strict=True))
                order = np.lexsort((match, -alike, row))
                row, alike, match = row[order], alike[order], match[order]
                rank = np.arange(row.size) - np.searchsorted(row, row)
                last = rank == most - 1
                over[first + row[last]] = alike[last]
                held[k] = tuple(x[rank < most] for x in (row, alike, match))
            base += r_sizes.size
        row = np.concatenate([h[0] + k * ROWS for k, h in enumerate(held)])
        alike, match = (np.concatenate([h[c] for h in held]) for c in (1, 2))
        rank = np.arange(row.size) - np.searchsorted(row, row) + 1
        names, order, base = [], [], 0
        for (block,) in _read_blocks(folder, ["ids"]):
            b = pa.ipc.open_stream(block).read_all().column("b").combine_chunks()
            at = np.flatnonzero((match >= base) & (match < base + len(b)))
            names.append(b.take(pa.array(match[at] - base)))
            order.append(at)
            base += len(b)
        if row.size:
            back = np.argsort(np.concatenate(order), kind="stable")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.concat_arrays(names).take(pa.array(back)), pa.array(alike), pa.array(rank)], names=["a", "b", "similarity", "rank"])

    return run


def trigram_matches(left: DataFrame, right: DataFrame, least: float = LEAST_TRIGRAM, most: int = MOST_TRIGRAM) -> DataFrame:
    """Pairs of texts (id, text) whose trigram sets are more alike than ``least``, the ``most`` best of each left one.

    With c shared of a and b, the similarity is c / (a + b - c). The left texts are a set of queries that meets all right ones block by
    block. The right blocks, by gram and in the order of their ids, are written to the shared folder once, in a path that pyarrow reads;
    a task has a block of left texts and one of right ones at a time, and holds ``most`` matches of each left text, so no pair is a row before
    it counts and nothing is shuffled for each pair of blocks. Texts without trigrams match nothing; ids are unique.
    """
    n_left, n_right = left.count(), right.count()
    spark = left.sparkSession
    parts = max(-(-n_left // LEFT_BLOCK), min(spark.sparkContext.defaultParallelism, -(-n_left // 256)), 1)
    grams = F.transform(trigrams(F.col("text")), lambda t: F.xxhash64(t)).alias("grams")
    a = left.select(F.col("id").alias("a"), grams).where(F.size("grams") > 0).repartition(parts)
    b = right.select(F.col("id").alias("b"), grams).where(F.size("grams") > 0).repartitionByRange(max(1, -(-n_right // RIGHT_BLOCK)), "b").sortWithinPartitions("b")
    folder = scratch_folder(spark)
    b.mapInArrow(_blocks(RIGHT_BLOCK, RIGHT_BLOCK // 4, _written_block), _BLOCK).write.parquet(folder)
    schema = StructType([StructField("a", left.schema["id"].dataType), StructField("b", right.schema["id"].dataType), StructField("similarity", DoubleType()), StructField("rank", LongType())])
    return a.mapInArrow(_blocks(LEFT_BLOCK, LEFT_BLOCK // 4, _search(folder, least, most)), schema)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, candidate, similarity) of pairs with two vectors, as ``codes.cosine`` has it, pairs of one length at a time."""
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        n, m = (np.asarray(c.value_lengths().fill_null(-1)) for c in (one, two))
        ends = [np.append(0, np.cumsum(np.maximum(x, 0))) for x in (n, m)]
        flat = [c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (one, two)]
        similarity = np.zeros(batch.num_rows)
        for length in np.unique(n[(n == m) & (n > 0)]).tolist():
            rows = np.flatnonzero((n == m) & (n == length))
            x, y = (f[e[rows][:, None] + np.arange(length)] for f, e in zip(flat, ends, strict=True))
            norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
            similarity[rows] = np.divide((x * y).sum(axis=1), norm, out=np.zeros(rows.size), where=norm > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity)], names=["item", "candidate", "similarity"])


def reranked(pairs: DataFrame, vectors: DataFrame, kept: int = KEPT) -> DataFrame:
    """Candidate pairs (item, candidate) by cosine of their vectors, the best few of each item; those alike to nine places by id."""
    a = vectors.select(F.col("id").alias("item"), F.col("vector").alias("v1"))
    b = vectors.select(F.col("id").alias("candidate"), F.col("vector").alias("v2"))
    met = pairs.join(a, "item").join(b, "candidate").select("item", "candidate", "v1", "v2")
    scored = met.mapInArrow(_cosines, StructType([pairs.schema["item"], pairs.schema["candidate"], StructField("similarity", DoubleType())]))
    w = Window.partitionBy("item").orderBy(F.desc(F.round("similarity", 9)), "candidate")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= kept).select("item", "candidate", "similarity", "rank")


def without_rejected(candidates: DataFrame, rejections: DataFrame) -> DataFrame:
    return candidates.join(rejections.select("item", "candidate"), ["item", "candidate"], "left_anti")


def brand_conflict(a: Column, b: Column) -> Column:
    """Two real brands that differ, marks and case aside."""
    plain = lambda c: F.lower(F.trim(remove_diacritics(c)))
    return ~is_generic_brand(a) & ~is_generic_brand(b) & (plain(a) != plain(b))


def decisions(best: DataFrame, conflict: Column) -> DataFrame:
    """auto_link, review or no_match for each item's best candidate."""
    choice = (
        F.when(F.col("similarity").isNull() | (F.col("similarity") < REVIEW), "no_match").when(conflict, "review")
        .when(F.col("similarity") >= AUTO_LINK, "auto_link").otherwise("review")
    )
    return best.withColumn("decision", choice)


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int = KEPT) -> DataFrame:
    """Precision, recall and hit rate at k, hit rate at 1, and mean reciprocal rank.

    ``ranked`` has (query, candidate, rank), ``truth`` the relevant pairs (query, candidate), each once. Queries are those of the
    truth; one for which nothing was found counts with zeros, so each mean is over all queries.
    """
    found = ranked.where(F.col("rank") <= k).select("query", "candidate", "rank")
    per = truth.join(found, ["query", "candidate"], "left").groupBy("query").agg(F.count("*").alias("relevant"), F.count("rank").alias("hits"), F.min("rank").alias("best"))
    mean = lambda value: F.round(F.avg(value), 6)
    return per.agg(
        F.count("*").alias("queries"), mean(F.col("hits") / k).alias("precision_at_k"), mean(F.col("hits") / F.col("relevant")).alias("recall_at_k"), mean((F.col("hits") > 0).cast("double")).alias("hit_at_k"),
        mean(F.coalesce((F.col("best") == 1).cast("double"), F.lit(0.0))).alias("hit_at_1"), mean(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"),
    )


def ranked_models(results: DataFrame) -> DataFrame:
    """Models by what they find for their cost: recall at 10 over the total cost and a tenth of a cent, ties by name."""
    worth = F.col("recall_at_10") / (F.col("total_cost") + 0.001)
    return results.withColumn("worth", F.round(worth, 6)).withColumn("rank", F.row_number().over(Window.orderBy(worth.desc_nulls_last(), "model")).cast("long"))  # a row for each model


def counts_by_status(queue: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the queue by status, links by type and by whether they are sure, and candidates."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    q = queue.agg(F.count("*").alias("queued"), *[is_("status", s).alias(s) for s in ("pending", "approved", "rejected", "skipped")])
    n = links.agg(F.count("*").alias("links"), is_("match_type", "barcode").alias("by_barcode"), is_("match_type", "ai").alias("by_ai"), F.count_if(F.col("confidence") >= AUTO_LINK).alias("sure"))
    return q.join(n, F.lit(True)).join(candidates.agg(F.count("*").alias("candidates")), F.lit(True))  # one row each


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The first-ranked candidate of each item."""
    return candidates.groupBy("item").agg(F.min(F.struct("rank", "candidate", "similarity")).alias("c")).select("item", "c.candidate", "c.similarity")


def reviewed(queue: DataFrame, decisions_: DataFrame) -> DataFrame:
    """The queue after decisions (item, decision, version): applied only where the version is still the same."""
    d = decisions_.select("item", F.col("decision").alias("_decision"), F.col("version").alias("_version"))
    hit = F.col("_decision").isNotNull() & (F.col("_version") == F.col("version")) & (F.col("status") == "pending")
    return queue.join(d, "item", "left").select(
        "item", F.when(hit, F.col("_decision")).otherwise(F.col("status")).alias("status"), (F.col("version") + F.when(hit, 1).otherwise(0)).alias("version"),
    )
