"""Price lists as content-addressed groups, versioned membership, overrides, and observations over time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.money import effective_price


#: Partitions over which price lists are dealt at least, so that few have to be sorted by one task.
LISTS_DEALT = 128


def _digests(keys: int, out: pa.Schema) -> Callable:
    """The digest and count of each run of rows with equal keys (the first ``keys`` columns); the column after them has the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, count, done = None, None, 0, []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
            done.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            line = batch.column(keys)
            _, offsets, data = line.buffers()
            ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(line.type) else np.int32)[line.offset : line.offset + len(line) + 1]
            codes = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy() for i in range(keys)]
            moved = np.logical_or.reduce([np.diff(c) != 0 for c in codes])
            starts = [0, *(np.flatnonzero(moved) + 1).tolist(), batch.num_rows]
            for first, end in zip(starts, starts[1:]):
                key = tuple(batch.column(i)[first].as_py() for i in range(keys))
                fresh = digest is None or key != now
                if fresh:
                    if digest is not None:
                        done.append((*now, digest.hexdigest(), count))
                    now, digest, count = key, hashlib.sha256(), 0
                digest.update(memoryview(data)[ends[first] + fresh : ends[end]])  # a list's first line has no break before it
                count += end - first
            if done:
                yield made()
        if digest is not None:
            done.append((*now, digest.hexdigest(), count))
            yield made()

    return run


def price_list_hashes(prices: DataFrame, keys: list[str]) -> DataFrame:
    """One hash per price list: SHA-256 over its lines in canonical order (item, price, discount with null first).

    Order and letter case of items don't matter; null and 0 differ; repeated lines count. A list's lines are sorted by Spark and
    digested as they pass, so no list is held in memory; one task digests a list, as SHA-256 can't be divided.
    """
    rows = prices.select(*keys, F.lower("item_id").alias("_item"), F.col("price").alias("_price"), F.col("discount_price").alias("_discount"))
    dealt = max(int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions")), LISTS_DEALT)
    rows = rows.repartition(dealt, *keys).sortWithinPartitions(*keys, "_item", "_price", "_discount")
    line = F.concat_ws(":", "_item", F.col("_price").cast("string"), F.coalesce(F.col("_discount").cast("string"), F.lit("null")))
    schema = StructType([*[prices.schema[k] for k in keys], StructField("price_hash", StringType()), StructField("item_count", LongType())])
    return rows.select(*keys, F.concat(F.lit("\n"), line).alias("line")).mapInArrow(_digests(len(keys), to_arrow_schema(schema)), schema)


def price_groups(hashes: DataFrame) -> DataFrame:
    """The different price lists of each chain, with how many stores share one; the first store stands for it."""
    return hashes.groupBy("chain_slug", "price_hash").agg(
        F.count("*").alias("store_count"), F.first("item_count").alias("item_count"), F.min("store_id").alias("first_store")
    )


def new_groups(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Groups that are not stored yet, or are stored without any item."""
    return groups.join(existing.where("item_count > 0"), ["chain_slug", "price_hash"], "left_anti")


def effective_prices(store_prices: DataFrame, exceptions: DataFrame, as_of: datetime) -> DataFrame:
    """What each store charges: an unexpired exception first, else its group's price; exceptions may add items."""
    live = exceptions.where(F.col("expires_at") > F.lit(as_of)).select(
        "store_id", "item_id", F.col("price").alias("e_price"), F.col("discount_price").alias("e_discount")
    )
    joined = store_prices.join(live, ["store_id", "item_id"], "full_outer")
    is_exception = F.col("e_price").isNotNull()
    price = F.coalesce("e_price", "price")
    discount = F.when(is_exception, F.col("e_discount")).otherwise(F.col("discount_price"))
    return joined.select("store_id", "item_id", price.alias("price"), effective_price(price, discount).alias("effective"), is_exception.alias("is_exception"))


def price_listing(store_prices: DataFrame, exceptions: DataFrame, as_of: datetime) -> DataFrame:
    """Group prices as they are, with a flag where an unexpired exception exists."""
    live = exceptions.where(F.col("expires_at") > F.lit(as_of)).select("store_id", "item_id", F.lit(True).alias("live")).distinct()
    return store_prices.join(live, ["store_id", "item_id"], "left").select(
        "store_id", "item_id", "price", "discount_price", F.coalesce("live", F.lit(False)).alias("is_exception")
    )


def chain_item_averages(group_prices: DataFrame) -> DataFrame:
    """The truncated mean base price of an item over all price lists of a chain."""
    return group_prices.groupBy("chain_slug", "item_id").agg(F.expr("sum(price) div count(price)").alias("avg_price"))


def membership_intervals(snapshots: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Half-open intervals of equal ``value``; equal neighbours are one, and the last is open.

    ``snapshots`` has one row per key and time.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    marked = snapshots.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w))
    starts = marked.where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value)))
    return starts.select(*keys, value, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"))


def as_of(intervals: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """The value valid at each probe's ``at``; probes without one are left out. A key's intervals don't overlap.

    Intervals and probes of a key are put in the order of time, and a probe takes the last interval before it, so no probe meets
    all intervals of its key.
    """
    held, asked = ([c for c in frame.columns if c not in keys] for frame in (intervals, probes))
    left = intervals.select(*keys, F.col("valid_from").alias("_t"), F.lit(0).alias("_kind"), F.struct(*held).alias("_i"))
    right = probes.select(*keys, F.col("at").cast(intervals.schema["valid_from"].dataType).alias("_t"), F.lit(1).alias("_kind"), F.struct(*asked).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("_i", F.last("_i", ignorenulls=True).over(w)).where("_p IS NOT NULL AND _i IS NOT NULL")
    valid = F.col("_i.valid_to").isNull() | (F.col("_t") < F.col("_i.valid_to"))
    return rows.where(valid).select(*keys, "_p.*", "_i.*")


def price_changes(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each observation with the price before it and whether it changed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    previous = F.lag("price").over(w)
    return observations.withColumn("previous_price", previous).withColumn("changed", F.coalesce(F.col("previous_price") != F.col("price"), F.lit(False)))


def item_state(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last observation of each key, the price before it, and how often the price has changed."""
    last = F.struct(*order, "price", "discount_price", "previous_price")
    rows = price_changes(observations, keys, order).groupBy(*keys).agg(F.max(last).alias("s"), F.count_if("changed").alias("price_changes"), F.count("*").alias("seen"))
    return rows.select(*keys, F.col("s.price").alias("price"), F.col("s.discount_price").alias("discount_price"), F.col("s.previous_price").alias("previous_price"), "price_changes", "seen")


def upsert_state(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old state rows replaced or joined by new ones; the price that a new one replaces is kept, changes are counted."""
    o, n = old.alias("o"), new.select(*keys, F.col("price").alias("new_price")).alias("n")
    moved = F.col("new_price").isNotNull() & F.col("price").isNotNull() & (F.col("new_price") != F.col("price"))
    return o.join(n, keys, "full_outer").select(
        *keys,
        F.coalesce("new_price", "price").alias("price"),
        F.when(moved, F.col("price")).otherwise(F.col("previous_price")).alias("previous_price"),
        (F.coalesce("price_changes", F.lit(0)) + F.when(moved, 1).otherwise(0)).cast("long").alias("price_changes"),
    )


def lowest_in_days(observations: DataFrame, keys: list[str], days: int = 30) -> DataFrame:
    """The lowest price of the last ``days`` days up to each observation."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-days * 86400, 0)
    return observations.withColumn("low", F.min("price").over(w))


def orphan_groups(groups: DataFrame, memberships: DataFrame, cutoff: datetime) -> DataFrame:
    """Groups last seen before ``cutoff`` that no store is in any more."""
    open_ = memberships.where(F.col("valid_to").isNull()).select("group_id").distinct()
    return groups.where(F.col("last_seen") < F.lit(cutoff)).join(open_, "group_id", "left_anti")


def variation_report(store_prices: DataFrame) -> DataFrame:
    """Per chain: stores, items, different prices per item at most, and the share of item prices that are the commonest."""
    counts = store_prices.groupBy("chain_slug", "item_id", "price").agg(F.count("*").alias("n"))
    items = counts.groupBy("chain_slug", "item_id").agg(F.count("*").alias("prices"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return items.groupBy("chain_slug").agg(
        F.count("*").alias("items"), F.max("prices").alias("most_prices"), F.sum("most").alias("modal_rows"), F.sum("all").alias("price_rows")
    )


def signature(*columns: str) -> Column:
    """A hash of a row's prices by value."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("N")) for c in columns]), 256)


def signature_clusters(store_prices: DataFrame, price: str = "price") -> DataFrame:
    """Per chain: stores, how many different price lists they have, and the share of stores with the commonest one.

    A list's signature is an order-free sum of hashes of its lines, made without gathering a store's lines.
    """
    line = F.xxhash64("item_id", price).cast("decimal(20,0)")
    again = F.xxhash64(price, "item_id", F.lit(1)).cast("decimal(20,0)")
    stores = store_prices.groupBy("chain_slug", "store_id").agg(F.sum(line).alias("a"), F.sum(again).alias("b"), F.count("*").alias("n"))
    clusters = stores.groupBy("chain_slug", "a", "b", "n").agg(F.count("*").alias("stores"))
    total = F.sum("stores")
    return clusters.groupBy("chain_slug").agg(total.alias("stores"), F.count("*").alias("clusters"), F.round(F.max("stores") / total, 6).alias("largest_share"))


def assortment_coverage(store_prices: DataFrame) -> DataFrame:
    """Per store: its items, those of its chain, the share it has, and the mean share of the chain's stores that have its items."""
    lines = store_prices.select("chain_slug", "store_id", "item_id").distinct()
    spread = lines.groupBy("chain_slug", "item_id").agg(F.count("*").alias("_in"))
    chain = spread.groupBy("chain_slug").agg(F.count("*").alias("chain_items"))
    every = lines.groupBy("chain_slug", "store_id").agg(F.count("*").alias("items"))
    stores = every.groupBy("chain_slug").agg(F.count("*").alias("_stores"))
    # An item is in as many lists as its chain has stores at most, and each line meets one row of its item.
    shared = lines.join(spread, ["chain_slug", "item_id"]).groupBy("chain_slug", "store_id").agg(F.sum("_in").alias("_sum"))
    rows = every.join(shared, ["chain_slug", "store_id"]).join(chain, "chain_slug").join(stores, "chain_slug")
    return rows.select("chain_slug", "store_id", "items", "chain_items", F.round(F.col("items") / F.col("chain_items"), 6).alias("coverage"), F.round(F.col("_sum") / F.col("items") / F.col("_stores"), 6).alias("mean_spread"))


def snapshot_health(snapshots: DataFrame, key: str, now: datetime, most_age_minutes: int = 60) -> DataFrame:
    """Per kept snapshot of a file source: rows, files, bytes, when it was written, and whether it is stale at ``now``."""
    rows = snapshots.select(key, "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = rows.groupBy(key, "file_path").agg(F.count("*").alias("_rows"), F.first("file_size").alias("_size"), F.max("file_modification_time").alias("_at"))
    made = files.groupBy(key).agg(F.sum("_rows").alias("rows"), F.count("*").alias("files"), F.sum("_size").alias("bytes"), F.max("_at").alias("written_at"))
    return made.withColumn("is_stale", F.col("written_at") < F.lit(now) - F.expr(f"INTERVAL {int(most_age_minutes)} MINUTES"))
