"""What ingestion keeps: items and stores by natural key, last prices of a file, groups last seen, cached embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order`` and, of equal ones, by the other columns from left to right.

    Aggregated before the shuffle, so a hot key is one row for each task.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def new_id(prefix: str, *keys: str) -> Column:
    """An id made of the natural key, so that reruns give the same."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256), 1, 20))


def found_or_created(known: DataFrame, seen: DataFrame, keys: list[str], order: list[str], prefix: str) -> DataFrame:
    """Items of ``seen`` by natural key, with their latest attributes, the id that is known or a new one, and is_new."""
    rows = latest(seen, keys, order).join(known.select(*keys, F.col("item_id").alias("_known")), keys, "left")
    return rows.withColumns({"item_id": F.coalesce("_known", new_id(prefix, *keys)), "is_new": F.col("_known").isNull()}).drop("_known")


def registered_stores(stores: DataFrame, seen: DataFrame, identifier: str = "identifier") -> DataFrame:
    """(identifier, status) of the stores, and of identifiers seen that none has, as pending; blank ones don't count."""
    trimmed = F.trim(identifier).alias(identifier)
    fresh = seen.select(trimmed).where(F.col(identifier) != "").distinct().join(stores.select(identifier), identifier, "left_anti")
    return stores.select(identifier, "status").unionByName(fresh.withColumn("status", F.lit("pending")))


def touched(groups: DataFrame, seen: DataFrame, key: str, time: str) -> DataFrame:
    """Groups with last_seen moved on to the latest time seen; never moved back, and groups not seen stay."""
    new = seen.groupBy(key).agg(F.max(time).alias("_seen"))
    return groups.join(new, key, "left").withColumn("last_seen", F.greatest("last_seen", "_seen")).drop("_seen")


def storage_ratio(grouped: DataFrame, naive: DataFrame) -> DataFrame:
    """How many rows price groups store, how many a row for each store and item would be, and the share saved."""
    a, b = grouped.agg(F.count("*").alias("grouped_rows")), naive.agg(F.count("*").alias("naive_rows"))
    saved = F.round(1 - F.col("grouped_rows") / F.col("naive_rows"), 6)
    return a.join(b, F.lit(True)).withColumn("saved", saved)  # one row each


def embedding_cache(items: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Items (item, text_hash) with is_hit: the cache has that item for this model and this very text."""
    have = cache.where(F.col("model_version") == model).select("item", "text_hash").distinct().withColumn("_hit", F.lit(True))
    return items.join(have, ["item", "text_hash"], "left").withColumn("is_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def not_embedded(items: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Items that the cache has in no form for this model."""
    return items.join(cache.where(F.col("model_version") == model).select("item"), "item", "left_anti")


def bulk_approved(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pending items of the queue with their first-ranked candidate, approved; items without candidates are left out."""
    best = candidates.where("rank = 1").select("item", "candidate")
    return queue.where("status = 'pending'").join(best, "item").withColumn("status", F.lit("approved"))


def counted(rows: DataFrame, column: str, values: list[str]) -> list[Column]:
    """Conditional counts, one for each value that a column may have."""
    return [F.count_if(F.col(column) == v).alias(v) for v in values if column in rows.columns]


def request_errors(lines: DataFrame, most: int = 100) -> DataFrame:
    """Baskets with what is wrong with their lines: chain, number of lines, ids, quantities, and coordinates that are no place."""
    outside = lambda name, limit: F.count_if(~F.col(name).between(-limit, limit)).alias(name) if name in lines.columns else F.lit(0).alias(name)
    per = lines.groupBy("basket_id").agg(
        F.max(F.coalesce(F.trim("chain_slug"), F.lit(""))).alias("chain"), F.count("*").alias("n"),
        F.count_if(F.coalesce(F.trim("item_id"), F.lit("")) == "").alias("blank"), F.count_if(F.coalesce("quantity", F.lit(0)) <= 0).alias("none"),
        outside("latitude", 90), outside("longitude", 180),
    )
    errors = F.array_compact(F.array(
        F.when(F.col("chain") == "", "chain_missing"), F.when(F.col("n") > most, "too_many_lines"), F.when(F.col("blank") > 0, "item_missing"), F.when(F.col("none") > 0, "quantity_not_positive"),
        F.when(F.col("latitude") > 0, "latitude_out_of_range"), F.when(F.col("longitude") > 0, "longitude_out_of_range"),
    ))
    return per.select("basket_id", F.col("n").alias("n_lines"), F.array_join(errors, ",").alias("errors"))
