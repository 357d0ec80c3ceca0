"""Ingestion health, validation, retention, the task queue, and set-based changes of tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import health_class

# A price that is suspicious, days that things are kept, and the queue's retry rule.
LARGE_PRICE = 100_000_000
KEPT_DAYS = {"candidates": 7, "audit": 90, "pending": 30}
RETRY_SECONDS, ORPHAN_MINUTES = 60, 10


def validated(rows: DataFrame) -> DataFrame:
    """Rows with errors, warnings and is_valid: a name, a price above 0; very large prices and odd discounts warn."""
    name, price, discount = F.col("name"), F.col("price"), F.col("discount_price")
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "missing_name"), F.when(F.coalesce(price, F.lit(0)) <= 0, "invalid_price"),
    ))
    warnings = F.array_compact(F.array(F.when(price > LARGE_PRICE, "large_price"), F.when(discount >= price, "discount_not_lower")))
    return rows.withColumns({"errors": errors, "warnings": warnings}).withColumn("is_valid", F.size("errors") == 0)


def quarantine(checked: DataFrame) -> DataFrame:
    """Invalid rows with their raw data and errors as JSON."""
    raw = [c for c in checked.columns if c not in ("errors", "warnings", "is_valid")]
    return checked.where(~F.col("is_valid")).select(F.to_json(F.struct(*raw)).alias("raw_data"), F.to_json("errors").alias("validation_errors"))


def store_rows(rows: DataFrame) -> DataFrame:
    """Rows per store identifier, blank ones together as unknown."""
    key = F.coalesce(F.nullif(F.trim("store_identifier"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(key.alias("store_identifier")).agg(F.count("*").alias("n"))


def run_buckets(runs: DataFrame, end: datetime, start: datetime | None = None) -> DataFrame:
    """Counts of runs in the last 24 hours, 7 and 30 days before ``end``, in one pass."""
    buckets = F.array(*[F.struct(F.lit(name).alias("bucket"), F.lit(max(end - span, start) if start else end - span).alias("since")) for name, span in (("24h", timedelta(days=1)), ("7d", timedelta(days=7)), ("30d", timedelta(days=30)))])
    rows = runs.where(F.col("started_at") <= F.lit(end)).withColumn("b", F.explode(buckets)).where(F.col("started_at") >= F.col("b.since"))
    is_ = lambda s: F.col("status") == s
    return rows.groupBy(F.col("b.bucket").alias("bucket")).agg(
        F.count("*").alias("runs"), F.count_if(is_("completed")).alias("completed"), F.count_if(is_("failed")).alias("failed"), F.count_if(is_("running")).alias("running"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
    )


def error_summary(entries: DataFrame, failures: DataFrame) -> DataFrame:
    """Per chain: failures, entries and failures together, first and last failure, rate and health class."""
    good = entries.groupBy("chain_slug").agg(F.count("*").alias("entries"))
    bad = failures.groupBy("chain_slug").agg(F.count("*").alias("failed"), F.min("failed_at").alias("first_failed"), F.max("failed_at").alias("last_failed"))
    joined = good.join(bad, "chain_slug", "full_outer")
    failed, total = F.coalesce("failed", F.lit(0)), F.coalesce("failed", F.lit(0)) + F.coalesce("entries", F.lit(0))
    rate = F.round(failed / total, 6)
    return joined.select("chain_slug", failed.alias("failed"), total.alias("total"), "first_failed", "last_failed", rate.alias("rate"), health_class(failed / total).alias("health"))


def error_rollup(failures: DataFrame) -> DataFrame:
    """Failures by chain and type, with totals per chain and over all."""
    return failures.rollup("chain_slug", "error_type").agg(F.count("*").alias("n"))


def retention_counts(rows: DataFrame, time: str, now: datetime) -> DataFrame:
    """How many rows each retention period would remove."""
    return rows.agg(*[F.count_if(F.col(time) < F.lit(now - timedelta(days=d))).alias(name) for name, d in KEPT_DAYS.items()])


def claimed(tasks: DataFrame, now: datetime, most: int) -> DataFrame:
    """The tasks to claim: pending and due, by priority, then schedule, then id. ``most`` is the feature."""
    due = tasks.where((F.col("status") == "pending") & (F.col("scheduled_for") <= F.lit(now)))
    return due.orderBy(F.desc("priority"), "scheduled_for", "task_id").limit(most)


def retried(tasks: DataFrame, now: datetime) -> DataFrame:
    """Failed tasks scheduled anew after a minute for each retry so far, or failed for good."""
    again = F.col("retry_count") < F.col("max_retries")
    later = F.lit(now) + F.make_dt_interval(secs=((F.col("retry_count") + 1) * RETRY_SECONDS).cast("decimal(18,6)"))
    return tasks.select(
        "task_id", F.when(again, "pending").otherwise("failed").alias("status"), F.when(again, later).otherwise(F.col("scheduled_for")).alias("scheduled_for"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
    )


def orphaned(tasks: DataFrame, now: datetime) -> DataFrame:
    """Claimed tasks that were started too long ago."""
    return tasks.where((F.col("status") == "claimed") & (F.col("started_at") < F.lit(now - timedelta(minutes=ORPHAN_MINUTES))))


def queue_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.max("priority").alias("top_priority"))


def mean_durations(tasks: DataFrame, now: datetime, within: timedelta = timedelta(hours=1)) -> DataFrame:
    """Mean seconds by type of the tasks completed within a time before ``now``."""
    done = tasks.where((F.col("status") == "completed") & (F.col("completed_at") > F.lit(now - within)) & (F.col("completed_at") <= F.lit(now)))
    return done.groupBy("task_type").agg(F.round(F.avg(F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))) / 1000, 6).alias("mean_seconds"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, those with a key in new replaced, and new ones added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def transitioned(rows: DataFrame, changes: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Rows whose status a change (key, new_status, version) sets, if its version is current and ``allowed`` holds."""
    c = changes.select(key, "new_status", F.col("version").alias("_version"))
    hit = F.col("new_status").isNotNull() & (F.col("_version") == F.col("version")) & allowed
    joined = rows.join(c, key, "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return joined.withColumn("status", F.when(F.col("_hit"), F.col("new_status")).otherwise(F.col("status"))).withColumn("version", F.col("version") + F.col("_hit").cast("long")).drop("new_status", "_version", "_hit")


def merged_stores(stores: DataFrame, merges: DataFrame) -> DataFrame:
    """Stores after merges (store_id, into): merged ones go, and those that took prices from them follow."""
    m = merges.select(F.col("store_id").alias("_old"), F.col("into").alias("_into"))
    kept = stores.join(m, F.col("store_id") == F.col("_old"), "left_anti")
    return kept.join(m, F.col("price_source_store_id") == F.col("_old"), "left").withColumn("price_source_store_id", F.coalesce("_into", "price_source_store_id")).drop("_old", "_into")
