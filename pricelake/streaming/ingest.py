"""Streams of ingestion events: duplicates, windows, and snapshots of current prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import latest

LATE = "1 day"


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they come; ts becomes a timestamp with a zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_each(events: DataFrame, key: str = "checksum", time: str = "ts", late: str = LATE) -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, size: str = "1 day", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "24 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    """Rolling counts by status, as the dashboards show them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(
        F.count("*").alias("runs"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed")
    )


def sessions(events: DataFrame, gap: str = "1 day", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def write_snapshots(prices: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Each batch's latest row of each key, merged into a new version of the snapshot; a late row never replaces one of a later ``order``.

    Versions are folders named by batch, so a batch that is run again after a failure writes the same folder, and
    readers of an older version are not disturbed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        rows = batch.select(*keys, *rest)
        if number:
            rows = spark.read.parquet(f"{path}/{number - 1}").select(*rows.columns).union(rows)
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, "s.*")
        latest.write.mode("overwrite").parquet(f"{path}/{number}")

    return prices.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_changes(prices: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Each batch's last row of each key, by ``order`` (of equal ones by the other columns), written under the batch's number and nothing else.

    What a batch costs grows with the batch, not with all that is kept. A batch that is run again writes the same folder;
    ``current`` reads the last row of each key over all batches, so a late row never replaces a later one.
    """

    def change(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return prices.writeStream.foreachBatch(change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key over the changes of all batches."""
    rows = spark.read.option("basePath", path).parquet(path).drop("batch")
    return latest(rows, keys, order)


def compacted(spark: SparkSession, path: str, into: str, keys: list[str], order: list[str]) -> None:
    """Writes ``current`` as one batch of another folder, from which a reader goes on with the changes of later batches."""
    current(spark, path, keys, order).write.mode("overwrite").parquet(f"{into}/batch=-1")
