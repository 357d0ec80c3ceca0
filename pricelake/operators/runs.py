"""Ingestion runs: rows that failed parsed again, runs closed when their files are done, interrupted ones swept."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.money import parse_price
from .operations import validated
from .registry import new_id

DONE = ("completed", "failed", "interrupted")


def parsed_again(failed: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Failed rows' raw data (a JSON object) as name, price and discount_price by the present field names, with errors, warnings and is_valid.

    The first filled one of a field's names counts, whatever its case; text that is no object gives a row without fields, which is not valid.
    """
    raw = F.from_json("raw_data", "map<string,string>")
    rows = failed.withColumn("_raw", F.when(raw.isNotNull(), F.map_filter(F.transform_keys(raw, lambda k, _: F.lower(k)), lambda _, v: F.trim(v) != "")))
    cell = lambda field: F.coalesce(*[F.try_element_at("_raw", F.lit(n.lower())) for n in names[field]])
    rows = rows.withColumns({"name": F.trim(cell("name")), "price": parse_price(cell("price")), "discount_price": parse_price(cell("discount_price"))})
    return validated(rows.drop("_raw"))


@dataclass(frozen=True)
class Reprocessed:
    """What parsing again gave: rows that are good now, rows that are not, those as marked, and the run (None without any row)."""

    mended: DataFrame
    still_bad: DataFrame
    run: DataFrame


def reprocess(spark: SparkSession, failed: DataFrame, ids: DataFrame, names: dict[str, tuple[str, ...]], path: str, now: datetime) -> Reprocessed:
    """Parses the failed rows (id, chain_slug, raw_data, reprocessable) named in ``ids`` (id) again, if they may be, in one pass.

    The pass writes both outcomes under ``path``, and counts for the one new run, whose id is made of the time. Each row is marked:
    reprocessed_at is ``now``, and reprocessable is false, so that it isn't taken again.
    """
    taken = failed.where("reprocessable").join(ids.select("id").distinct(), "id", "left_semi")
    rows = parsed_again(taken, names).withColumns({"reprocessed_at": F.lit(now), "reprocessable": F.lit(False), "outcome": F.when(F.col("is_valid"), "mended").otherwise("still_bad")})
    told = Observation("reprocess")
    rows = rows.observe(told, F.count("*").alias("total"), F.count_if("is_valid").alias("good"), F.min("chain_slug").alias("chain_slug"))
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)
    seen = told.get
    schema = rows.drop("outcome").schema
    read = lambda outcome: spark.read.schema(rows.schema).parquet(path).where(F.col("outcome") == outcome).select(*schema.names)
    run = [(str(now), seen["chain_slug"], "reprocess", "running", now, seen["total"], seen["good"])] if seen["total"] else []
    made = spark.createDataFrame(run, "_at string, chain_slug string, source string, status string, started_at timestamp, total_entries long, good_entries long")
    return Reprocessed(read("mended"), read("still_bad"), made.withColumn("run_id", new_id("run_", "_at")).drop("_at"))


def with_progress(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs (run_id, status, total_files) with processed_files and entries, counted over files (run_id, status, entries, finished_at), and their state.

    A run that isn't done is completed once its total is above 0 and as many files are processed or failed; completed_at is when the
    last one was. Runs that are done keep their status; those without a file have 0.
    """
    over = F.col("status").isin("processed", "failed")
    counts = files.groupBy("run_id").agg(F.count_if(over).alias("processed_files"), F.coalesce(F.sum(F.when(over, F.col("entries"))), F.lit(0)).alias("processed_entries"), F.max(F.when(over, F.col("finished_at"))).alias("_last"))
    rows = runs.join(counts, "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("processed_files", "processed_entries")})
    closes = ~F.col("status").isin(*DONE) & (F.coalesce("total_files", F.lit(0)) > 0) & (F.col("processed_files") >= F.col("total_files"))
    rows = rows.withColumns({"status": F.when(closes, "completed").otherwise(F.col("status")), "completed_at": F.when(closes, F.col("_last"))})
    return rows.drop("_last")


def swept(runs: DataFrame, now: datetime, reason: str = "Service restarted during processing") -> DataFrame:
    """Runs, those still running made interrupted, with the time and the reason; the others as they are."""
    stopped = F.col("status") == "running"
    keep = lambda name, kind: F.col(name) if name in runs.columns else F.lit(None).cast(kind)
    told = F.to_json(F.struct(F.lit(reason).alias("interrupted_reason")))
    return runs.withColumns({
        "status": F.when(stopped, "interrupted").otherwise(F.col("status")), "completed_at": F.when(stopped, F.lit(now)).otherwise(keep("completed_at", "timestamp")), "metadata": F.when(stopped, told).otherwise(keep("metadata", "string")),
    })


def follow(files: DataFrame, runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follows a stream of files (run_id, file_id, status, entries, finished_at): every batch writes the runs that it touched, under its number.

    ``runs`` is a stored table (run_id, status, total_files). A file counts once, by its last state. A batch that is run again
    writes the same folder; ``followed`` reads the last state of each run.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = ["run_id", "file_id", "status", "entries", "finished_at"]
        batch.select(*columns).write.mode("overwrite").parquet(f"{path}/files/batch={number}")
        touched = batch.select("run_id").distinct()
        every = spark.read.option("basePath", f"{path}/files").parquet(f"{path}/files").where(F.col("batch") <= number).join(touched, "run_id", "left_semi")
        rest = [c for c in columns if c not in ("run_id", "file_id")]
        last = every.groupBy("run_id", "file_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("run_id", "file_id", "s.*")
        with_progress(runs.join(touched, "run_id", "left_semi"), last).write.mode("overwrite").parquet(f"{path}/runs/batch={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """All runs, those that ``follow`` has touched in their last state."""
    states = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs")
    rest = [c for c in states.columns if c not in ("run_id", "batch")]
    last = states.groupBy("run_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("run_id", "s.*")
    empty: dict[str, Column] = {"processed_files": F.lit(0).cast("long"), "processed_entries": F.lit(0).cast("long"), "completed_at": F.lit(None).cast("timestamp")}
    return last.unionByName(runs.select("run_id", "status", "total_files").join(last, "run_id", "left_anti").withColumns(empty))
