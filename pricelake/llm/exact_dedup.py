"""Exact duplicates by a stream with keyed state on disk that never expires, confirmed on the full bytes.

A file stream feeds an aggregation whose state, one row for each digest, is in RocksDB and in the checkpoint: the digest, the
stable identifier and content locator (file and row in it) of the row to keep, and how many rows had the digest. New files only
change the state of their own digests. A digest that was seen more than once is a hit, and each hit's whole text is
compared with the text at the locator; texts that share a digest without being equal are grouped by their bytes.
Built-in functions only: the state is read by Spark's state data source, and no row passes through Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: A digest with more than a thousandth of all rows is broadcast (so at most a thousand are); a hit is compared among SHARE others in a task.
HEAVY, SHARE = 1000, 4096

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else each of the many small stores takes disk in advance for files that it may never fill.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    """Lowercase hex of the text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def _rows(frame: DataFrame, digest: Callable[[Column], Column], *more: str) -> DataFrame:
    """(doc_id, digest, file, row) of a file source's rows; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    return frame.select("doc_id", digest(text).cast("string").alias("digest"), *place, text.alias("text")).select("doc_id", "digest", "file", "row", *more)


def remembered(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, n) of all files that ``path`` has had, the new ones read now.

    ``path`` is a folder of Parquet files or one file. The kept row is the one with the largest doc_id (null the least), of
    equal ones the last by file and row. Run again with the same ``checkpoint``, only files that were not there before are
    read. Files are taken to be written once, as the file source takes them.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # A single file is found by a pattern, which the file source needs for it; a folder's files are found by it too.
    pattern = path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    arriving = _rows(spark.readStream.schema(schema).parquet(pattern), digest)
    state = arriving.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    before = {key: spark.conf.get(key, None) for key in _STATE_STORE}
    try:
        for key, value in _STATE_STORE.items():
            spark.conf.set(key, value)
        # No sink is needed: what counts is the state. The query keeps a copy of the session's settings.
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        # The source of state takes the settings of now, for what it opens when it is read.
        stored = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*").toDF("digest", "keep", "n")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return stored.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), "n")


def _looked_up(rows: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """Rows with the state of their digest, those without any left out.

    Digests with over a thousandth of the rows, a thousand at most, are broadcast; their rows are dealt out by place in the
    shuffle of the others, so no task gets a whole hot digest.
    """
    names = ["keep_id", "keep_file", "keep_row", "n"]
    rename = lambda frame, to: frame.select(F.col("digest").alias(to), *[F.col(c).alias(f"{to}{c}") for c in names])
    heavy = rename(state.where(F.col("n") * HEAVY > F.lit(total)), "_h")
    light = rename(state.where(F.col("n") * HEAVY <= F.lit(total)), "_l")
    found = rows.join(F.broadcast(heavy), F.col("digest") == F.col("_h"), "left")
    key = F.when(F.col("_h").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "digest", "file", "row"))
    found = found.withColumn("_key", key).join(light, F.col("_key") == F.col("_l"), "left").where("_h IS NOT NULL OR _l IS NOT NULL")
    is_heavy = F.col("_h").isNotNull()
    return found.select(*rows.columns, *[F.when(is_heavy, F.col(f"_h{c}")).otherwise(F.col(f"_l{c}")).alias(c) for c in names])


def _compared(hits: DataFrame) -> DataFrame:
    """Rows with a digest seen before, and whether their bytes are those at the locator.

    The kept text of a large group is sent to several tasks, one for each SHARE rows of the group.
    """
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    is_kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    kept = hits.where(is_kept).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    dealt = hits.withColumn("share", F.pmod(F.xxhash64("file", "row"), shares).cast("int"))
    return dealt.join(kept, ["digest", "share"]).withColumn("same", F.col("text").cast("binary") == F.col("kept_text").cast("binary"))


def _decided(spark: SparkSession, path: str, checkpoint: str | None, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, file, row, text_sha256) of all rows, with the id and place of the row that stays and the size of the group."""
    state = written(remembered(spark, path, checkpoint or f"{shared_dir(spark)}/{uuid.uuid4().hex}", digest))
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scan = spark.read.schema(spark.read.parquet(path).select("doc_id", "text").schema).parquet(path)
    hits = written(_looked_up(_rows(scan, digest, "text"), state.where("n > 1"), total))
    collided = written(_compared(hits).where(~F.col("same")).select("digest").distinct())
    rows = _rows(scan, digest, "text").withColumn("text_sha256", sha256(F.col("text"))).drop("text")
    result = _looked_up(rows, state, total)
    if not collided.isEmpty():
        own = hits.join(collided, "digest", "left_semi").select("digest", "text", "doc_id", "file", "row")
        groups = own.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("_keep"), F.count("*").alias("_n"))
        exact = own.select("digest", "text", "file", "row").join(groups, ["digest", "text"]).select("file", "row", "_keep", "_n")
        result = result.join(exact, ["file", "row"], "left")
        told = {"keep_id": "_keep.doc_id", "keep_file": "_keep.file", "keep_row": "_keep.row", "n": "_n"}
        result = result.withColumns({c: F.when(F.col("_n").isNotNull(), F.col(new)).otherwise(F.col(c)) for c, new in told.items()})
    return result.withColumn("kept", (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))


def duplicates(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``path``, in groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Needs doc_id and text; more columns are not read, whatever they are called. A null text is equal to an empty one. The row
    with the largest doc_id stays; where doc_ids repeat or are all null, one row of the group stays, the last by file and row. An
    empty table gives an empty result. ``digest`` may be weaker than SHA-256: the full bytes decide.
    """
    return _decided(spark, path, checkpoint, digest).select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256")


def deduplicated(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``path`` that stay, with all their columns."""
    kept = _decided(spark, path, checkpoint, digest).where("kept").select(F.col("file").alias("_kept_file"), F.col("row").alias("_kept_row"))
    scan = spark.read.parquet(path)
    at = scan.metadataColumn("_metadata")
    return scan.join(kept, (at["file_path"] == F.col("_kept_file")) & (at["row_index"] == F.col("_kept_row")), "left_semi")
