"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A local folder is set only where nothing is set and Spark runs on
    one machine, as in tests; on a cluster, whose machines don't share such a folder, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str = "doc_id") -> Column:
    """crc32 of a key's decimal text, the number that fixes training and held-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def batches_of(frame: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that a batch of very long texts stays small in memory.

    A Python worker serves many tasks; what the last one has freed goes back to the system before and after a task's batches.
    """
    give_back()
    for batch in frame:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches to Python workers end at about ``most`` bytes in what runs inside, unless the session has a bound of its own.

    Spark's own bound of 10,000 rows is one of 33 MB for documents of 3 kB, which the JVM of an executor holds several times for each task: as
    vectors that grow by doubling, and as the bytes it sends.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None):
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)


def give_back() -> None:
    """Returns freed memory of Arrow's pool and of the C library to the system, where the library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def one_of_each(rows: DataFrame, group: Column) -> DataFrame:
    """The ``doc`` of one row of each group, that with the smallest doc_id; null ids come last, and unlike rows of one id are told apart by their content.

    ``rows`` must be a written table with a ``_row`` number of its own for each row.
    """
    doc_id = F.col("doc.doc_id")
    first = F.min(F.struct(doc_id.isNull().alias("null"), doc_id.alias("id"), F.xxhash64("doc").alias("content"), F.col("_row").alias("row")))
    kept = rows.groupBy(group.alias("_group")).agg(first.alias("first")).select(F.col("first.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("doc.*")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, spread: Column, buckets: int, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys``, ordered by ``spread``'s bucket, then ``order``.

    ``spread`` is a hash as a long. Rows are dealt out by key and bucket, so that a key with a third of all rows is
    shared by many tasks; the bucket totals (keys times buckets rows) are summed up separately.
    """
    rows = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int")).withColumn("_value", value.cast("long"))
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long"))).drop("_total")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_value").over(inside), F.lit(0).cast("long")))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_base")
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(base, on, "left").withColumn(out, F.col("_base") + F.col("_inner"))
    return joined.drop("_bucket", "_value", "_inner", "_b", "_base", *[f"_k{i}" for i in range(len(keys))])
