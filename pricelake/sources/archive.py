"""The archive of fetched files: content-addressed, partitioned by chain and day, each content once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import file_name, file_type

_SCHEMA = "archive_key string, source_url string, file_name string, file_type string, bytes long, checksum string, content binary, chain_slug string, day date"


@dataclass(frozen=True)
class Archive:
    """An archive in a folder that Spark reads and writes: a Parquet table, a row for each content."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """All that is archived, with the contents; a query that doesn't take ``content`` doesn't read it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/files")
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/files")

    def store(self, files: DataFrame, day: date) -> int:
        """Archives those of files (chain_slug, url, content) whose content isn't there yet, and tells how many.

        Of equal contents the first by chain and URL is kept. Files without content are left out. The partitions of the chains that have something
        new are written anew with what they had, through a staging folder, so a run that fails midway leaves the old ones or the new
        ones; run again it adds nothing twice.
        """
        rows = files.where("content IS NOT NULL").withColumn("checksum", F.sha2("content", 256))
        first = F.struct("chain_slug", "url").alias("_first")
        # Which rows are kept is found without their contents.
        kept = rows.select("checksum", first).groupBy("checksum").agg(F.min("_first").alias("_first")).join(self.rows().select("checksum"), "checksum", "left_anti")
        name = file_name(F.col("url"))
        key = F.concat_ws("/", F.lit("archives"), F.col("chain_slug"), F.lit(f"{day:%Y/%m/%d}"), name)
        new = rows.join(kept.select("checksum", "_first.chain_slug", "_first.url"), ["checksum", "chain_slug", "url"], "left_semi").dropDuplicates(["checksum"])
        new = new.select(
            key.alias("archive_key"), F.col("url").alias("source_url"), name.alias("file_name"), file_type(name).alias("file_type"),
            F.octet_length("content").cast("long").alias("bytes"), "checksum", "content", "chain_slug", F.lit(day).alias("day"),
        )
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        new.write.parquet(f"{staging}/new")
        new = self.spark.read.parquet(f"{staging}/new")
        chains = [r["chain_slug"] for r in new.select("chain_slug").distinct().collect()]
        if not chains:
            return 0
        self.rows().where(F.col("chain_slug").isin(chains) & (F.col("day") == F.lit(day))).write.parquet(f"{staging}/old")
        both = self.spark.read.parquet(f"{staging}/old").unionByName(new)
        both.write.partitionBy("chain_slug", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/files")
        return new.count()
