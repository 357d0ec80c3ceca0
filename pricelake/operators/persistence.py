"""Price groups and memberships kept from day to day: each day's snapshot is merged into what is stored, and committed as a whole.

Under the history's folder, all by day: ``group`` and ``group_price`` have what a day adds, ``closed`` the memberships that end on
it, ``open`` those that are open after it (a row for each store), ``group_state`` the counts of all groups. A day counts once
its row in ``commit`` is there, which is written last; a day that failed is written over when it is run again, and readers
never see a part of it. Prices of known groups are never read or written again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pricing import price_list_hashes
from .registry import latest, new_id

_TABLES = {
    "group": "group_id string, chain_slug string, price_hash string, item_count long, first_seen date",
    "group_price": "group_id string, item_id string, price long, discount_price long",
    "closed": "store_id string, group_id string, valid_from date, valid_to date",
    "open": "store_id string, group_id string, valid_from date",
    "group_state": "group_id string, store_count long, last_seen date",
    "commit": "stores long, kept long, moved long, added long, new_groups long",
}
_EVER = ("group", "group_price", "closed")  # tables of which all days count, not the last one's alone


@dataclass(frozen=True)
class PriceHistory:
    """The history in a folder that Spark reads and writes."""

    spark: SparkSession
    path: str

    def days(self) -> list[date]:
        """The committed days in order."""
        return sorted(r["day"] for r in self._read("commit").select("day").collect())

    def _read(self, name: str) -> DataFrame:
        """A table with all that was written of it, also by days that were not committed."""
        schema = f"{_TABLES[name]}, day date"
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def table(self, name: str, day: date | None = None) -> DataFrame:
        """A table as it was after a committed day (the last one without it): all rows up to it, or those of its own."""
        return self._of(name, [d for d in self.days() if day is None or d <= day])

    def _of(self, name: str, days: list[date]) -> DataFrame:
        rows = self._read(name)
        if not days:
            return rows.limit(0)
        return rows.where(F.col("day").isin(days) if name in _EVER else F.col("day") == F.lit(days[-1]))

    def _write(self, name: str, rows: DataFrame, day: date) -> None:
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/day={day.isoformat()}")

    def memberships(self, day: date | None = None) -> DataFrame:
        """(store_id, group_id, valid_from, valid_to): half-open intervals, the last of a store open; neighbours differ in their group."""
        closed = self.table("closed", day).select("store_id", "group_id", "valid_from", "valid_to")
        return closed.unionByName(self.table("open", day).select("store_id", "group_id", "valid_from", F.lit(None).cast("date").alias("valid_to")))

    def groups(self, day: date | None = None) -> DataFrame:
        """(group_id, chain_slug, price_hash, item_count, first_seen, store_count, last_seen), a row for each group that was ever seen."""
        known = latest(self.table("group", day), ["group_id"], ["day"]).drop("day")
        return known.join(self.table("group_state", day).drop("day"), "group_id", "left").withColumn("store_count", F.coalesce("store_count", F.lit(0)))

    def group_prices(self, day: date | None = None) -> DataFrame:
        """(group_id, item_id, price, discount_price), an item of a group once."""
        return latest(self.table("group_price", day), ["group_id", "item_id"], ["day"]).drop("day")

    def ingest(self, snapshot: DataFrame, day: date, order: list[str] | None = None) -> dict[str, int]:
        """Merges the price lists of a day (chain_slug, store_id, item_id, price, discount_price) and tells what it did.

        A store's list that is the same as before keeps its interval; another one closes it and opens a new one; stores that the
        snapshot doesn't have stay as they are. Groups are found by chain and content, or created; one that is stored without
        items counts as not stored. Of an item that a list has twice the last by ``order`` is the group's price, while the hash has both.
        Days come in order; the last committed day may come again, and is then made anew from the day before it.
        """
        days = self.days()
        if days and day < days[-1]:
            raise ValueError(f"{day} is before {days[-1]}, which is committed")
        ever = lambda name: self._of(name, [d for d in days if d < day])

        hashes = price_list_hashes(snapshot, ["chain_slug", "store_id"]).withColumn("group_id", new_id("grp_", "chain_slug", "price_hash"))
        seen = hashes.groupBy("group_id").agg(F.first("chain_slug").alias("chain_slug"), F.first("price_hash").alias("price_hash"), F.min("store_id").alias("_from"))
        known = ever("group").where("item_count > 0").select("group_id").distinct()
        fresh = seen.join(known, "group_id", "left_anti")
        # One store's rows stand for a new group's.
        rows = snapshot.join(fresh.select("group_id", "chain_slug", F.col("_from").alias("store_id")), ["chain_slug", "store_id"])
        prices = latest(rows.withColumn("item_id", F.lower("item_id")).drop("chain_slug", "store_id"), ["group_id", "item_id"], order or ["price", "discount_price"])
        self._write("group_price", prices, day)
        counts = self.spark.read.parquet(f"{self.path}/group_price/day={day.isoformat()}").groupBy("group_id").agg(F.count("*").alias("item_count"))
        self._write("group", fresh.join(counts, "group_id", "left").withColumns({"item_count": F.coalesce("item_count", F.lit(0)), "first_seen": F.lit(day)}), day)

        old, new = ever("open").select("store_id", "group_id", "valid_from"), hashes.select("store_id", F.col("group_id").alias("_new"))
        both = old.join(new, "store_id", "full_outer")
        stays = F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("group_id"))
        moved = both.where(~stays & F.col("group_id").isNotNull())
        self._write("closed", moved.withColumn("valid_to", F.lit(day)), day)
        now = both.select("store_id", F.when(stays, F.col("group_id")).otherwise(F.col("_new")).alias("group_id"), F.when(stays, F.col("valid_from")).otherwise(F.lit(day)).alias("valid_from"), F.when(F.col("group_id").isNull(), "added").when(stays, "kept").otherwise("moved").alias("what"))
        self._write("open", now, day)

        stores = self.spark.read.parquet(f"{self.path}/open/day={day.isoformat()}").groupBy("group_id").agg(F.count("*").alias("store_count"))
        touched = seen.select("group_id", F.lit(day).alias("_seen"))
        state = ever("group_state").select("group_id", "last_seen").join(touched, "group_id", "full_outer").join(stores, "group_id", "left")
        self._write("group_state", state.withColumns({"last_seen": F.greatest("last_seen", "_seen"), "store_count": F.coalesce("store_count", F.lit(0))}), day)

        is_ = lambda what: F.count_if(F.col("what") == what)
        told = now.agg(F.count("*").alias("stores"), is_("kept").alias("kept"), is_("moved").alias("moved"), is_("added").alias("added"))
        done = told.first().asDict() | {"new_groups": self.spark.read.parquet(f"{self.path}/group/day={day.isoformat()}").count()}
        self._write("commit", self.spark.createDataFrame([done], _TABLES["commit"]), day)
        return done
