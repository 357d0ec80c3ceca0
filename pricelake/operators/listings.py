"""Listings for readers: prices of a store, names, nested candidates, price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The name of an item that isn't known, and how times are shown.
UNKNOWN_ITEM = "Unknown Item"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def shown(time: Column) -> Column:
    """A time as readers see it; null stays null."""
    return F.date_format(time, TIME_FORMAT)


def store_prices(state: DataFrame, items: DataFrame, stores: DataFrame, store: str | None = None) -> DataFrame:
    """Prices with item and store names, of one store if it is given; prices of unknown items or stores are left out."""
    rows = state if store is None else state.where(F.col("store_id") == store)
    named = rows.join(items.select("item_id", F.col("name").alias("item_name"), "brand"), "item_id")
    named = named.join(stores.select("store_id", F.col("name").alias("store_name")), "store_id")
    return named.select("store_id", "store_name", "item_id", "item_name", "brand", "price", "discount_price")


def with_chains(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows of known chains, with the chain's name; rows of unknown ones are left out."""
    return rows.join(chains.select("chain_slug", F.col("name").alias("chain_name")), "chain_slug")


def with_item_names(prices: DataFrame, items: DataFrame) -> DataFrame:
    """Every price with its item's name, or the stand-in where the item isn't known."""
    names = items.select("item_id", F.col("name").alias("_name"))
    return prices.join(names, "item_id", "left").withColumn("item_name", F.coalesce("_name", F.lit(UNKNOWN_ITEM))).drop("_name")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``; repeated keys count once."""
    return rows.join(keys.select(key), key, "left_semi")


def nested(items: DataFrame, candidates: DataFrame, fields: list[str], most: int = 5) -> DataFrame:
    """Each item with its candidates as an array of structs, by rank; an empty array where it has none.

    Candidates past rank ``most`` are left out before they are gathered, so that no array grows with the data.
    """
    kept = candidates.where(F.col("rank") <= most).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("_list"))
    joined = items.join(kept, "item", "left")
    empty = F.array().cast(kept.schema["_list"].dataType)
    return joined.withColumn("candidates", F.coalesce("_list", empty)).drop("_list")


def price_history(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (price, valid_from, valid_to) of each key, numbered from the newest, with the price before."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("valid_from"))
    return intervals.withColumns({"n": F.row_number().over(newest).cast("long"), "price_before": F.lead("price").over(newest)})


def open_members(intervals: DataFrame, stores: DataFrame, key: str) -> DataFrame:
    """Stores with the interval that has no end yet."""
    return stores.join(intervals.where(F.col("valid_to").isNull()), key)
