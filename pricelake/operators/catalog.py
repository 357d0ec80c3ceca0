"""Filters, search, paging and price-source rules over the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_SEARCH = 3


def escaped(text: str) -> str:
    """A text in which the wildcards of LIKE stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, all of them; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def catalog_filter(rows: DataFrame, chain=None, store=None, category=None, search=None, price_from=None, price_to=None, seen_from=None, seen_to=None) -> DataFrame:
    """Rows that meet the filters given; ``search`` is in name or brand, case-sensitive."""
    like = f"%{escaped(search)}%" if search is not None else None
    col = F.col
    return rows.where(
        all_of(
            None if chain is None else col("chain_slug") == chain,
            None if store is None else col("store_id") == store,
            None if category is None else col("category") == category,
            None if like is None else col("name").like(like) | col("brand").like(like),
            None if price_from is None else col("price") >= price_from,
            None if price_to is None else col("price") <= price_to,
            None if seen_from is None else col("last_seen") >= F.lit(seen_from),
            None if seen_to is None else col("last_seen") <= F.lit(seen_to),
        )
    )


def item_search(items: DataFrame, state: DataFrame, text: str, chain: str | None = None) -> DataFrame:
    """Items whose name has the text in any case, with mean price and number of stores; items no store has count 0."""
    if len(text.strip()) < LEAST_SEARCH:
        raise ValueError(f"search needs {LEAST_SEARCH} characters")
    found = items.where(F.col("name").ilike(f"%{escaped(text)}%"))
    if chain is not None:
        found = found.where(F.col("chain_slug") == chain)
    sums = state.groupBy("item_id").agg(F.sum("price").alias("_sum"), F.count("price").alias("_n"), F.countDistinct("store_id").alias("stores"))
    return found.join(sums, "item_id", "left").select("item_id", "name", "brand", F.expr("_sum div _n").alias("avg_price"), F.coalesce("stores", F.lit(0)).alias("store_count"))


def categories(items: DataFrame) -> DataFrame:
    return items.where(F.col("category").isNotNull() & (F.col("category") != "")).select("category").distinct()


def offset_page(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of the ordered rows; order must be total."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_counts(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def keyset_page(rows: DataFrame, time: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """Rows after a (time, key) cursor, in that order, one more than the page so that the caller sees if there are more."""
    if after is not None:
        rows = rows.where((F.col(time) > F.lit(after[0])) | ((F.col(time) == F.lit(after[0])) & (F.col(key) > after[1])))
    return rows.orderBy(time, key).limit(size + 1)


def effective_store(stores: DataFrame) -> DataFrame:
    """Each store with the store whose prices it has: its price source if that exists, else itself."""
    source = stores.select(F.col("store_id").alias("_source"), F.col("name").alias("source_name"))
    joined = stores.join(source, F.col("price_source_store_id") == F.col("_source"), "left")
    return joined.withColumn("effective_store_id", F.coalesce("_source", "store_id")).drop("_source")


def prices_by_source(stores: DataFrame, state: DataFrame) -> DataFrame:
    """State rows of the effective store for each store that asks for them."""
    wanted = effective_store(stores).select("store_id", "effective_store_id")
    return wanted.join(state.withColumnRenamed("store_id", "effective_store_id"), "effective_store_id")


def with_source_names(stores: DataFrame) -> DataFrame:
    """Stores with the name of the store that their prices come from; null without one, or where it isn't there."""
    names = stores.select(F.col("store_id").alias("price_source_store_id"), F.col("name").alias("source_name"))
    return stores.join(names, "price_source_store_id", "left").select(*stores.columns, "source_name")


def linked_counts(stores: DataFrame) -> DataFrame:
    """How many stores take their prices from each virtual store."""
    child = stores.where(F.col("price_source_store_id").isNotNull()).groupBy(F.col("price_source_store_id").alias("store_id")).agg(F.count("*").alias("n"))
    return stores.where("is_virtual").join(child, "store_id", "left").select("store_id", F.coalesce("n", F.lit(0)).alias("linked"))


def similar_stores(stores: DataFrame, most: int = 5) -> DataFrame:
    """Other stores of the same chain and city, a few for each."""
    other = stores.select("chain_slug", "city", F.col("store_id").alias("other"))
    pairs = stores.select("chain_slug", "city", "store_id").join(other, ["chain_slug", "city"]).where("store_id <> other")
    w = Window.partitionBy("store_id").orderBy("other")
    return pairs.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= most).select("store_id", "other", "n")
