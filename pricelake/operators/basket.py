"""Basket optimisation: which store, or which few stores, should a basket be bought from.

All baskets are evaluated in one job. A basket meets only the stores of its chain, which are a small dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codes import haversine_km
from ..functions.money import coverage_bin

# Fixed values of the optimiser's defaults.
PENALTY_FACTOR, DEFAULT_PENALTY = 2, 10_000
MOST_RESULTS, CHEAPEST, NEAREST, MOST_CANDIDATES = 50, 10, 5, 20
EXHAUSTIVE_LINES, EXHAUSTIVE_CANDIDATES = 10, 15
MOST_NEAR, DEFAULT_KM = 1000, 50.0


def penalised_lines(lines: DataFrame, averages: DataFrame) -> DataFrame:
    """Basket lines with the penalty per unit of a missing item: twice its chain average, or a default."""
    known = F.col("avg_price").isNotNull() & (F.col("avg_price") > 0)
    return lines.join(averages, ["chain_slug", "item_id"], "left").withColumn(
        "penalty", F.when(known, F.col("avg_price") * PENALTY_FACTOR).otherwise(F.lit(DEFAULT_PENALTY)).cast("long")
    )


def offers(lines: DataFrame, stores: DataFrame, prices: DataFrame) -> DataFrame:
    """Each basket line at each store of the basket's chain; ``total`` is null where the store lacks the item.

    A line meets one row, the item's prices by store of its chain; only then are there as many rows as stores. The result is
    dealt out by basket, so that what is done by basket after it needs no shuffle.
    """
    chains = stores.select("chain_slug", "store_id")
    sheets = prices.join(chains, "store_id").groupBy("chain_slug", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("store_id", "effective"))).alias("_sheet"))
    lists = chains.groupBy("chain_slug").agg(F.array_distinct(F.collect_list("store_id")).alias("_stores"))
    rows = lines.join(lists, "chain_slug").join(sheets, ["chain_slug", "item_id"], "left").repartition("basket_id")
    rows = rows.withColumn("store_id", F.explode("_stores")).drop("_stores")
    price = F.try_element_at("_sheet", F.col("store_id"))
    return rows.withColumn("effective", price).drop("_sheet").withColumn("total", F.col("effective") * F.col("quantity"))


def single_store(offer: DataFrame) -> DataFrame:
    """Coverage, real total and total with penalties of each basket at each store."""
    found = F.col("total").isNotNull()
    sums = offer.groupBy("basket_id", "store_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(found).alias("n_found"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("real_total"),
        F.sum(F.when(found, F.col("total")).otherwise(F.col("penalty") * F.col("quantity"))).alias("sorting_total"),
    )
    return sums.withColumn("coverage_bin", coverage_bin(F.col("n_found") / F.col("n_lines")).cast("long"))


def ranked_stores(evaluated: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """Stores by coverage class, total, then distance (unknown last) and id."""
    distance = F.when(F.col("distance_km") > 0, F.col("distance_km")) if "distance_km" in evaluated.columns else F.lit(None).cast("double")
    w = Window.partitionBy("basket_id").orderBy(F.desc("coverage_bin"), "sorting_total", distance.asc_nulls_last(), "store_id")
    return evaluated.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def with_distance(stores: DataFrame, latitude, longitude) -> DataFrame:
    return stores.withColumn("distance_km", haversine_km(latitude, longitude, F.col("latitude"), F.col("longitude")))


def nearest_stores(places: DataFrame, stores: DataFrame, key: str, k: int = NEAREST, within_km: float = DEFAULT_KM) -> DataFrame:
    """The k nearest stores of each place's chain within a distance; places and stores without coordinates drop out."""
    located = stores.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("chain_slug", "store_id", "latitude", "longitude")
    joined = places.join(located, "chain_slug")
    joined = joined.withColumn("km", haversine_km(F.col("at_latitude"), F.col("at_longitude"), F.col("latitude"), F.col("longitude"))).where(F.col("km") <= within_km)
    w = Window.partitionBy(key).orderBy("km", "store_id")
    return joined.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= min(k, MOST_NEAR)).select(key, "store_id", "km", "rank")


def candidates(evaluated: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """The cheapest stores that cover 80 % and the nearest ones, each basket's union of both, at most 20."""
    w = Window.partitionBy("basket_id").orderBy("sorting_total", "store_id")
    chosen = evaluated.where("coverage_bin >= 2").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= CHEAPEST).select("basket_id", "store_id")
    if near is not None:
        chosen = chosen.union(near.where(F.col("rank") <= NEAREST).select("basket_id", "store_id")).distinct()
    w = Window.partitionBy("basket_id").orderBy("store_id")
    return chosen.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= MOST_CANDIDATES)


def greedy(offer: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each line from the candidate that sells it cheapest (ties: the smaller id); lines that none sells have no store.

    A basket has an item once. Baskets without candidates are left out. Candidates meet the offers as a list of each basket's.
    """
    lists = chosen.groupBy("basket_id").agg(F.collect_set("store_id").alias("_chosen"))
    rows = offer.join(lists, "basket_id")
    sold = F.array_contains("_chosen", F.col("store_id")) & F.col("total").isNotNull()
    best = rows.groupBy("basket_id", "item_id").agg(F.min(F.when(sold, F.struct("total", "store_id"))).alias("b"), F.first(F.col("penalty") * F.col("quantity")).alias("_penalty"))
    return best.select(
        "basket_id", "item_id", F.col("b.store_id").alias("store_id"), F.col("b.total").alias("line_total"), F.when(F.col("b").isNull(), F.col("_penalty")).otherwise(F.lit(0)).alias("missing_penalty"),
    )


def allocation_totals(allocation: DataFrame) -> DataFrame:
    """Per basket: lines found, stores used, money, money with penalties."""
    return allocation.groupBy("basket_id").agg(
        F.count("*").alias("n_lines"), F.count("store_id").alias("n_found"), F.countDistinct("store_id").alias("n_stores"),
        F.coalesce(F.sum("line_total"), F.lit(0)).alias("real_total"), (F.coalesce(F.sum("line_total"), F.lit(0)) + F.sum("missing_penalty")).alias("sorting_total"),
    )


def exhaustive(offer: DataFrame, chosen: DataFrame, most_stores: int = 3) -> DataFrame:
    """The best set of one to three candidates for each basket that passes the size gate.

    Every set is tried: sets come from a triangular join of a basket's candidates (at most 575), each line takes the
    cheapest store of the set. More lines found win, then the lower total, then fewer stores, then the smaller ids. An
    item that no store of the set has, but another candidate has, costs no penalty.
    """
    gate = offer.groupBy("basket_id").agg(F.countDistinct("item_id").alias("n_lines"))
    count = chosen.groupBy("basket_id").agg(F.count("*").alias("n_candidates"))
    passed = gate.join(count, "basket_id").where((F.col("n_lines") <= EXHAUSTIVE_LINES) & (F.col("n_candidates") <= EXHAUSTIVE_CANDIDATES))
    sold = offer.join(chosen, ["basket_id", "store_id"]).join(passed.select("basket_id"), "basket_id", "left_semi")
    # A basket's line as an array of totals by the candidate's place, so that sets are evaluated without more shuffles.
    by_place = F.map_from_entries(F.collect_list(F.struct("place", "total")))
    lines = sold.groupBy("basket_id", "item_id").agg(by_place.alias("totals"), F.first("penalty").alias("penalty"), F.first("quantity").alias("quantity"))
    baskets = lines.groupBy("basket_id").agg(F.collect_list(F.struct("totals", (F.col("penalty") * F.col("quantity")).alias("missing"))).alias("lines"))
    a = chosen.select("basket_id", F.col("place").alias("p1"))
    b = chosen.select("basket_id", F.col("place").alias("p2"))
    c = chosen.select("basket_id", F.col("place").alias("p3"))
    sets = a.select("basket_id", F.array("p1").alias("places"))
    if most_stores >= 2:
        pairs = a.join(b, "basket_id").where("p1 < p2")
        sets = sets.union(pairs.select("basket_id", F.array("p1", "p2")))
        if most_stores >= 3:
            sets = sets.union(pairs.join(c, "basket_id").where("p2 < p3").select("basket_id", F.array("p1", "p2", "p3")))
    tried = sets.join(baskets, "basket_id")
    best = lambda line: F.array_min(F.transform(F.col("places"), lambda p: line["totals"][p]))
    anywhere = lambda line: F.exists(F.map_values(line["totals"]), lambda t: t.isNotNull())
    found = F.size(F.filter("lines", lambda line: best(line).isNotNull()))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, line: s + F.coalesce(best(line), F.when(anywhere(line), F.lit(0)).otherwise(line["missing"])))
    scored = tried.select("basket_id", "places", found.alias("n_found"), total.alias("total"), F.size("places").alias("n_stores"), F.size("lines").alias("n_lines"))
    top = scored.groupBy("basket_id").agg(F.min(F.struct((-F.col("n_found")).alias("f"), "total", "n_stores", "places", "n_lines")).alias("t"))
    return top.select("basket_id", "t.places", (-F.col("t.f")).cast("long").alias("n_found"), F.col("t.total").alias("total"), F.col("t.n_stores").cast("long").alias("n_stores"))


def visit_order(allocation: DataFrame, distances: DataFrame) -> DataFrame:
    """The stores of each basket's split with their lines and totals, in the order of a tour by distance (unknown first, as 0), then id."""
    rows = allocation.where("store_id IS NOT NULL").groupBy("basket_id", "store_id").agg(F.count("*").alias("n_lines"), F.sum("line_total").alias("store_total"))
    rows = rows.join(distances.select("basket_id", "store_id", F.col("km").alias("_km")), ["basket_id", "store_id"], "left").withColumn("km", F.coalesce("_km", F.lit(0.0))).drop("_km")
    w = Window.partitionBy("basket_id").orderBy("km", "store_id")
    return rows.withColumn("visit", F.row_number().over(w).cast("long"))
