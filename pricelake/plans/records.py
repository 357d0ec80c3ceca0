"""Queries over listings and registries, with independent SQL; they join those of ``catalog``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import listings, matching, operations, registry
from .catalog import _INTERVALS, QUERIES, SQL, _intervals, _query, _with, barcode_outcomes
from .fixtures import table

__all__ = ["QUERIES", "SQL"]

# --- listings ---------------------------------------------------------------------------------------------------------


@_query(
    "jn1_store_prices",
    _with("store_prices", "items", "stores") + """select p.store_id, s.name as store_name, p.item_id, i.name as item_name, i.brand, p.price, p.discount_price
    from fx_store_prices p join fx_items i on i.item_id = p.item_id join fx_stores s on s.store_id = p.store_id where p.store_id = 'sto_0007'""",
)
def store_prices(spark: SparkSession, d: str) -> DataFrame:
    return listings.store_prices(table(spark, d, "store_prices"), table(spark, d, "items"), table(spark, d, "stores"), store="sto_0007")


@_query(
    "jn2_chain_catalog",
    _with("store_prices", "items", "stores") + """select lower(replace(r_name, ' ', '-')) as chain_slug, r_name as chain_name, p.store_id, s.name as store_name, p.item_id, i.name as item_name, p.price
    from fx_store_prices p join fx_items i on i.item_id = p.item_id join fx_stores s on s.store_id = p.store_id join region on lower(replace(r_name, ' ', '-')) = p.chain_slug where r_name <> 'ASIA'""",
)
def chain_catalog(spark: SparkSession, d: str) -> DataFrame:
    chains = table(spark, d, "region").where("r_name <> 'ASIA'").select(F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("chain_slug"), F.col("r_name").alias("name"))
    rows = listings.with_chains(table(spark, d, "store_prices"), chains).join(table(spark, d, "items").select("item_id", F.col("name").alias("item_name")), "item_id")
    rows = rows.join(table(spark, d, "stores").select("store_id", F.col("name").alias("store_name")), "store_id")
    return rows.select("chain_slug", "chain_name", "store_id", "store_name", "item_id", "item_name", "price")


@_query(
    "jn22_item_names",
    _with("group_prices", "items") + """select g.group_id, g.item_id, g.price, coalesce(i.name, 'Unknown Item') as item_name
    from fx_group_prices g left join (select * from fx_items where size <> 9) i on i.item_id = g.item_id""",
)
def item_names(spark: SparkSession, d: str) -> DataFrame:
    prices = table(spark, d, "group_prices").select("group_id", "item_id", "price")
    return listings.with_item_names(prices, table(spark, d, "items").where("size <> 9"))


@_query("prj1_run_times", _with("runs") + "select run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') as started from fx_runs")
def run_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").select("run_id", listings.shown(F.col("started_at")).alias("started"))


@_query("flt7_key_list", "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50)")
def key_list(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return listings.only(table(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_orderkey")


_SOLD = """with sold as (select l_partkey as item, l_suppkey as candidate, cast(sum(l_quantity) as bigint) as score from lineitem where l_quantity > 40 group by 1, 2),
    ranked as (select *, row_number() over (partition by item order by score desc, candidate) as rank from sold) """


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as candidates of parts, by what they sold of them in large lots."""
    line = table(spark, d, "lineitem").where("l_quantity > 40")
    sold = line.groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("candidate")).agg(F.sum("l_quantity").cast("long").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "candidate")
    return sold.withColumn("rank", F.row_number().over(best).cast("long"))


@_query(
    "prj2_nested_candidates",
    _SOLD + """, lists as (select item, cast(to_json(list(struct_pack(rank := rank, candidate := candidate, score := score) order by rank)) as varchar) as candidates from ranked where rank <= 5 group by 1)
    select p_partkey as item, coalesce(candidates, '[]') as candidates from part left join lists on item = p_partkey""",
)
def nested_candidates(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    return listings.nested(items, _ranked(spark, d), ["candidate", "score"]).withColumn("candidates", F.to_json("candidates"))


@_query(
    "wn10_price_history",
    _INTERVALS + """select store_key, item_key, price, valid_from, valid_to, row_number() over w as n, lead(price) over w as price_before
    from intervals window w as (partition by store_key, item_key order by valid_from desc)""",
)
def price_history(spark: SparkSession, d: str) -> DataFrame:
    return listings.price_history(_intervals(spark, d), ["store_key", "item_key"])


@_query("jn4_open_members", _INTERVALS + "select store_key, s_name as name, item_key, price, valid_from from intervals join supplier on s_suppkey = store_key where valid_to is null")
def open_members(spark: SparkSession, d: str) -> DataFrame:
    stores = table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_key"), F.col("s_name").alias("name"))
    return listings.open_members(_intervals(spark, d), stores, "store_key").select("store_key", "name", "item_key", "price", "valid_from")


# --- registries -------------------------------------------------------------------------------------------------------


@_query(
    "wn9_last_price_wins",
    _with("observations") + """select store_key, item_key, price, l_orderkey, l_linenumber from (select *, row_number() over (partition by store_key, item_key order by l_orderkey desc, l_linenumber desc, price desc) as n
    from fx_observations) where n = 1""",
)
def last_price_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observations").select("store_key", "item_key", "price", "l_orderkey", "l_linenumber")
    return registry.latest(rows, ["store_key", "item_key"], ["l_orderkey", "l_linenumber"])


@_query(
    "pg9_find_or_create",
    _with("observations") + """, newest as (select store_key % 5 as chain, item_key as external_id, price, row_number() over (partition by store_key % 5, item_key order by ts desc, l_orderkey desc, l_linenumber desc, price desc) as n from fx_observations)
    select chain, external_id, price, case when external_id % 2 = 0 then concat('known-', cast(external_id as varchar)) else concat('rit_', substr(sha256(concat(cast(chain as varchar), ':', cast(external_id as varchar))), 1, 20)) end as item_id,
    external_id % 2 <> 0 as is_new from newest where n = 1""",
)
def find_or_create(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "observations").selectExpr("store_key % 5 AS chain", "item_key AS external_id", "price", "ts", "l_orderkey", "l_linenumber")
    even = seen.where("external_id % 2 = 0").select("chain", "external_id").distinct()
    known = even.withColumn("item_id", F.concat(F.lit("known-"), F.col("external_id").cast("string")))
    made = registry.found_or_created(known, seen, ["chain", "external_id"], ["ts", "l_orderkey", "l_linenumber"], "rit_")
    return made.select("chain", "external_id", "price", "item_id", "is_new")


@_query(
    "pg10_registered_stores",
    """select cast(s_suppkey as varchar) as identifier, 'active' as status from supplier where s_suppkey % 3 = 0
    union all select distinct cast(l_suppkey as varchar), 'pending' from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 3 = 0)""",
)
def registered_stores(spark: SparkSession, d: str) -> DataFrame:
    stores = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("identifier"), F.lit("active").alias("status"))
    seen = table(spark, d, "lineitem").select(F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("identifier"))
    return registry.registered_stores(stores, seen)


@_query(
    "pg6_touched_groups",
    """with g as (select l_suppkey as group_id, max(l_shipdate) as last_seen from lineitem where l_quantity < 25 group by 1), s as (select l_suppkey as group_id, max(l_shipdate) as t from lineitem where l_quantity > 45 group by 1)
    select g.group_id, greatest(last_seen, coalesce(t, last_seen)) as last_seen from g left join s on s.group_id = g.group_id""",
)
def touched_groups(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    groups = line.where("l_quantity < 25").groupBy(F.col("l_suppkey").alias("group_id")).agg(F.max("l_shipdate").alias("last_seen"))
    return registry.touched(groups, line.where("l_quantity > 45").select(F.col("l_suppkey").alias("group_id"), "l_shipdate"), "group_id", "l_shipdate")


@_query(
    "ag20_storage_ratio",
    _with("group_prices", "store_prices") + """select grouped_rows, naive_rows, round(1 - grouped_rows * 1.0e0 / naive_rows, 6) as saved
    from (select (select count(*) from fx_group_prices) as grouped_rows, (select count(*) from fx_store_prices) as naive_rows)""",
)
def storage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return registry.storage_ratio(table(spark, d, "group_prices"), table(spark, d, "store_prices"))


# --- matching ---------------------------------------------------------------------------------------------------------

_EMBEDDED = """with items as (select p_partkey as item, p_size, substr(sha256(lower(p_name)), 1, 32) as text_hash from part),
    cache as (select item, case when p_size < 10 then 'v1' else 'v2' end as model_version, case when p_size between 10 and 20 then 'stale' else text_hash end as text_hash from items where p_size < 40) """


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_size", text.text_hash(F.lower("p_name")).alias("text_hash"))
    model, stale = F.when(F.col("p_size") < 10, "v1").otherwise("v2"), F.col("p_size").between(10, 20)
    cache = items.where("p_size < 40").select("item", model.alias("model_version"), F.when(stale, "stale").otherwise(F.col("text_hash")).alias("text_hash"))
    return items.select("item", "text_hash"), cache


@_query("mt9_embedding_cache", _EMBEDDED + "select i.item, i.text_hash, c.item is not null as is_hit from items i left join cache c on c.item = i.item and c.text_hash = i.text_hash and c.model_version = 'v2'")
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    return registry.embedding_cache(*_embedded(spark, d), "v2")


@_query("jn13_not_embedded", _EMBEDDED + "select item, text_hash from items where not exists (select 1 from cache c where c.item = items.item and model_version = 'v2')")
def not_embedded(spark: SparkSession, d: str) -> DataFrame:
    return registry.not_embedded(*_embedded(spark, d), "v2")


@_query(
    "mt13_candidate_upsert",
    """with old as (select l_partkey as item, l_suppkey as candidate, cast(sum(l_quantity) as bigint) as score from lineitem where l_shipdate < timestamp '1997-01-01' group by 1, 2),
    new as (select l_partkey as item, l_suppkey as candidate, cast(sum(l_quantity) as bigint) as score from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1, 2)
    select coalesce(n.item, o.item) as item, coalesce(n.candidate, o.candidate) as candidate, coalesce(n.score, o.score) as score from old o full join new n on n.item = o.item and n.candidate = o.candidate""",
)
def candidate_upsert(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("candidate"), "l_quantity", "l_shipdate")
    at = F.lit(datetime(1997, 1, 1))
    score = lambda rows: rows.groupBy("item", "candidate").agg(F.sum("l_quantity").cast("long").alias("score"))
    return operations.upserted(score(line.where(F.col("l_shipdate") < at)), score(line.where(F.col("l_shipdate") >= at)), ["item", "candidate"])


@_query("jn20_bulk_approved", _SOLD + "select p_partkey as item, 'approved' as status, candidate from part join ranked on item = p_partkey and rank = 1 where p_size > 30")
def bulk_approved(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 30, "pending").otherwise("done").alias("status"))
    return registry.bulk_approved(queue, _ranked(spark, d))


@_query(
    "ag13_outcome_counts",
    """select count(*) as total, count(*) filter (where outcome = 'link') as link, count(*) filter (where outcome = 'queue') as queue, count(*) filter (where outcome = 'create') as "create",
    count(*) filter (where sanity = 'name_mismatch') as name_mismatch, count(*) filter (where sanity = 'brand_conflict') as brand_conflict, count(*) filter (where sanity = 'unit_mismatch') as unit_mismatch
    from (""" + SQL["mt5_barcode_outcomes"] + ")",
)
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = barcode_outcomes(spark, d)
    kinds = registry.counted(rows, "outcome", ["link", "queue", "create"]) + registry.counted(rows, "sanity", ["name_mismatch", "brand_conflict", "unit_mismatch"])
    return rows.agg(F.count("*").alias("total"), *kinds)


@_query(
    "mt12_brand_conflicts",
    """select a.p_partkey as item, coalesce(lower(trim(a.p_brand)) <> lower(trim(b.p_brand)), false) as conflict
    from part a left join part b on b.p_partkey = a.p_partkey + 1""",
)
def brand_conflicts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("own"))
    b = a.select((F.col("item") - 1).alias("item"), F.col("own").alias("other"))
    return a.join(b, "item", "left").select("item", F.coalesce(matching.brand_conflict(F.col("own"), F.col("other")), F.lit(False)).alias("conflict"))


@_query(
    "bo1_request_errors",
    _with("baskets") + """, lines as (select basket_id, case when basket_id % 50 = 0 then '' else chain_slug end as chain_slug, case when quantity = 7 then ' ' else item_id end as item_id, quantity - 3 as quantity from fx_baskets),
    per as (select basket_id, count(*) as n_lines, max(chain_slug) as c, count(*) filter (where item_id = ' ') as b, count(*) filter (where quantity <= 0) as z from lines group by 1)
    select basket_id, n_lines, concat_ws(',', case when c = '' then 'chain_missing' end, case when b > 0 then 'item_missing' end, case when z > 0 then 'quantity_not_positive' end) as errors from per""",
)
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "baskets").selectExpr(
        "basket_id", "CASE WHEN basket_id % 50 = 0 THEN '' ELSE chain_slug END AS chain_slug", "CASE WHEN quantity = 7 THEN ' ' ELSE item_id END AS item_id", "quantity - 3 AS quantity"
    )
    return registry.request_errors(lines)
