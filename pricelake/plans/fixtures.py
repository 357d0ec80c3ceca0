"""The retail model over the star-schema tables, as SQL that Spark and DuckDB read alike.

A nation with three price tiers is three stores, a region is a chain, parts are items, an order is a basket, line
items are price observations, events are ingestion runs. Prices come from 15 lists (region and tier) over all parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

FIXTURES: dict[str, str] = {
    "stores": """
        select concat('sto_', lpad(cast(n_nationkey * 3 + tier as varchar(20)), 4, '0')) as store_id, n_nationkey * 3 + tier as store_key,
               lower(replace(r_name, ' ', '-')) as chain_slug, concat(n_name, ' ', cast(tier as varchar(20))) as name, n_name as city,
               42.3e0 + ((n_nationkey * 3 + tier) * 37 % 420) / 100.0e0 as latitude, 13.5e0 + ((n_nationkey * 3 + tier) * 53 % 590) / 100.0e0 as longitude,
               case when tier = 2 and n_nationkey > 20 then 'pending' else 'active' end as status, tier, tier = 0 as is_virtual,
               case when tier = 1 then concat('sto_', lpad(cast(n_nationkey * 3 as varchar(20)), 4, '0')) end as price_source_store_id
        from {nation} join {region} on n_regionkey = r_regionkey cross join (select 0 as tier union all select 1 union all select 2) as tiers""",
    "items": """
        select concat('rit_', lpad(cast(p_partkey as varchar(20)), 9, '0')) as item_id, p_partkey as item_key, p_name as name, p_brand as brand,
               p_type as category, p_size as size, p_retailprice as retail from {part}""",
    "group_prices": """
        select concat(lower(replace(r_name, ' ', '-')), '-', cast(tier as varchar(20))) as group_id, lower(replace(r_name, ' ', '-')) as chain_slug, tier,
               concat('rit_', lpad(cast(p_partkey as varchar(20)), 9, '0')) as item_id,
               cast(floor(p_retailprice * (100 + 5 * tier) + 0.5e0) as bigint) as price,
               case when p_size between 10 + tier and 20 + tier then cast(floor(p_retailprice * (100 + 5 * tier) * 0.8e0 + 0.5e0) as bigint) end as discount_price
        from {part} cross join {region} cross join (select 0 as tier union all select 1 union all select 2) as tiers
        where not (p_size between 12 * tier + 1 and 12 * tier + 8)""",
    "store_prices": """
        select s.chain_slug, s.store_id, g.group_id, g.item_id, g.price, g.discount_price
        from ({stores}) s join ({group_prices}) g on s.chain_slug = g.chain_slug and s.tier = g.tier where s.status = 'active'""",
    "exceptions": """
        select s.store_id, g.item_id, cast(floor(g.price * 0.9e0 + 0.5e0) as bigint) as price, cast(null as bigint) as discount_price,
               case when i.size > 25 then timestamp '1999-01-01 00:00:00' else timestamp '1997-01-01 00:00:00' end as expires_at
        from ({stores}) s join ({group_prices}) g on s.chain_slug = g.chain_slug join ({items}) i on i.item_id = g.item_id
        where s.tier = 1 and g.tier = 0 and s.status = 'active' and i.size in (3, 15, 27, 45)""",
    "observations": """
        select l_suppkey as store_key, l_partkey as item_key, l_shipdate as ts, l_orderkey, l_linenumber,
               cast(floor(l_extendedprice * 100 / l_quantity + 0.5e0) as bigint) as price,
               case when l_discount > 0 then cast(floor(l_extendedprice * 100 / l_quantity * (1 - l_discount) + 0.5e0) as bigint) end as discount_price
        from {lineitem}""",
    "baskets": """
        select o_orderkey as basket_id, lower(replace(r_name, ' ', '-')) as chain_slug,
               concat('rit_', lpad(cast(l_partkey as varchar(20)), 9, '0')) as item_id, cast(sum(l_quantity) as bigint) as quantity
        from {orders} join {lineitem} on o_orderkey = l_orderkey join {customer} on o_custkey = c_custkey
             join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
        group by 1, 2, 3""",
    "runs": """
        select event_id as run_id, ts as started_at, concat('chain-', cast(user_id % 11 as varchar(20))) as chain_slug,
               case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'running' else 'pending' end as status,
               cast(user_id % 7 as bigint) as files from {events}""",
    "tasks": """
        select o_orderkey as task_id, case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'claimed' end as status,
               cast(substr(o_orderpriority, 1, 1) as bigint) as priority, o_orderdate as scheduled_for from {orders}""",
}


def sql(name: str, **tables: str) -> str:
    """A fixture's SQL, the fixtures that it is made of written out in it."""
    text = FIXTURES[name]
    parts = {f: sql(f, **tables) for f in FIXTURES if f"{{{f}}}" in text}
    return text.format(**{t: t for t in TABLES} | tables | parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table, or a fixture over raw tables."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = sql(name, **{t: f"{{{t}}}" for t in TABLES})
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)
