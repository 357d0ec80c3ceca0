"""Queries over file names, indexes and portal pages, which are made from a table, and SQL that gives their rows from that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import discovery, file_names
from .files import QUERIES, SQL, _query
from .fixtures import table

__all__ = ["QUERIES", "SQL"]

_TOWNS = ("ZAGREB", "RIJEKA", "SPLIT", "OSIJEK", "ZADAR")
_KEY = "cast(s_suppkey as varchar)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    """A file of each supplier, in the layout of one of ten chains; every eleventh is named in no layout."""
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).alias("c"))
    towns = F.array(*map(F.lit, _TOWNS))
    town = F.element_at(towns, (F.col("s_suppkey") % 5 + 1).cast("int"))
    key, code = F.col("s_suppkey").cast("string"), F.lpad((F.col("s_suppkey") % 90000 + 10000).cast("string"), 5, "0")
    name = F.lit(None).cast("string")
    layouts = {
        "konzum": ("SUPERMARKET,ILICA+DUGA+", key, "+", code, "+", town, ",0204,15.01.2024,07.csv"),
        "lidl": ("Supermarket 265_Ulica duga_", key, "_", code, "_", town, "_1_16.12.2025_7.15h.csv"),
        "plodine": ("HIPERMARKET_ULICA DUGA_", key, "_", code, "_", town, "_007_3_2.csv"),
        "kaufland": ("Hipermarket_Ulica_10000_", key, "_", code, "_", town, "_1234_15012024_2.csv"),
        "eurospin": ("diskontna_prodavaonica-310012-Ulica_", key, "-", town, "-", code, "-1.csv"),
        "interspar": ("hipermarket_", town, "_ulica_duga_", key, "_8701_interspar_x_y_2024.csv"),
        "metro": ("cash_METRO_20240115T0630_S12_ULICA_", key, ",", town, ".csv"),
        "studenac": ("SUPERMARKET-Ulica_duga_", key, "_", town, "-T598-230.xml"),
        "trgocentar": ("SUPERMARKET_ulica_", key, "_", town, "_P220_1.xml"),
        "ktc": ("TRGOVINA-ULICA ", key, " ", town, "-PJ5A-1-20240115-071500.csv"),
    }
    text = lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    for i, parts in enumerate(layouts.values()):
        name = F.when(F.col("c") == i, text(parts)).otherwise(name)
    rows = rows.withColumn("file", F.when(F.col("s_suppkey") % 11 == 0, F.concat(F.lit("list"), key, F.lit(".csv"))).otherwise(name))
    store = F.lit(None)
    for i, chain in enumerate(layouts):
        store = F.when(F.col("c") == i, file_names.store_metadata(F.col("file"), chain)).otherwise(store)
    return rows.withColumn("chain", F.element_at(F.array(*map(F.lit, layouts)), (F.col("c") + 1).cast("int"))).withColumn("s", store)


@_query(
    "f24_store_metadata",
    f"""with rows as (select s_suppkey, s_suppkey % 10 as c, {_KEY} as k, [{", ".join(f"'{t}'" for t in _TOWNS)}][cast(s_suppkey % 5 + 1 as int)] as town, cast(s_suppkey % 90000 + 10000 as varchar) as code,
        ['Konzum', 'Lidl', 'Plodine', 'Kaufland', 'Eurospin', 'Interspar', 'Metro', 'Studenac', 'Trgocentar', 'KTC'][cast(s_suppkey % 10 + 1 as int)] as shown from supplier),
    told as (select *, concat(left(town, 1), lower(substr(town, 2))) as t from rows where s_suppkey % 11 <> 0)
    select s_suppkey, shown as chain_name, case c when 0 then concat('SUPERMARKET ILICA DUGA ', k, ' ', town) when 3 then concat('Hipermarket ', t) when 8 then concat('Trgocentar Ulica ', k, ' ', t) else concat(shown, ' ', t) end as name,
        case when c = 0 then concat('ILICA DUGA ', k) when c = 3 then concat('Ulica 10000 ', k) when c in (1, 2, 5, 7) then concat('Ulica Duga ', k) when c = 8 then concat('Ulica ', k, ' ', t) else concat('Ulica ', k) end as address,
        case when c = 0 then town when c <> 8 then t end as town, case when c < 5 then code end as postal_code,
        case c when 0 then 'SUPERMARKET' when 1 then 'Supermarket' when 2 then 'Hipermarket' when 3 then 'Hipermarket' when 4 then 'Diskontna Prodavaonica' when 5 then 'Hipermarket' when 7 then 'SUPERMARKET' when 8 then 'SUPERMARKET' end as kind from told
    union all select s_suppkey, shown, concat(shown, ' list', k), null, null, null, null from rows where s_suppkey % 11 = 0""",
)
def store_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("s_suppkey", file_names.chain_name(F.col("chain")).alias("chain_name"), "s.name", "s.address", "s.town", "s.postal_code", "s.kind")


@_query(
    "f26_file_days",
    """select o_orderkey, case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) end as day from orders""",
)
def file_days(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    chains = ("lidl", "ktc", "eurospin", "metro", "studenac", "trgocentar", "kaufland")
    shapes = ("'na_dan_'dd_MM_yyyy'.zip'", "'TRGOVINA-A-PJ1-1-'yyyyMMdd'-071500.csv'", "'cjenik_'dd.MM.yyyy'-7.30.zip'", "'x_METRO_'yyyyMMdd'T0630_S12_A.csv'", "'SUPERMARKET-A-T598-230-'yyyy-MM-dd'-07.xml'", "'SUPERMARKET_A_P220_005_'ddMMyyyy'0730.xml'", "'Hipermarket_A_1234_'ddMMyyyy'_2.csv'")
    bad = ("na_dan_31_02_2024.zip", "A-20241301-071500.csv", "cjenik_00.01.2024.zip", "METRO_20240230T0630", "A-T598-2024-13-01.xml", "list.xml", "A_99999999_1.csv")
    day: Column = F.lit(None).cast("date")
    for i, (chain, shape, wrong) in enumerate(zip(chains, shapes, bad, strict=True)):
        name = F.when(F.col("o_orderkey") % 17 == 0, wrong).otherwise(F.date_format("o_orderdate", shape))
        day = F.when(F.col("o_orderkey") % len(chains) == i, file_names.day_of(name, chain)).otherwise(day)
    return rows.select("o_orderkey", day.alias("day"))


_INDEX_DAY = "2024-01-15"


def index_pages(spark: SparkSession, d: str) -> DataFrame:
    """JSON indexes of 50 parts each, as lists and as objects with other letters, with entries that lack keys, and broken ones."""
    rows = table(spark, d, "part").withColumn("p", F.floor(F.col("p_partkey") / 50).cast("long"))
    key = F.col("p_partkey").cast("string")
    day = F.when(F.col("p_partkey") % 3 == 0, "16012024").otherwise("15012024")
    name = F.concat(F.lit("Hipermarket_A_"), key, F.lit("_"), day, F.lit("_1."), F.when(F.col("p_size") % 2 == 0, "csv").otherwise("XML"))
    path = F.concat(F.lit("/d/"), (F.col("p_partkey") - F.col("p_partkey") % 2).cast("string"), F.lit(".csv"))
    entry = F.when(F.col("p_size") == 5, F.lit('{"other": [1, {"a": 2}]}')).otherwise(
        F.when(F.col("p") % 2 == 0, F.to_json(F.struct(name.alias("label"), path.alias("path"), F.col("p_size").alias("extra")))).otherwise(F.to_json(F.struct(name.alias("Label"), path.alias("PATH"), F.lower("p_brand").alias("SHA"))))
    )
    list_ = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda s: s["e"]), ", "), F.lit("]"))
    pages = rows.groupBy("p").agg(list_.alias("list"))
    body = F.when(F.col("p") % 5 == 4, F.substring("list", 1, 20)).when(F.col("p") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"count": 3, "files": '), F.col("list"), F.lit("}")))
    return pages.select(F.concat(F.lit("https://shop.example/api/"), F.lpad(F.col("p").cast("string"), 6, "0")).alias("url"), "p", body.alias("body"))


@_query(
    "src15_json_index",
    """with rows as (select *, p_partkey // 50 as p, concat('https://shop.example/d/', cast(p_partkey - p_partkey % 2 as varchar), '.csv') as file_url,
        concat('Hipermarket_A_', cast(p_partkey as varchar), '_15012024_1.', case when p_size % 2 = 0 then 'csv' else 'XML' end) as file_name from part),
    kept as (select *, row_number() over (partition by file_url order by p, file_name) as n from rows where p % 5 <> 4 and p_size <> 5 and p_partkey % 3 <> 0)
    select file_url, file_name, case when p_size % 2 = 0 then 'csv' else 'xml' end as file_type, case when p % 2 = 1 then lower(p_brand) end as checksum from kept where n = 1""",
)
def json_index(spark: SparkSession, d: str) -> DataFrame:
    pages = index_pages(spark, d)
    how = {"name": "label", "link": "path", "day": _INDEX_DAY}
    lists = discovery.indexed_files(pages.where("p % 2 = 0").drop("p"), **how)
    objects = discovery.indexed_files(pages.where("p % 2 = 1").drop("p"), **how, within="files")
    return lists.union(objects)


@_query(
    "src15_portal",
    """select concat('RC ', n_name, ' PJ-', cast(n_nationkey as varchar)) as store, concat('https://shop.example/', case when s_suppkey % 2 = 0 then 'lists/' else '' end, 'c', cast(s_suppkey as varchar), '.csv') as file_url,
        concat('c', cast(s_suppkey as varchar), '.csv') as file_name, 'csv' as file_type
    from supplier join nation on n_nationkey = s_nationkey where n_nationkey % 4 <> 3 and s_suppkey % 7 <> 6""",
)
def portal(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").withColumn("q", F.concat(F.lit("RC%20"), F.col("n_name"), F.lit("%20PJ-"), F.col("n_nationkey")))
    shown = F.concat(F.lit('<a href="?poslovnica='), F.col("q"), F.lit('&amp;x=1">shop</a>'))
    index = nation.where("n_nationkey % 4 <> 3").groupBy().agg(F.array_join(F.collect_list(shown), "\n").alias("html")).select(F.lit("https://shop.example/lists/index.php").alias("url"), "html")
    href = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("/"), F.lit("c"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 7 == 6, ".html").otherwise(".csv"))
    listed = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list(F.concat(F.lit("<li><A HREF='"), href, F.lit("'>f</A> <a href='"), href, F.lit("'>f</a></li>"))), "\n").alias("html"))
    shops = nation.join(listed, "n_nationkey").select(F.concat(F.lit("https://shop.example/lists/index.php?poslovnica="), F.col("q")).alias("url"), "html")
    return discovery.portal_files(index.union(shops), "poslovnica")


@_query(
    "src15_paged_list",
    """with listed as (select o_custkey % 40 as list, o_orderkey % 9 + 1 as page, o_orderkey // 2 as f from orders where not (o_custkey % 40 % 3 = 1 and o_orderkey % 9 + 1 = 4)),
    first as (select list, f, min(page) as page from listed group by 1, 2),
    numbered as (select list, page, row_number() over (partition by list order by page) as n from (select distinct list, page from first))
    select first.list, concat('https://shop.example/f', cast(f as varchar), '.csv') as file_url, concat('f', cast(f as varchar), '.csv') as file_name, 'csv' as file_type, first.page
    from first join numbered on numbered.list = first.list and numbered.page = first.page and n = first.page where first.page <= 7""",
)
def paged_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("list"), (F.col("o_orderkey") % 9 + 1).alias("page"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("f"))
    link = F.concat(F.lit('<a href="/f'), F.col("f"), F.lit('.csv">f</a>'))
    full = rows.where("NOT (list % 3 = 1 AND page = 4)").groupBy("list", "page").agg(F.array_join(F.collect_list(link), " ").alias("html"))
    # Every third list has a page without files.
    bare = rows.where("list % 3 = 1 AND page = 4").select("list", "page", F.lit("<p>none</p>").alias("html")).distinct()
    pages = full.union(bare).withColumn("url", F.concat(F.lit("https://shop.example/lists?page="), F.col("page")))
    return discovery.paged_files(pages, ["list"], most=7)
