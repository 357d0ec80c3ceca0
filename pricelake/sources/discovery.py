"""Links to price files in portal pages, and manifests of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILE_TYPES = ("csv", "xml", "xlsx", "zip")


def links(pages: DataFrame, html: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Each page's different link targets, of any element, one row each, with the page's other columns but the HTML.

    With ``types`` only targets with one of these extensions, which a query string may follow.
    """
    ending = rf"\.(?:{'|'.join(types)})(?:\?[^\"']*)?" if types else ""
    rows = pages.withColumn("href", F.explode(F.regexp_extract_all(html, F.lit(rf"""(?i)href=["']([^"']*{ending})["']"""), F.lit(1)))).drop(html)
    keys = [c for c in ("page_id", "url") if c in rows.columns]
    return rows.dropDuplicates([*keys, "href"])


def resolved(href: Column, base: Column) -> Column:
    """A link as an absolute URL: absolute ones stay, others are put onto the page's scheme, host and folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) <= F.length(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)), F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    )


def file_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)


def file_type(name: Column) -> Column:
    """By extension; a file without a known one is taken as CSV."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(kind.isin(*FILE_TYPES), kind).otherwise("csv")


def discovered_files(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The files that pages link to: absolute URL, name and type, each URL once, the first page's."""
    rows = links(pages, html, FILE_TYPES).withColumn("file_url", resolved(F.col("href"), F.col(url))).withColumn("file_name", file_name(F.col("file_url")))
    w = Window.partitionBy("file_url").orderBy(url, "href")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_url", "file_name", file_type(F.col("file_name")).alias("file_type"))


# --- indexes and portals ----------------------------------------------------------------------------------------------


def index_entries(pages: DataFrame, body: str = "body", within: str | None = None) -> DataFrame:
    """A row for each entry of a JSON index, with the page's other columns: entry (texts by lower-case key) and error.

    ``within`` is the key of the list in an index that is an object. Entries may have any keys and lack any; nested values are JSON
    texts. A page that isn't such an index gives one row with an error; an empty list gives none.
    """
    text = F.get_json_object(body, f"$.{within}") if within else F.col(body)
    entries = F.from_json(text, "array<map<string,string>>", {"mode": "PERMISSIVE"})
    bad = F.struct(F.lit(None).cast("map<string,string>").alias("entry"), F.lit("not an index").alias("error"))

    def folded(entry: Column) -> Column:
        """A key that is there twice, in other letters, counts once, the first."""
        pairs = F.transform(F.map_entries(entry), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
        keys = F.transform(pairs, lambda x: x["key"])
        return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))

    rows = F.when(entries.isNull(), F.array(bad)).otherwise(F.transform(F.filter(entries, lambda e: e.isNotNull()), lambda e: F.struct(folded(e).alias("entry"), F.lit(None).cast("string").alias("error"))))
    return pages.withColumn("_row", F.explode(rows)).drop(body).select("*", "_row.entry", "_row.error").drop("_row")


def indexed_files(pages: DataFrame, name: str = "name", link: str = "url", day: str | None = None, day_pattern: str = r"_(\d{8})_", day_format: str = "ddMMyyyy", body: str = "body", within: str | None = None, url: str = "url") -> DataFrame:
    """The files of JSON indexes (file_url, file_name, file_type, checksum), each URL once, the first page's.

    ``name`` and ``link`` are the keys of an entry's name and link (which is put onto the page's URL). With ``day`` only
    files whose name has that day. Entries without a name or a link, and pages that aren't indexes, are left out.
    """
    rows = index_entries(pages, body, within).where("error IS NULL")
    rows = rows.select(F.col(url).alias("_page"), F.try_element_at("entry", F.lit(name.lower())).alias("file_name"), F.try_element_at("entry", F.lit(link.lower())).alias("_link"), F.try_element_at("entry", F.lit("sha")).alias("checksum"))
    rows = rows.where("file_name IS NOT NULL AND _link IS NOT NULL")
    if day:
        rows = rows.where(F.regexp_extract("file_name", day_pattern, 1) == F.date_format(F.lit(day).cast("date"), day_format))
    rows = rows.withColumn("file_url", resolved(F.col("_link"), F.col("_page")))
    first = F.min_by(F.struct("file_name", "checksum"), F.struct("_page", "file_name", "checksum")).alias("s")
    return rows.groupBy("file_url").agg(first).select("file_url", "s.file_name", file_type(F.col("s.file_name")).alias("file_type"), "s.checksum")


def portal_files(pages: DataFrame, parameter: str, html: str = "html", url: str = "url") -> DataFrame:
    """The files of a portal of two levels: pages that link to pages by ``parameter``, whose links are the files.

    Gives store (the parameter's value, decoded), file_url, file_name, file_type; a page that nothing links to isn't read.
    Both levels are rows of ``pages``, joined by the value and the page's address before the query.
    """
    value = rf"[?&]{parameter}=([^\"'&#]+)"
    root = lambda c: F.regexp_replace(c, r"[?#].*$", "")
    decoded = lambda c: F.try_url_decode(c)
    stores = pages.select(root(F.col(url)).alias("_root"), F.explode(F.regexp_extract_all(html, F.lit(value), F.lit(1))).alias("_store"))
    stores = stores.select("_root", decoded(F.col("_store")).alias("store")).distinct()
    shops = pages.where(F.col(url).rlike(value)).select(root(F.col(url)).alias("_root"), decoded(F.regexp_extract(url, value, 1)).alias("store"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = links(shops.join(stores, ["_root", "store"], "left_semi"), "html", FILE_TYPES)
    found = found.withColumn("file_url", resolved(F.col("href"), F.col("url"))).select("store", "file_url").distinct()
    name = file_name(F.col("file_url"))
    return found.select("store", "file_url", name.alias("file_name"), file_type(name).alias("file_type"))


def paged_files(pages: DataFrame, keys: list[str], page: str = "page", most: int = 50, html: str = "html", url: str = "url") -> DataFrame:
    """The files of lists in pages, read as a crawler would: from page 1 on, to the first that is missing or has no new file, ``most`` at most.

    ``keys`` tell the lists apart (as portal and day). Gives keys, file_url, file_name, file_type and the page of each file.
    """
    rows = links(pages.where(F.col(page).between(1, most)).select(*keys, page, F.col(url).alias("url"), F.col(html).alias("html")), "html", FILE_TYPES)
    first = rows.withColumn("file_url", resolved(F.col("href"), F.col("url"))).groupBy(*keys, "file_url").agg(F.min(page).alias(page))
    # Pages with something new, numbered: up to the first gap the number is the page's own.
    fresh = first.select(*keys, page).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(page))).where(F.col("_n") == F.col(page))
    kept = first.join(fresh.drop("_n"), [*keys, page], "left_semi")
    name = file_name(F.col("file_url"))
    return kept.select(*keys, "file_url", name.alias("file_name"), file_type(name).alias("file_type"), page)
