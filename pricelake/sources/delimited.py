"""Delimited text with encoding, delimiter and columns found out per file, as one normalised schema.

Files are read whole as binary rows (one file a row), decoded and split by SQL functions, so many files are one job. A
physical line is a record, as in the price lists this is for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import barcode_list
from ..functions.money import parse_date, parse_price
from ..functions.text import decoded_bytes, normalize_header

TEXT_FIELDS = (
    "store_identifier", "external_id", "name", "description", "category", "subcategory", "brand", "unit", "unit_quantity", "image_url",
    "unit_price_base_quantity", "unit_price_base_unit",
)
PRICE_FIELDS = ("price", "discount_price", "unit_price", "lowest_price_30d", "anchor_price")
DATE_FIELDS = ("discount_start", "discount_end", "anchor_price_as_of")
DELIMITERS = (",", ";", "\t")


@dataclass(frozen=True)
class Dialect:
    """How a source writes its files.

    ``columns`` has the headers (paths in an item for markup, digits for positions from 0) of each field in the order of preference,
    ``store_patterns`` what finds the store in a file's name, ``renamed`` patterns of headers that hold a date, and
    their names without it, ``tags`` the elements that hold an item, and ``store`` the store of every file, where a list is the same everywhere.
    """

    name: str
    columns: dict[str, tuple[str, ...]]
    delimiter: str | None = None
    encoding: str | None = None
    store_patterns: tuple[str, ...] = ()
    skipped_rows: int = 0
    renamed: tuple[tuple[str, str], ...] = ()
    tags: tuple[str, ...] = ()
    store: str | None = None


def decoded(content: Column, encoding: str | None = None) -> Column:
    """File bytes as text: valid UTF-8 always, without its mark, else the encoding given or windows-1250."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, content.cast("string")).otherwise(decoded_bytes(content, encoding or "windows-1250"))
    return F.regexp_replace(text, "^\\ufeff", "")


def found_delimiter(text: Column) -> Column:
    """The delimiter whose counts in the first five lines are many and even: mean / (1 + variance), ties to the comma."""
    lines = F.slice(F.filter(F.split(text, "\r?\n"), lambda s: F.trim(s) != ""), 1, 5)

    def score(d: str) -> Column:
        counts = F.transform(lines, lambda s: (F.length(s) - F.length(F.replace(s, F.lit(d), F.lit("")))).cast("double"))
        n = F.size(lines).cast("double")
        mean = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / n
        power = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x) / n
        return F.when(n > 0, mean / (1 + power - mean * mean)).otherwise(0.0)

    best = F.lit(DELIMITERS[0])
    top = score(DELIMITERS[0])
    for d in DELIMITERS[1:]:
        s = score(d)
        best, top = F.when(s > top, d).otherwise(best), F.greatest(s, top)
    return best


def fields_of(line: Column, delimiter: Column) -> Column:
    """The fields of a line: quotes may hold delimiters, doubled quotes stand for one; fields are trimmed."""
    mark = "\x01"
    # Inside quotes, delimiters are put aside before splitting: pieces at odd places between quotes are quoted.
    pieces = F.split(F.replace(line, F.lit('""'), F.lit("\x02")), '"')
    inside = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.replace(p, delimiter, F.lit(mark))).otherwise(p))
    cells = F.split(F.array_join(inside, ""), F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))
    return F.transform(cells, lambda c: F.trim(F.replace(F.replace(F.replace(c, F.lit(mark), delimiter), F.lit("\x02"), F.lit('"')), F.lit("\r"), F.lit(""))))


def store_of(file_name: Column, dialect: Dialect) -> Column:
    """The dialect's one store, or the store in a file's name by the first of its patterns that fits, else the name without its extension."""
    if dialect.store:
        return F.lit(dialect.store)
    name = F.url_decode(F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"[+%](?![0-9A-Fa-f]{2})", " "))
    found = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in dialect.store_patterns]
    return F.coalesce(*found, F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""))


def headers_of(cells: Column, dialect: Dialect) -> Column:
    """A file's header cells as they are compared, those that hold a date without it."""

    def plain(cell: Column) -> Column:
        for pattern, name in dialect.renamed:
            cell = F.regexp_replace(F.trim(cell), pattern, name)
        return normalize_header(cell)

    return F.transform(cells, plain)


def _cell(dialect: Dialect, name: str) -> Column:
    """The first filled cell under any of a field's headers; a header of digits is a position from 0."""
    cells = []
    for header in dialect.columns.get(name, ()):
        if header.isdigit():
            cells.append(F.try_element_at("cells", F.lit(int(header) + 1)))
        else:
            plain = normalize_header(F.lit(header))
            at = F.array_position("headers", plain).cast("int")
            cells.append(F.when(at > 0, F.try_element_at("cells", F.greatest(at, F.lit(1)))))
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cells]) if cells else F.lit(None).cast("string")


def missing(dialect: Dialect, needed: tuple[str, ...] = ("name", "price")) -> Column:
    """Those of the needed fields that none of a file's headers serves, as an array; fields by position are never missing."""
    absent = lambda f: ~F.arrays_overlap("headers", F.array(*[normalize_header(F.lit(h)) for h in dialect.columns[f]]))
    named = [f for f in needed if not any(h.isdigit() for h in dialect.columns[f])]
    return F.array_compact(F.array(*[F.when(absent(f), F.lit(f)) for f in named]).cast("array<string>"))


def missing_columns(files: DataFrame, dialect: Dialect, needed: tuple[str, ...] = ("name", "price")) -> DataFrame:
    """(file, field) of files that have none of a needed field's headers, whose rows would all lack it."""
    return _with_lines(files, dialect).select("file", F.explode(missing(dialect, needed)).alias("field"))


def _with_lines(files: DataFrame, dialect: Dialect) -> DataFrame:
    text = decoded(F.col("content"), dialect.encoding)
    rows = files.select(F.col("path").alias("file"), text.alias("_text"))
    rows = rows.withColumn("_delimiter", F.lit(dialect.delimiter) if dialect.delimiter else found_delimiter(F.col("_text")))
    lines = F.filter(F.split("_text", "\r?\n"), lambda s: F.trim(s) != "")
    rows = rows.withColumn("_lines", F.slice(lines, dialect.skipped_rows + 1, 1_000_000_000))
    return rows.withColumn("headers", headers_of(fields_of(F.try_element_at("_lines", F.lit(1)), F.col("_delimiter")), dialect))


def normalised(files: DataFrame, dialect: Dialect) -> DataFrame:
    """Rows of files (path, content) in the normalised schema, with row_number, raw_data (the cells as JSON) and error.

    A field's headers are tried row by row, so that an alternative column serves where the primary one is empty. Blank
    lines are left out; a file without lines gives no rows. A file without a column for the name or the price gives one row
    with an error that tells which, and no fields.
    """
    rows = _with_lines(files, dialect).withColumn("_missing", missing(dialect))
    rows = rows.withColumn("_error", F.when(F.size("_missing") > 0, F.concat(F.lit("no column for "), F.array_join("_missing", ", "))))
    lines = F.when(F.col("_error").isNotNull() & (F.size("_lines") > 0), F.array(F.lit(""))).otherwise(F.slice("_lines", 2, 1_000_000_000))
    rows = rows.select("file", "headers", "_delimiter", "_error", F.posexplode(lines).alias("_at", "_line"))
    rows = rows.withColumn("cells", fields_of(F.col("_line"), F.col("_delimiter"))).where(F.col("_error").isNotNull() | F.exists("cells", lambda c: c != ""))
    good = F.col("_error").isNull()
    return from_cells(rows, dialect, lambda name: _cell(dialect, name), F.when(good, F.col("_at") + 1).cast("int"), F.when(good, F.to_json("cells")), F.col("_error"))


def from_cells(rows: DataFrame, dialect: Dialect, cell, number: Column, raw: Column, error: Column) -> DataFrame:
    """The normalised schema from a function that gives a field's text; rows with an error have nothing else but their file and store."""
    made = {name: cell(name) for name in TEXT_FIELDS}
    made["store_identifier"] = F.coalesce(made["store_identifier"], store_of(F.col("file"), dialect))
    made |= {name: parse_price(cell(name)) for name in PRICE_FIELDS}
    made |= {name: parse_date(cell(name), zoned=True) for name in DATE_FIELDS}
    made["barcodes"] = barcode_list(cell("barcodes"))
    return rows.select("file", *[c.alias(n) for n, c in made.items()], number.alias("row_number"), raw.alias("raw_data"), error.alias("error"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows of path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_delimited(spark: SparkSession, path: str, dialect: Dialect, pattern: str = "*.csv") -> DataFrame:
    return normalised(read_files(spark, path, pattern), dialect)
