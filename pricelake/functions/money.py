"""Prices and dates from text, Column to Column. Money is a long number of cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What prices are written with, and the layouts of dates in the order in which they are tried.
CURRENCY_SIGNS = "€$£₹¥¢"
CURRENCY_WORDS = "KN|KUNA|HRK|EUR|USD"
DATE_LAYOUTS = ("yyyy-MM-dd", "dd.MM.yyyy", "d.M.yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
ZONED_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _plain_number(text: Column, first_comma_only: bool = False) -> Column:
    """One decimal point and no thousands marks: the later of comma and point is the decimal mark."""
    comma, point = F.instr(F.reverse(text), ","), F.instr(F.reverse(text), ".")
    european = (comma > 0) & ((point == 0) | (comma < point))
    no_points = F.replace(text, F.lit("."), F.lit(""))
    swapped = F.regexp_replace(no_points, "^([^,]*),", "$1.") if first_comma_only else F.replace(no_points, F.lit(","), F.lit("."))
    return F.when(european, swapped).otherwise(F.replace(text, F.lit(","), F.lit("")))


def _cents(number: Column) -> Column:
    return F.round(number.try_cast("decimal(20,6)") * 100, 0).cast("long")


def parse_price(text: Column) -> Column:
    """Cents of a price as people write it; null if no number is at its start. Halves round away from zero.

    Currency signs and words, and blanks of any kind, don't count; what follows the number is ignored.
    """
    bare = F.upper(F.regexp_replace(text, rf"[{CURRENCY_SIGNS}\s ]", ""))
    bare = F.regexp_replace(bare, rf"({CURRENCY_WORDS})$", "")
    number = F.regexp_extract(_plain_number(bare), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    return _cents(F.nullif(number, F.lit("")))


def parse_price_strict(text: Column) -> Column:
    """The spreadsheet form: the whole cell must be a number, and only the first comma is a decimal mark."""
    bare = F.upper(F.regexp_replace(text, rf"[{CURRENCY_SIGNS}\s ]", ""))
    bare = F.regexp_replace(bare, rf"({CURRENCY_WORDS})$", "")
    number = _plain_number(bare, first_comma_only=True)
    return _cents(F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), number))


def format_cents(cents: Column, european: bool = False) -> Column:
    text = F.format_string("%.2f", cents / 100)
    return F.replace(text, F.lit("."), F.lit(",")) if european else text


def parse_date(text: Column, zoned: bool = False) -> Column:
    """The timestamp of the first layout that fits; null if none does."""
    layouts = DATE_LAYOUTS + (ZONED_LAYOUTS if zoned else ())
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(layout)) for layout in layouts])


def parse_sheet_date(text: Column) -> Column:
    """A spreadsheet date: a serial number of days (with its leap year of 1900), an ISO date, or d.m.yyyy or d/m/yyyy."""
    cell = F.trim(text)
    serial = cell.try_cast("double")
    seconds = F.round((serial - F.when(serial > 59, 1).otherwise(0)) * 86400).cast("long")
    # Day 1 is 1900-01-01; from day 60 on, a 29th of February that never was is counted.
    epoch = F.lit("1899-12-31").cast("timestamp")
    from_serial = F.timestamp_add("SECOND", seconds, epoch)
    iso = F.try_to_timestamp(F.regexp_extract(cell, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    european = F.try_to_timestamp(F.replace(cell, F.lit("/"), F.lit(".")), F.lit("d.M.yyyy"))
    return F.when(serial.isNotNull(), from_serial).otherwise(F.coalesce(iso, european))


def effective_price(price: Column, discount: Column) -> Column:
    """The discount if there is one that lowers the price, else the price."""
    return F.when(discount.isNotNull() & (discount > 0) & (discount < price), discount).otherwise(price)


def coverage_bin(ratio: Column) -> Column:
    """4 for all of a basket, then 3 from 0.9, 2 from 0.8, else 1."""
    return F.when(ratio >= 1.0, 4).when(ratio >= 0.9, 3).when(ratio >= 0.8, 2).otherwise(1)


def health_class(rate: Column) -> Column:
    return F.when(rate > 0.10, "critical").when(rate > 0.03, "degraded").otherwise("healthy")
