"""Barcodes, distances and similarities, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def check_digit_ok(code: Column) -> Column:
    """Whether a code of 13 digits ends in its EAN-13 check digit."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.lit(0),
        lambda a, i: a + F.substring(code, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1),
    )
    digit = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))
    return F.coalesce((F.length(code) == 13) & (digit == F.substring(code, 13, 1).try_cast("int")), F.lit(False))


def normalize_barcode(code: Column) -> Column:
    """Digits alone, 12 of them with a leading 0; empty for codes that identify nothing.

    These are codes of zeros, codes for use within a shop (13 digits from 20 to 29) and wrong check digits. Codes of
    other lengths stay as they are.
    """
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9]", "")
    full = F.when(F.length(digits) == 12, F.concat(F.lit("0"), digits)).otherwise(digits)
    return (
        F.when(digits.rlike("^0*$"), "")
        .when((F.length(digits) == 13) & digits.startswith("2"), "")
        .when((F.length(full) == 13) & ~check_digit_ok(full), "")
        .otherwise(full)
    )


def with_check_digit(twelve: Column) -> Column:
    """Twelve digits and the check digit that belongs to them."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.lit(0),
        lambda a, i: a + F.substring(twelve, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1),
    )
    return F.concat(twelve, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def barcode_list(cell: Column) -> Column:
    """The codes in a cell, which commas, semicolons or bars separate."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def is_gtin(code: Column) -> Column:
    return code.rlike("^[0-9]{8,14}$")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of the earth's mean radius."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def characters(text: Column) -> Column:
    """The different characters of a text; none for an empty one."""
    return F.filter(F.array_distinct(F.split(F.coalesce(text, F.lit("")), "")), lambda c: c != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of the character sets of two texts; equal texts give 1, one empty text 0."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    x, y = characters(a), characters(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(both / F.size(F.array_union(x, y)))


def trigrams(text: Column) -> Column:
    """The different trigrams of a text's words, each with two blanks before and one after it, in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z\\u00df-\\u024f]+"), lambda w: w != "")
    framed = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(framed, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unlike lengths and for zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
