"""Text normalisation and hashing, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand names that mean no brand, and unit synonyms.
GENERIC_BRANDS = ("n/a", "nepoznato", "unknown", "-", "", "private label", "own brand")
UNIT_SYNONYMS = {"ltr": "l", "lit": "l", "gr": "g", "pcs": "kom", "pack": "kom"}

# Letters with marks and what they are without; built by rule from Unicode's decompositions of the Latin blocks.


def _latin_table() -> tuple[str, str]:
    import unicodedata

    marked, plain = [], []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin_table()


def _upper_half(encoding: str) -> str:
    """The characters of bytes 128 to 255 in an encoding of one byte a character, U+FFFD for those without one."""
    upper = bytes(range(128, 256)).decode(encoding, "replace")
    if len(upper) != 128 or bytes(range(128)).decode(encoding) != bytes(range(128)).decode("ascii"):
        raise ValueError(f"{encoding} is not an extension of ASCII with one byte a character")
    return upper


def decoded_bytes(content: Column, encoding: str) -> Column:
    """Text of bytes in an encoding of one byte a character, by way of ISO-8859-1, as Spark decodes few others; bytes without a character become U+FFFD."""
    return F.translate(F.decode(content, "iso-8859-1"), _upper_half("iso-8859-1"), _upper_half(encoding))


def encoded_bytes(text: Column, encoding: str) -> Column:
    """The bytes of a text in an encoding of one byte a character; characters that it doesn't have become question marks."""
    upper, plain = _upper_half(encoding), _upper_half("iso-8859-1")
    known = {c: p for c, p in zip(upper, plain, strict=True) if c != "\ufffd"}
    text = F.regexp_replace(text, "[^\\x00-\\x7f" + "".join(f"\\u{ord(c):04x}" for c in known) + "]", "?")
    return F.encode(F.translate(text, "".join(known), "".join(known.values())), "iso-8859-1")


def remove_diacritics(text: Column) -> Column:
    """Latin letters without their marks; đ becomes dj."""
    text = F.replace(F.replace(text, F.lit("đ"), F.lit("dj")), F.lit("Đ"), F.lit("Dj"))
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), "[\\u0300-\\u036f]", "")


def normalize_header(text: Column) -> Column:
    """Header names for fuzzy matching: Croatian letters to plain ones (đ to d), lower case, trimmed."""
    return F.translate(F.lower(F.trim(text)), "čćšžđ", "ccszd")


def is_generic_brand(brand: Column) -> Column:
    return F.lower(F.trim(F.coalesce(brand, F.lit("")))).isin(*GENERIC_BRANDS)


def normalize_unit(unit: Column, quantity: Column) -> Column:
    """Quantity and unit in one word: ``1000 ml`` is ``1l``; no quantity leaves the unit."""
    name = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    known = name
    for synonym, standard in UNIT_SYNONYMS.items():
        known = F.when(name == synonym, standard).otherwise(known)
    amount = F.trim(F.coalesce(quantity, F.lit("")))
    value = amount.try_cast("double")
    large = known.isin("ml", "g") & (value >= 1000)
    short = F.regexp_replace((value / 1000).cast("string"), r"\.0$", "")
    base = F.when(known == "ml", "l").otherwise("kg")
    return F.when(amount == "", known).when(F.coalesce(large, F.lit(False)), F.concat(short, base)).otherwise(F.concat(amount, known))


def embedding_text(name: Column, brand: Column, category: Column, unit: Column) -> Column:
    """The text that stands for an item: its parts without marks, in lower case, single blanks between."""
    none = F.lit(None).cast("string")
    parts = F.concat_ws(
        " ",
        remove_diacritics(name),
        F.when(~is_generic_brand(brand), remove_diacritics(brand)).otherwise(none),
        F.when(F.coalesce(category, F.lit("")) != "", remove_diacritics(category)).otherwise(none),
        F.when(F.coalesce(unit, F.lit("")) != "", unit).otherwise(none),
    )
    return F.lower(F.trim(F.regexp_replace(parts, r"\s+", " ")))


def text_hash(text: Column) -> Column:
    """The first 16 bytes of SHA-256, in hex."""
    return F.left(F.sha2(text, 256), F.lit(32))


def title_case(text: Column) -> Column:
    return F.initcap(F.lower(text))


def masked(secret: Column) -> Column:
    """The first four characters, then at most twenty stars."""
    return F.concat(F.left(secret, F.lit(4)), F.repeat(F.lit("*"), F.least(F.greatest(F.length(secret) - 4, F.lit(0)), F.lit(20))))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def prefixed_id(prefix: str, *natural_key: Column) -> Column:
    """A deterministic surrogate: the prefix and part of a hash of the natural key."""
    key = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in natural_key])
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(key, 256), F.lit(24)))


def base62(number: Column, width: int = 6) -> Column:
    """A number's last ``width`` digits to base 62, as the time part of sortable ids has them."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    place = lambda k: F.substring(F.lit(digits), (F.pmod(F.floor(number / 62**k), F.lit(62)) + 1).cast("int"), F.lit(1))
    return F.concat(*[place(k) for k in reversed(range(width))])


def price_signature(*fields: Column) -> Column:
    """A hash over price fields by value, null apart from 0."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(f.cast("string"), F.lit("N")) for f in fields]), 256)
