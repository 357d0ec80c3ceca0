"""What the names of price files tell: the store's kind, address, postal code and town, and the day of the list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .delimited import store_of
from .dialects import DIALECTS


@dataclass(frozen=True)
class Anchored:
    """Names in parts: kind first, then the address up to a part that is a postal code, then the town.

    The code is the first (or the ``last``) part of five digits that is neither the first part nor one of the ``tail`` last ones; a name of
    less than ``least`` parts isn't read. A part of five digits with another after it is a number of the address, unless no part is a code then.
    """

    least: int = 6
    tail: int = 2
    last: bool = False
    separator: str = "_"
    titled: str = "{chain}"  # what stands before the town in the store's name
    kind_as_is: bool = False


@dataclass(frozen=True)
class Patterned:
    """Names by a pattern with groups; ``fields`` says which group is what, and ``town_last`` where the last word of the address is the town."""

    pattern: str
    fields: dict[str, int]
    town_last: str = ""  # "word": any last word of several, "capitals": only one in capitals
    kind: str | None = None
    kind_as_is: bool = False


# How each source names its files.
LAYOUTS: dict[str, Anchored | Patterned] = {
    "lidl": Anchored(),
    "plodine": Anchored(tail=3),
    "kaufland": Anchored(tail=3, last=True, titled="{kind}", kind_as_is=True),
    "eurospin": Patterned(r"^([^-]*)-[^-]*-([^-]*)-([^-]*)-([^-]*)", {"kind": 1, "address": 2, "town": 3, "postal": 4}),
    "interspar": Patterned(r"(?i)^(?=(?:[^_]*_){7})([^_]*)_([^_]*)_((?:[^_]*_)*?)[^_]*_interspar(?:_|$)", {"kind": 1, "town": 2, "address": 3}),
    "metro": Patterned(r"_S\d+_(.+?)(?:,([^,]*))?\.csv$", {"address": 1, "town": 2}),
    "studenac": Patterned(r"^([A-Z]+)-(.+?)-T\d+-", {"kind": 1, "address": 2}, town_last="capitals", kind_as_is=True),
    "trgocentar": Patterned(r"^SUPERMARKET_(.+?)_P\d{3}", {"address": 1}, kind="SUPERMARKET", kind_as_is=True),
    "ktc": Patterned(r"^TRGOVINA-(.+?)-PJ[\dA-Z]+-\d+-", {"address": 1}, town_last="word"),
}

# Patterns of the day in a name, tried in this order, and which group is the year, the month and the day.
DAYS: dict[str, tuple[tuple[str, str], ...]] = {
    "lidl": ((r"(\d{2})_(\d{2})_(\d{4})\.zip$", "dmy"),),
    "ktc": ((r"(\d{4})(\d{2})(\d{2})-\d{6}\.csv$", "ymd"),),
    "eurospin": ((r"cjenik_(\d{2})\.(\d{2})\.(\d{4})", "dmy"),),
    "metro": ((r"METRO_(\d{4})(\d{2})(\d{2})T\d{4}", "ymd"),),
    "studenac": ((r"(\d{4})-(\d{2})-(\d{2})", "ymd"), (r"(\d{2})-(\d{2})-(\d{4})", "dmy")),
    "trgocentar": ((r"(\d{2})(\d{2})(\d{4})\d{4}\.xml$", "dmy"), (r"(\d{4})-(\d{2})-(\d{2})", "ymd"), (r"(\d{2})-(\d{2})-(\d{4})", "dmy")),
    "kaufland": ((r"_(\d{2})(\d{2})(\d{4})_", "dmy"),),
}

# Names of the chains as they are shown; another's is its slug.
CHAIN_NAMES = {
    "konzum": "Konzum", "lidl": "Lidl", "plodine": "Plodine", "interspar": "Interspar", "studenac": "Studenac", "kaufland": "Kaufland",
    "eurospin": "Eurospin", "dm": "DM", "ktc": "KTC", "metro": "Metro", "trgocentar": "Trgocentar",
}


def chain_name(slug: Column) -> Column:
    """A chain's name as it is shown."""
    names = F.create_map(*[F.lit(v) for pair in CHAIN_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, slug), slug)


def titled(text: Column) -> Column:
    """Words with a capital first and small letters after it, one space between them."""
    return F.initcap(F.trim(F.regexp_replace(text, r"[_\s]+", " ")))


def day_of(name: Column, chain: str) -> Column:
    """The day in a file's name; null without one that the chain's patterns find, or where there is no such day."""

    def day(pattern: str, order: str) -> Column:
        part = {c: F.regexp_extract(name, pattern, i) for i, c in enumerate(order, 1)}
        return F.when(name.rlike(pattern), F.concat_ws("-", part["y"], part["m"], part["d"]))

    found = F.coalesce(*[day(*p) for p in DAYS[chain]])
    return F.to_date(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")))


def _store(name: Column, address: Column, town: Column, postal: Column, kind: Column) -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    parts = {"name": F.trim(name), "address": filled(address), "town": filled(town), "postal_code": filled(postal), "kind": filled(kind)}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _anchored(base: Column, chain: str, layout: Anchored) -> Column:
    parts = F.split(base, layout.separator)
    n = F.size(parts)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > 1) & (i <= n - layout.tail) & F.element_at(parts, i).rlike(r"^\d{5}$"))
    before_town = F.filter(places, lambda i: ~F.coalesce(F.try_element_at(parts, i + 1), F.lit("")).rlike(r"^\d{5}$"))
    which = F.lit(-1 if layout.last else 1)
    at = F.when(n >= layout.least, F.coalesce(F.try_element_at(before_town, which), F.try_element_at(places, which)))
    kind = F.element_at(F.split(F.element_at(parts, 1), " "), 1)
    town = F.coalesce(F.try_element_at(parts, at + 1), F.lit(""))
    before = F.lit(CHAIN_NAMES[chain]) if layout.titled == "{chain}" else kind
    address = titled(F.array_join(F.slice(parts, 2, F.greatest(at - 2, F.lit(0))), " "))
    return F.when(at.isNotNull(), _store(F.concat_ws(" ", before, titled(town)), address, titled(town), F.element_at(parts, at), kind if layout.kind_as_is else titled(kind)))


def _patterned(name: Column, chain: str, layout: Patterned) -> Column:
    group = lambda f: F.regexp_extract(name, layout.pattern, layout.fields[f]) if f in layout.fields else F.lit("")
    kind = F.lit(layout.kind) if layout.kind else group("kind")
    address, town = F.trim(F.regexp_replace(group("address"), r"[_\s]+", " ")), group("town")
    if layout.town_last:
        words = F.split(address, " ")
        last = F.element_at(words, -1)
        apart = F.size(words) > 1
        if layout.town_last == "capitals":
            apart = apart & (last == F.upper(last)) & (last != F.lower(last))
        address, town = F.when(apart, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(address), F.when(apart, last).otherwise("")
    shown = F.when(F.trim(town) != "", titled(town)).otherwise(titled(address))
    return F.when(name.rlike(layout.pattern), _store(F.concat_ws(" ", F.lit(CHAIN_NAMES[chain]), shown), titled(address), titled(town), group("postal"), kind if layout.kind_as_is else titled(kind)))


def _konzum(name: Column) -> Column:
    """KIND,ADDRESS+POSTAL+TOWN,STORE,...: the postal code, if there is one, parts address and town.

    It is the first word of five digits that no number follows, as one before it belongs to the address; without such a word, the first five digits.
    """
    parts = F.split(name, ",")
    kind, place = F.element_at(parts, 1), F.replace(F.try_element_at(parts, F.lit(2)), F.lit("+"), F.lit(" "))
    word, digits = r"^(.*?)(?<!\S)(\d{5})(?!\S)(?!\s*\d)(.*)$", r"^(.*?)(\d{5})(.*)$"
    group = lambda i: F.when(place.rlike(word), F.regexp_extract(place, word, i)).otherwise(F.regexp_extract(place, digits, i))
    coded = place.rlike(digits)
    address = F.trim(F.when(coded, group(1)).otherwise(place))
    town = F.trim(F.when(coded, group(3)).otherwise(""))
    shown = F.array_join(F.filter(F.array(kind, address, town), lambda c: c != ""), " ")
    return F.when(F.size(parts) >= 3, _store(shown, address, town, group(2), kind))


def store_metadata(name: Column, chain: str) -> Column:
    """(name, address, town, postal_code, kind) of the store that a file's name tells of.

    A name that isn't laid out as the chain's are gives only the store's name, made of the chain's and the store's identifier.
    """
    base = F.regexp_replace(name, r"(?i)\.(csv|xml)$", "")
    layout = LAYOUTS.get(chain)
    plain = _store(F.concat_ws(" ", F.lit(CHAIN_NAMES[chain]), store_of(name, DIALECTS[chain])), *[F.lit(None).cast("string")] * 4)
    if chain == "konzum":
        found = _konzum(name)
    elif isinstance(layout, Anchored):
        found = _anchored(base, chain, layout)
    else:
        found = _patterned(name, chain, layout) if layout else None
    return plain if found is None else F.coalesce(found, plain)
