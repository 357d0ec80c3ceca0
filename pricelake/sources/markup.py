"""XML price lists: a file's items found without knowing its layout, each as a document tree, fields by path.

A file is read by a streaming parser twice: once for the elements' paths, from which the path of the items follows, and once
for the items, one at a time, so memory holds a file's bytes and one item. Nested elements of the same name, CDATA sections,
and attributes that hold angle brackets are what XML says they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded_bytes
from .delimited import Dialect, decoded, from_cells, read_files

# The paths of items that are tried first, in this order, whatever their case, and how deep a repeated element is looked for.
ITEM_PATHS = (
    "products.product", "Products.Product", "items.item", "Items.Item", "data.product", "Data.Product", "Cjenik.Proizvod", "cjenik.proizvod", "catalog.product", "Catalog.Product",
)
SEARCH_DEPTH = 2

_ITEMS = "file string, items_path string, at int, item string, fields map<string,array<string>>, folded map<string,array<string>>, error string"
_BATCH_ROWS, _BATCH_BYTES = 2000, 4_000_000


def _pieces(text: bytes, started, ended, said) -> Iterator[None]:
    """Runs a parser over a file, a megabyte for each step, with the given handlers; local names, no entity of the file's own."""
    parser = expat.ParserCreate(encoding="utf-8")
    parser.buffer_text = True
    parser.ordered_attributes = True
    local = lambda name: name.rsplit(":", 1)[-1]
    parser.StartElementHandler = lambda name, a: started(local(name), [(local(k), v) for k, v in zip(a[::2], a[1::2], strict=True)])
    parser.EndElementHandler = lambda name: ended(local(name))
    parser.CharacterDataHandler = said
    # Comments and CDATA sections part a text in pieces, which are trimmed one by one.
    parser.CommentHandler = lambda _: None
    parser.StartCdataSectionHandler = parser.EndCdataSectionHandler = lambda: None

    def refuse(*_):
        raise ValueError("entities of the file's own are refused")

    parser.EntityDeclHandler = refuse
    for at in range(0, len(text), 1 << 20):
        parser.Parse(text[at : at + (1 << 20)], False)
        yield
    parser.Parse(b"", True)
    yield


def items_path(text: bytes, tags: tuple[str, ...] = ()) -> str | None:
    """The path of a file's items.

    With ``tags`` it is the first of them that is an element at any depth. Without, the first of ITEM_PATHS with an element; failing
    that, in the file's order, the first element that its parent repeats, at most SEARCH_DEPTH deep.
    """
    seen: dict[tuple[str, ...], int] = {}
    stack: list[str] = []
    repeated: list[tuple[str, ...]] = []
    counts: list[dict[str, int]] = [{}]
    names = dict.fromkeys(tags, False)

    def started(name, _):
        stack.append(name)
        if name in names:
            names[name] = True
        if len(stack) <= SEARCH_DEPTH:
            path = tuple(stack)
            seen[path] = seen.get(path, 0) + 1
            counts[-1][name] = counts[-1].get(name, 0) + 1
            if counts[-1][name] == 2:
                repeated.append(path)
        counts.append({})

    def ended(_):
        stack.pop()
        counts.pop()

    for _ in _pieces(text, started, ended, lambda _: None):
        pass
    if tags:
        return next((tag for tag in tags if names[tag]), None)
    folded = {".".join(p).lower() for p in seen}
    for path in ITEM_PATHS:
        if path.lower() in folded:
            return path
    # Of the repeated elements, the one that comes first in the file.
    order = list(seen)
    return ".".join(min(repeated, key=order.index)) if repeated else None


class _Element:
    """An element of an item: attributes and children in their order, and its own text."""

    __slots__ = ("name", "children", "pieces")

    def __init__(self, name: str, attributes: list[tuple[str, str]]):
        self.name, self.children, self.pieces = name, [(f"@_{k}", v) for k, v in attributes], []

    def tree(self) -> dict:
        """Nested maps: attributes under ``@_`` and their name, repeated children as lists, text under ``#text``."""
        out: dict = {}
        for name, child in self.children:
            value = child if isinstance(child, str) else child.tree()
            if name not in out:
                out[name] = value
            elif isinstance(out[name], list):
                out[name].append(value)
            else:
                out[name] = [out[name], value]
        if text := "".join(self.pieces):
            out["#text"] = text
        return out

    def said(self) -> str:
        """The element's text, or else the first text inside it."""
        if text := "".join(self.pieces):
            return text
        return next((t for _, c in self.children if (t := c.strip() if isinstance(c, str) else c.said())), "")

    def fields(self, above: str, out: dict[str, list[str]]) -> None:
        for name, child in self.children:
            path = f"{above}.{name}" if above else name
            out.setdefault(path, []).append(child.strip() if isinstance(child, str) else child.said())
            if not isinstance(child, str):
                child.fields(path, out)


def items_in(text: bytes, path: str, anywhere: bool = False) -> Iterator[_Element]:
    """The elements at ``path``, case ignored; with ``anywhere`` those of that very name at any depth, not those inside one of them."""
    wanted = [p.lower() for p in path.split(".")]
    stack: list[str] = []
    open_: list[_Element] = []
    done: list[_Element] = []

    def started(name, attributes):
        stack.append(name.lower())
        if open_:
            child = _Element(name, attributes)
            open_[-1].children.append((name, child))
            open_.append(child)
        elif name == path if anywhere else stack == wanted:
            open_.append(_Element(name, attributes))

    def ended(_):
        stack.pop()
        if open_:
            last = open_.pop()
            if not open_:
                done.append(last)

    for _ in _pieces(text, started, ended, lambda piece: open_[-1].pieces.append(piece.strip()) if open_ else None):
        yield from done
        done.clear()


def _item_rows(tags: tuple[str, ...], fixed: str | None):
    kinds = pa.map_(pa.string(), pa.list_(pa.string()))
    schema = pa.schema([("file", pa.string()), ("items_path", pa.string()), ("at", pa.int32()), ("item", pa.string()), ("fields", kinds), ("folded", kinds), ("error", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def made(file: str, text: str | None) -> Iterator[tuple]:
        try:
            raw = (text or "").encode()
            path = fixed or items_path(raw, tags)
            if path is None:
                raise ValueError("no element is repeated, so there is no path of items")
            found = False
            for at, element in enumerate(items_in(raw, path, anywhere=bool(tags) and fixed is None)):
                found = True
                fields: dict[str, list[str]] = {}
                element.fields("", fields)
                if own := "".join(element.pieces):
                    fields["#text"] = [own]
                folded: dict[str, list[str]] = {}
                for name, values in fields.items():
                    folded.setdefault(name.lower(), values)
                yield file, path, at, json.dumps(element.tree(), ensure_ascii=False), list(fields.items()), list(folded.items()), None
            if not found:
                raise ValueError(f"nothing at {path}")
        except (expat.ExpatError, ValueError) as e:
            yield file, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for frame in batches:
            for at in range(frame.num_rows):  # a file's text is made one at a time
                for row in made(frame.column(0)[at].as_py(), frame.column(1)[at].as_py()):
                    rows.append(row)
                    size += 3 * len(row[3] or "")
                    if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def text_of(content: Column) -> Column:
    """A file's text: UTF-8 where valid, else what its declaration names of the Central European encodings, else windows-1250."""
    head = F.lower(F.decode(F.substring(content, 1, 200), "ISO-8859-1"))
    latin = F.regexp_extract(head, r"""<\?xml[^?]*encoding=["']([^"']+)["']""", 1).isin("iso-8859-2", "latin2")
    return F.when(latin & ~F.is_valid_utf8(content.cast("string")), decoded_bytes(content, "iso-8859-2")).otherwise(decoded(content))


def items(files: DataFrame, tags: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """A row for each item of files (path, content): file, items_path, at (from 0), item, fields, folded, error.

    ``item`` is the tree as JSON (``F.parse_json`` makes a variant of it), ``fields`` the texts by path in it, such as
    ``Store.Id`` or ``@_code``, and ``folded`` the same by lower-case path. A file that isn't XML, that is empty, or in which no items
    are found gives one row with an error and nulls. ``path`` sets the items' path, ``tags`` looks for elements at any depth.
    """
    return files.select(F.col("path").alias("file"), text_of(F.col("content")).alias("text")).mapInArrow(_item_rows(tags, path), _ITEMS)


def values(path: str) -> Column:
    """The texts at a path of an item, ``/`` or ``.`` between its parts and ``@`` before an attribute, in this case or any other.

    A part ``~pattern`` alone is any element of the item whose whole lower-case name matches.
    """
    if path.startswith("~"):
        return F.flatten(F.map_values(F.map_filter("folded", lambda k, _: k.rlike(f"^(?:{path[1:]})$"))))
    plain = path.replace("/", ".").replace("@", "@_")
    return F.coalesce(F.try_element_at("fields", F.lit(plain)), F.try_element_at("folded", F.lit(plain.lower())))


def normalised(files: DataFrame, dialect: Dialect) -> DataFrame:
    """Rows in the normalised schema; the dialect's columns are paths in the item, such as ``naziv`` or ``Store/Id``.

    The first path with text wins, so a price falls back from one element to another. Repeated barcode elements are
    all read. A file with an error gives one row that tells it (see ``items``).
    """
    rows, paths = items(files, dialect.tags), dialect.columns

    def cell(name: str) -> Column:
        if name == "barcodes":
            every = [F.array_join(values(p), ",") for p in paths.get(name, ())]
            return F.coalesce(*[F.nullif(c, F.lit("")) for c in every]) if every else F.lit(None).cast("string")
        found = [F.nullif(F.try_element_at(F.filter(values(p), lambda v: v != ""), F.lit(1)), F.lit("")) for p in paths.get(name, ())]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return from_cells(rows, dialect, cell, (F.col("at") + 1).cast("int"), F.col("item"), F.col("error"))


def read_markup(spark: SparkSession, path: str, dialect: Dialect, pattern: str = "*.xml") -> DataFrame:
    return normalised(read_files(spark, path, pattern), dialect)
