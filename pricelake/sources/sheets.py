"""Spreadsheets and archives: binary files unpacked inside tasks, a file a row."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_header
from .delimited import Dialect, from_cells, headers_of

# What an archive may hold.
MEMBER_TYPES = ("csv", "xml", "xlsx", "txt")
SKIPPED = ("__MACOSX", ".DS_Store", "Thumbs.db")
MOST_MEMBER, MOST_TOTAL, MOST_MEMBERS = 100 << 20, 1 << 30, 10_000

#: Rows of a sheet that are held at once.
BATCH = 4096

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(reference: str) -> int:
    """The column of a cell reference such as AB12, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_file(z: zipfile.ZipFile, sheet: int | str) -> str:
    """The member that holds a sheet, given by its place from 0 or by its name."""
    names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if isinstance(sheet, int):
        return names[sheet]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for found in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        if found.get("name") == sheet:
            return "xl/" + targets[found.get(_RELATION)].removeprefix("/xl/")
    raise KeyError(f"no sheet {sheet}")


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    """The workbook's table of texts, which cells refer to by number."""
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as member:
            for _, element in ElementTree.iterparse(member):
                if element.tag == f"{_SHEET}si":
                    out.append("".join(t.text or "" for t in element.iter(f"{_SHEET}t")))
                    element.clear()
    return out


def sheet_rows(z: zipfile.ZipFile, sheet: int | str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The number and cells of each row of a sheet that isn't blank, as texts, row by row; the sheet isn't held in memory."""
    with z.open(_sheet_file(z, sheet)) as member:
        number, rows = 0, None
        for event, element in ElementTree.iterparse(member, ("start", "end")):
            if event == "start":
                rows = element if element.tag == f"{_SHEET}sheetData" else rows
                continue
            if element.tag != f"{_SHEET}row":
                continue
            number = int(element.get("r") or number + 1)
            cells: dict[int, str] = {}
            for i, c in enumerate(element.iter(f"{_SHEET}c")):
                value = c.findtext(f"{_SHEET}v") or "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                cells[_place(c.get("r")) if c.get("r") else i] = shared[int(value)] if c.get("t") == "s" and value else value
            if any(v.strip() for v in cells.values()):
                yield number, [cells.get(i, "") for i in range(max(cells) + 1)]
            rows.clear()


_CELLS = pa.schema([("file", pa.string()), ("row_number", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def cell_batches(path: str, opened, sheet: int | str) -> Iterator[pa.RecordBatch]:
    """A workbook's rows (file, row_number, cells, error) in batches of at most BATCH; an error gives a row of its own."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CELLS, strict=True)], schema=_CELLS)
        rows.clear()
        return made

    try:
        with zipfile.ZipFile(opened) as z:
            for number, cells in sheet_rows(z, sheet, shared_strings(z)):
                rows.append((path, number, cells, None))
                if len(rows) == BATCH:
                    yield batch()
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
        rows.append((path, None, None, f"{type(e).__name__}: {e}"))
    if rows:
        yield batch()


def workbook_cells(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """(file, row_number, cells, error) of spreadsheet files (path, content); blank rows are left out.

    A file that can't be read gives a row with its error, and nulls; rows before the place where it breaks off are there.
    ``spark.read.format("workbook")`` reads the same from a folder (see ``workbooks``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches:
            for at in range(frame.num_rows):
                yield from cell_batches(frame.column(0)[at].as_py(), io.BytesIO(frame.column(1)[at].as_py() or b""), sheet)

    return files.select("path", "content").mapInArrow(run, "file string, row_number int, cells array<string>, error string")


def normalised(files: DataFrame, dialect: Dialect, sheet: int | str = 0) -> DataFrame:
    """Workbook files (path, content) in the normalised schema; see ``rows_of``."""
    return rows_of(workbook_cells(files, sheet), dialect)


def rows_of(cells: DataFrame, dialect: Dialect) -> DataFrame:
    """Workbooks' cells (file, row_number, cells, error) in the normalised schema. Those whose first row has the dialect's name and price headers are read by
    headers, all others by its positions, after its skipped rows. A file that can't be read gives one row with its error.
    """
    first = cells.where("error IS NULL").groupBy("file").agg(F.min_by("cells", "row_number").alias("_first"), F.min("row_number").alias("_at"))
    first = first.withColumn("headers", headers_of(F.col("_first"), dialect))
    words = lambda f: F.array(*[normalize_header(F.lit(h)) for h in dialect.columns[f] if not h.isdigit()])
    named = F.arrays_overlap("headers", words("name")) & F.arrays_overlap("headers", words("price"))
    rows = cells.select("file", "row_number", "cells", "error").join(first.withColumn("_named", named), "file", "left")
    begins = F.when(F.col("_named"), F.col("_at")).otherwise(F.lit(dialect.skipped_rows))
    rows = rows.where(F.col("error").isNotNull() | (F.col("row_number") > begins))

    def cell(field: str) -> Column:
        found = []
        for header in dialect.columns.get(field, ()):
            if header.isdigit():
                found.append(F.when(~F.col("_named"), F.try_element_at("cells", F.lit(int(header) + 1))))
            else:
                at = F.array_position("headers", normalize_header(F.lit(header))).cast("int")
                found.append(F.when(F.col("_named") & (at > 0), F.try_element_at("cells", F.greatest(at, F.lit(1)))))
        return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found]) if found else F.lit(None).cast("string")

    return from_cells(rows, dialect, cell, F.col("row_number"), F.to_json("cells"), F.col("error"))


def archive_members(files: DataFrame) -> DataFrame:
    """The members of ZIP files (path, content): archive, member, file_type, content, checksum, bytes, error.

    Folders, system files and files of other types are left out. A member that is refused, as its path leads out of the
    archive or it is over a limit, and an archive that can't be read (member null), give a row with the error and no content.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "member", "file_type", "content", "checksum", "bytes", "error"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, f"not an archive: {e}")], columns=columns).astype({"bytes": "Int64"})
                    continue
                total = 0
                for at, info in enumerate(z.infolist()):
                    name = info.filename.replace("\\", "/")
                    kind = name.rsplit(".", 1)[-1].lower()
                    if info.is_dir() or kind not in MEMBER_TYPES or any(s in name for s in SKIPPED):
                        continue
                    error, data = None, None
                    if name.startswith("/") or ".." in name.split("/"):
                        error = "path leads out of the archive"
                    elif at >= MOST_MEMBERS:
                        error = f"over {MOST_MEMBERS} members"
                    elif info.file_size > MOST_MEMBER:
                        error = f"over {MOST_MEMBER} bytes"
                    elif total + info.file_size > MOST_TOTAL:
                        error = f"over {MOST_TOTAL} bytes in the archive"
                    else:
                        total += info.file_size
                        try:
                            data = z.read(info)
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                            error = f"can't be read: {e}"
                    made = (data, hashlib.sha256(data).hexdigest(), len(data)) if data is not None else (None, None, info.file_size)
                    yield pd.DataFrame([(path, name, kind, *made, error)], columns=columns).astype({"bytes": "Int64"})

    return files.select("path", "content").mapInPandas(run, "archive string, member string, file_type string, content binary, checksum string, bytes long, error string")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content no archive row has yet, each content once."""
    hashed = files.withColumn("checksum", F.sha2("content", 256))
    return hashed.join(known.select("checksum"), "checksum", "left_anti").dropDuplicates(["checksum"])


def archived(files: DataFrame, chain: str, day: str) -> DataFrame:
    """Archive rows: the key under which a file is kept, and its checksum."""
    name = F.element_at(F.split("path", "/"), -1)
    key = F.concat_ws("/", F.lit("archives"), F.lit(chain), F.replace(F.lit(day), F.lit("-"), F.lit("/")), name)
    return files.select(key.alias("archive_key"), F.sha2("content", 256).alias("checksum"), F.octet_length("content").alias("bytes"), "content")
