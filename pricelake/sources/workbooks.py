"""Workbooks as a Python data source: ``spark.read.format("workbook")`` with a partition for some files, rows in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .sheets import cell_batches

#: Bytes of workbooks that a partition takes unless ``partitionBytes`` says otherwise; a larger one has a partition of its own.
PARTITION_BYTES = 32 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it; hdfs, s3 and gs are those of pyarrow."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Workbooks(InputPartition):
    """Some workbooks, by path."""

    paths: tuple[str, ...]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        sheet = options.get("sheet", "0")
        self.sheet = int(sheet) if sheet.isdigit() else sheet
        self.suffix = options.get("suffix", ".xlsx").lower()
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their paths, put together to partitions."""
        system, path = file_system(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(self.suffix)]
        else:
            found = [found]
        out, now, size = [], [], 0
        for info in sorted(found, key=lambda f: f.path):
            if now and size + info.size > self.most:
                out.append(Workbooks(tuple(now)))
                now, size = [], 0
            now.append(info.path)
            size += info.size
        return [*out, Workbooks(tuple(now))] if now else out or [Workbooks(())]

    def read(self, partition: Workbooks) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as opened:
                yield from cell_batches(path, opened, self.sheet)


class WorkbookSource(DataSource):
    """Options: ``path`` (a folder, searched through, or a file), ``sheet`` (a place from 0, or a name), ``suffix`` (.xlsx),
    ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, row_number int, cells array<string>, error string"

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})


def read_workbooks(spark: SparkSession, path: str, sheet: int | str = 0, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(file, row_number, cells, error) of the workbooks under ``path``; ``sheets.rows_of`` makes normalised rows of it.

    The path must be one that pyarrow reads. For a store that only Spark reads, take ``read_files`` and ``sheets.workbook_cells``.
    """
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("sheet", str(sheet)).option("partitionBytes", str(partition_bytes)).load(path)


def written_files(files: DataFrame, folder: str) -> int:
    """Writes files (path, content) under a folder, each by the task that has it, and counts them; a file that is there is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{root}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select("path", "content").mapInArrow(run, "n long").groupBy().sum("n").collect()
    return int(rows[0][0] or 0)
