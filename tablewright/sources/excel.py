"""Folders of Excel workbooks as a Python data source: one partition per workbook and sheet, one workbook per writing task.

    spark.dataSource.register(ExcelSource)
    spark.read.format("workbooks").schema("name string, age string").option("sheet", "*").load(path)
    df.write.format("workbooks").mode("append").save(path)

Cells are read as text; ``readers.read_excel_sheets`` gives them their types. Sheets are streamed in both directions, so neither
a workbook nor a sheet is held whole. Paths are those ``pyarrow.fs`` opens: mounted folders, and s3, gs and hdfs addresses. For
any other store that Spark reads use ``readers.read_excel``.

Writing is in two steps: a task writes a hidden file, and the driver renames the files of the tasks that succeeded, so a task
that is run twice or fails leaves no workbook. A sheet takes as many rows as the format allows, the rest goes to a next sheet.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from tablewright.functions.columns import OPAQUE_TYPES
from tablewright.sources import workbook

ALL_SHEETS = "*"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else path.removeprefix("file:"))


def workbooks_below(path: str) -> list[str]:
    """Paths of all workbooks below a folder, or the path itself, in order; hidden and unfinished ones are not listed."""
    system, root = _place(path)
    if system.get_file_info(root).type == fs.FileType.File:
        return [root]
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.extension == "xlsx" and not f.base_name.startswith((".", "~")))


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str | None):
        super().__init__((path, sheet))


class ExcelReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        others = [f.name for f in schema.fields if not isinstance(f.dataType, StringType)]
        if others:
            raise ValueError(f"cells are read as text; columns {others} need a string type here")
        self.schema, self.path = schema, options["path"]
        self.sheet = options.get("sheet") or None
        self.header_row, self.skip_rows = int(options.get("header_row", 0)), int(options.get("skip_rows", 0))

    def partitions(self) -> list[SheetPartition]:
        system, _ = _place(self.path)
        found = []
        for path in workbooks_below(self.path):
            if self.sheet == ALL_SHEETS:
                with system.open_input_file(path) as file, zipfile.ZipFile(file) as book:
                    found += [SheetPartition(path, name) for name in workbook.sheet_names(book)]
            else:
                found.append(SheetPartition(path, self.sheet))
        return found

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # Spark asks for one partition where there is no workbook
            return
        path, sheet = partition.value
        names = self.schema.fieldNames()
        system, _ = _place(self.path)
        with system.open_input_file(path) as file:
            for rows in workbook.batches(file, sheet, self.header_row, self.skip_rows, names, path):
                columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None


class ExcelWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        nested = [f.name for f in schema.fields if isinstance(f.dataType, OPAQUE_TYPES)]
        if nested:
            raise ValueError(f"a cell cannot hold binary or nested values: {nested}")
        self.names, self.path, self.overwrite = schema.fieldNames(), options["path"], overwrite
        self.job = uuid.uuid4().hex[:12]
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None)
        system, root = _place(self.path)
        hidden = f"{root}/.{self.job}-{uuid.uuid4().hex[:12]}.xlsx"

        def rows() -> Iterator[Row]:
            yield first
            yield from iterator

        with system.open_output_stream(hidden) as file:
            workbook.write(file, self.names, rows())
        return Written(hidden)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        before = workbooks_below(self.path) if self.overwrite else []
        done = [m.hidden for m in messages if m and m.hidden]
        for i, hidden in enumerate(done):
            system.move(hidden, f"{root}/part-{i:05d}-{self.job}.xlsx")
        for path in before:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _place(self.path)
        for message in messages:
            if message and message.hidden:
                system.delete_file(message.hidden)


class ExcelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> StructType:
        """The header of the first workbook, all text."""
        system, _ = _place(self.options["path"])
        at = int(self.options.get("header_row", 0)) + int(self.options.get("skip_rows", 0))
        sheet = self.options.get("sheet") or None
        for path in workbooks_below(self.options["path"]):
            with system.open_input_file(path) as file:
                names = workbook.header(file, None if sheet == ALL_SHEETS else sheet, at, path)
            return StructType([StructField(n, StringType()) for n in names])
        raise ValueError(f"no workbook below {self.options['path']}: a schema is required")

    def reader(self, schema: StructType) -> ExcelReader:
        return ExcelReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ExcelWriter:
        return ExcelWriter(schema, dict(self.options), overwrite)
