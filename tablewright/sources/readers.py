"""CSV, Parquet and Excel tables as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, parse_columns
from tablewright.session import importable
from tablewright.sources import workbook
from tablewright.sources.excel import ALL_SHEETS, ExcelSource


def _require(path: str) -> str:
    if not path:
        raise ValueError("a path is required")
    return path


def read_csv(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    header: bool = True,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV with inferred types; a given ``schema`` saves the pass that infers them.

    Quoted values may hold separators and doubled quotes. ``multiline`` also allows line breaks in them; a file is then
    read by one task, so it is off unless asked for. Without a header the columns are called "0", "1", ...
    """
    reader = spark.read.option("sep", separator).option("header", header)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multiline)
    if schema is not None:
        return reader.schema(schema).csv(_require(path))
    df = reader.option("inferSchema", True).csv(_require(path))
    return df if header else df.toDF(*[str(i) for i in range(len(df.columns))])


def read_parquet(spark: SparkSession, path: str, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Parquet; listed columns only are read from disk."""
    df = spark.read.parquet(_require(path))
    names = parse_columns(columns)
    return df.select(*[col(c) for c in names]) if names else df


def read_excel(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sheet: str | None = None,
    header_row: int = 0,
    skip_rows: int = 0,
) -> DataFrame:
    """All .xlsx workbooks below ``path`` as one table, one workbook per task at a time.

    Columns are matched to ``schema`` by header name. ``sheet`` defaults to the first.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.fieldNames()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for rows in workbook.batches(content, sheet, header_row, skip_rows, names, name):
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", "true")
        .load(_require(path))
        .select("path", "content")
    )
    cells = files.mapInPandas(parse, text)
    return cells.select(*[_typed_cell(f).alias(f.name) for f in schema.fields])


def read_excel_sheets(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sheet: str | None = ALL_SHEETS,
    header_row: int = 0,
    skip_rows: int = 0,
) -> DataFrame:
    """All sheets (or one) of all workbooks below a mounted folder or object-store address, one sheet per task.

    Through the data source of ``sources/excel.py``, which streams workbooks of any size. ``sheet=None`` is the first.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    importable(spark)
    spark.dataSource.register(ExcelSource)
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.fieldNames()])
    reader = spark.read.format(ExcelSource.name()).schema(text).option("sheet", sheet or "")
    cells = reader.option("header_row", header_row).option("skip_rows", skip_rows).load(_require(path))
    return cells.select(*[_typed_cell(f).alias(f.name) for f in schema.fields])


def _typed_cell(field: T.StructField) -> Column:
    """The text of a cell as the wanted type; days and times are stored as days since the end of 1899."""
    text = F.when(col(field.name) != "", col(field.name))
    if isinstance(field.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.coalesce(text.try_cast(field.dataType), text.try_cast("double").cast(field.dataType))
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        days = text.try_cast("double")
        midnight = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int")).cast("timestamp_ntz")
        moment = midnight + F.make_dt_interval(secs=F.round((days - F.floor(days)) * 86_400, 3).cast("decimal(18,6)"))
        return F.when(days.isNotNull(), moment.cast(field.dataType)).otherwise(text.try_cast(field.dataType))
    return col(field.name).try_cast(field.dataType)
