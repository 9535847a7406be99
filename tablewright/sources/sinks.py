"""Where tables, reports and models go, and the preview of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewright.functions.columns import parse_columns, quoted, resolve_columns
from tablewright.functions.stats import local_frame
from tablewright.session import importable
from tablewright.sources.excel import ExcelSource, workbooks_below

PREVIEW_ROWS = 10


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """Values with separators, quotes or line breaks are quoted, quotes in them doubled."""
    writer = df.write.mode(mode).option("sep", separator).option("header", header)
    writer.option("quote", '"').option("escape", '"').csv(path)


def write_excel(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Workbooks with a header, one per task; modes are errorifexists, append and overwrite.

    Values are numbers, booleans or text; days and times are ISO text, which the readers understand.
    """
    if mode not in ("errorifexists", "append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    importable(df.sparkSession)
    df.sparkSession.dataSource.register(ExcelSource)
    if mode == "errorifexists" and workbooks_below(path):
        raise FileExistsError(f"{path} already holds workbooks")
    df.write.format(ExcelSource.name()).mode("overwrite" if mode == "overwrite" else "append").save(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report as JSON lines."""
    report.write.mode(mode).json(path)


@dataclass(frozen=True)
class Preview:
    df: DataFrame
    order_by: tuple[str, ...]

    def rows(self, n: int = PREVIEW_ROWS) -> DataFrame:
        """First rows in the given order; Spark keeps only ``n`` rows per task."""
        return self.df.orderBy(*[quoted(c) for c in self.order_by]).limit(n) if self.order_by else self.df.limit(n)

    def total(self) -> int:
        return self.df.count()

    def columns(self) -> DataFrame:
        total = self.total()
        return local_frame(
            self.df.sparkSession,
            [(i, f.name, f.dataType.simpleString(), total) for i, f in enumerate(self.df.schema.fields)],
            "position long, column_name string, dtype string, total_rows long",
        )


def preview(df: DataFrame, order_by: str | Sequence[str] | None = None) -> Preview:
    return Preview(df, tuple(resolve_columns(df, parse_columns(order_by), on_missing="error")))
