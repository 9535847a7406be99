"""Missing cells per column and per table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import missing
from tablewright.functions.stats import collect_aggregates, local_frame

HIGH, MEDIUM = 0.30, 0.05


def severity(pct: Column) -> Column:
    return F.when(pct > HIGH, "high").when(pct >= MEDIUM, "medium").otherwise("low")


@dataclass(frozen=True)
class MissingReport:
    df: DataFrame

    @cached_property
    def _counts(self) -> dict:
        absent = {name: missing(self.df, name) for name in self.df.columns}
        aggregates: dict = {("col", name): F.count_if(flag) for name, flag in absent.items()}
        aggregates["rows"] = F.count(F.lit(1))
        aggregates["complete"] = F.count_if(~reduce(Column.__or__, absent.values()))
        return collect_aggregates(self.df, aggregates)

    def columns(self) -> DataFrame:
        """Only columns with a gap, worst first."""
        total = self._counts["rows"]
        rows = [(name, self._counts["col", name], total) for name in self.df.columns if self._counts["col", name]]
        table = local_frame(self.df.sparkSession, rows, "column_name string, missing_count long, total long")
        scored = table.withColumn("missing_pct", F.round(F.col("missing_count") / F.col("total"), 4))
        scored = scored.withColumn("severity", severity(F.col("missing_pct")))
        flag = F.when(F.col("severity") == "high", "critical_missing").when(
            F.col("severity") == "medium", "high_missing"
        )
        return scored.select(
            "column_name",
            "missing_count",
            "missing_pct",
            "severity",
            (F.col("total") - F.col("missing_count")).alias("present_count"),
            flag.alias("flag"),
        ).orderBy(F.col("missing_pct").desc(), "column_name")

    def summary(self) -> DataFrame:
        found, width = self._counts, len(self.df.columns)
        total = found["rows"]
        absent = [found["col", name] for name in self.df.columns]
        cells = total * width
        table = local_frame(
            self.df.sparkSession,
            [(total, width, sum(absent), cells, found["complete"], sum(1 for n in absent if n == 0))],
            "total_rows long, total_columns long, total_missing_cells long, total_cells long, "
            "complete_rows long, no_missing_count long",
        )
        share = F.coalesce(F.try_divide("total_missing_cells", "total_cells"), F.lit(0.0))
        whole = F.coalesce(F.try_divide("complete_rows", "total_rows"), F.lit(0.0))
        return table.withColumns(
            {"overall_missing_pct": F.round(share, 4), "complete_rows_pct": F.round(whole, 4)}
        )

    def flags(self) -> DataFrame:
        return self.columns().where("flag is not null").select("column_name", F.col("flag").alias("type"), "missing_pct")


def missing_values(df: DataFrame) -> MissingReport:
    return MissingReport(df)
