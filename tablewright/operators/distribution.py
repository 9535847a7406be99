"""Shape of every column: moments, quantiles, histogram, frequent values, target balance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import as_text, measured, numeric_columns, parse_columns
from tablewright.functions.ranking import bucket_of
from tablewright.functions.sketches import approx_quantiles, approx_top_values, distinct_counts, distinct_sketches
from tablewright.functions.stats import (
    COLUMNS_PER_JOB,
    batched,
    column_stats,
    local_frame,
    quantiles,
    sample_kurtosis,
    sample_skewness,
    shape_moments,
)

TOP_VALUES = 10
BINS = 10
HIGH_CARDINALITY = 20
MODERATE_SKEW, STRONG_SKEW = 0.5, 1.0
IMBALANCE_RATIO = 3
MAX_CLASSES = 20
QUARTILES = [0.25, 0.5, 0.75]

NUMERIC_SCHEMA = (
    "column_name string, count long, mean double, median double, std double, min double, max double, "
    "skewness double, kurtosis double, q25 double, q50 double, q75 double"
)


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column_name, value, count)`` of non-missing values, some columns per pass.

    Counts are combined before the shuffle, so a value that fills a column sends one row
    per task.
    """
    frames = []
    for chunk in batched(names, COLUMNS_PER_JOB):
        pairs = F.array(
            *[F.struct(F.lit(name).alias("column_name"), as_text(df, name).alias("value")) for name in chunk]
        )
        frames.append(
            df.select(F.explode(pairs).alias("cell"))
            .select("cell.column_name", "cell.value")
            .where(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("count"))
        )
    return reduce(DataFrame.unionByName, frames)


def skew_flag(skewness: Column) -> Column:
    side = F.when(skewness > 0, "right").otherwise("left")
    return F.when(F.abs(skewness) >= STRONG_SKEW, F.concat(F.lit("strong_"), side)).when(
        F.abs(skewness) >= MODERATE_SKEW, F.concat(F.lit("moderate_"), side)
    )


@dataclass(frozen=True)
class DistributionReport:
    df: DataFrame
    numeric_names: list[str]
    other_names: list[str]
    target: str | None
    approx: bool = False

    @cached_property
    def _stats(self) -> dict[str, dict]:
        values = {name: measured(self.df, name) for name in self.numeric_names}
        return column_stats(self.df, values, {**shape_moments(), "rows": lambda _: F.count(F.lit(1))})

    @cached_property
    def _cuts(self) -> dict[str, list]:
        """Quartiles of every numeric column."""
        values = {name: measured(self.df, name) for name in self.numeric_names}
        if self.approx:
            return approx_quantiles(self.df, values, QUARTILES)
        return quantiles(self.df, values, QUARTILES, {n: self._stats[n]["count"] for n in values})

    def facts(self, name: str) -> dict:
        """Moments, rows and quartiles of a numeric column, for reports on the same table."""
        return {**self._stats[name], "quartiles": self._cuts[name]}

    @cached_property
    def rows(self) -> int:
        if self.numeric_names:
            return self._stats[self.numeric_names[0]]["rows"]
        return self.df.count()

    def numeric(self) -> DataFrame:
        """One row per numeric column, from two passes: moments, then quantiles."""
        stats, cuts = self._stats, self._cuts
        rows = []
        for name in self.numeric_names:
            s, (q25, q50, q75) = stats[name], cuts[name]
            skew = sample_skewness(s["count"], s["g1"], s["std"])
            kurt = sample_kurtosis(s["count"], s["g2"], s["std"])
            rows.append(
                (name, s["count"], s["mean"], q50, s["std"], s["min"], s["max"], skew, kurt, q25, q50, q75)
            )
        raw = local_frame(self.df.sparkSession, rows, NUMERIC_SCHEMA)
        places = [F.round(c, 4).alias(c) if c not in ("column_name", "count") else F.col(c) for c in raw.columns]
        return raw.select(*places).withColumn("skew_flag", skew_flag(F.col("skewness")))

    def histogram(self) -> DataFrame:
        """Ten equal-width bins per column; every bin is listed, empty ones with 0."""
        if not self.numeric_names:
            return local_frame(
                self.df.sparkSession, [], "column_name string, bin long, lo double, hi double, count long"
            )
        edges, cells, grid = {}, [], []
        for name in self.numeric_names:
            s = self._stats[name]
            lo, hi = (0.0, 1.0) if s["count"] == 0 else (s["min"], s["max"])
            if lo == hi:
                lo, hi = lo - 0.5, hi + 0.5
            edges[name] = [float(e) for e in np.linspace(lo, hi, BINS + 1)]
            value = measured(self.df, name)
            inner = bucket_of(value, edges[name][1:-1])
            cells.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("column_name"), inner.alias("bin"))))
            grid += [(name, i, edges[name][i], edges[name][i + 1]) for i in range(BINS)]
        counted = reduce(
            DataFrame.unionByName,
            [
                self.df.select(F.explode(F.array(*chunk)).alias("cell"))
                .where("cell is not null")
                .groupBy("cell.column_name", "cell.bin")
                .count()
                for chunk in batched(cells, COLUMNS_PER_JOB)
            ],
        )
        bins = local_frame(self.df.sparkSession, grid, "column_name string, bin long, lo double, hi double")
        return bins.join(counted, ["column_name", "bin"], "left").select(
            "column_name",
            "bin",
            F.round("lo", 4).alias("lo"),
            F.round("hi", 4).alias("hi"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        )

    def _other_counts(self) -> DataFrame:
        if not self.other_names:
            return local_frame(self.df.sparkSession, [], "column_name string, value string, count long")
        return value_counts(self.df, self.other_names)

    def categorical(self) -> DataFrame:
        """Non-null count and number of distinct values of every non-numeric column."""
        if self.approx and self.other_names:
            present = column_stats(self.df, {n: as_text(self.df, n) for n in self.other_names}, {"n": F.count})
            counts = local_frame(self.df.sparkSession, [(n, present[n]["n"]) for n in self.other_names], "column_name string, count long")
            estimates = distinct_counts(distinct_sketches(self.df, self.other_names))
            grouped = counts.join(estimates.withColumnRenamed("unique_count", "cardinality"), "column_name")
        else:
            grouped = self._other_counts().groupBy("column_name").agg(
                F.sum("count").alias("count"), F.count(F.lit(1)).alias("cardinality")
            )
        names = local_frame(self.df.sparkSession, [(n,) for n in self.other_names], "column_name string")
        return names.join(grouped, "column_name", "left").select(
            "column_name",
            F.coalesce("count", F.lit(0)).alias("count"),
            F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
            (F.coalesce("cardinality", F.lit(0)) > HIGH_CARDINALITY).alias("high_cardinality"),
        )

    def top_values(self, k: int = TOP_VALUES) -> DataFrame:
        """The ``k`` most frequent values per column.

        Spark limits each task to its own first ``k`` rows per column ahead of the shuffle
        (rank filter on a window), so a column of unique values does not gather in one task.
        With ``approx`` a sketch per task replaces the shuffle of values.
        """
        order = Window.partitionBy("column_name").orderBy(F.col("count").desc(), "value")
        counted = approx_top_values(self.df, self.other_names, k) if self.approx and self.other_names else self._other_counts()
        ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select(
            "column_name",
            F.col("rank").cast("long").alias("rank"),
            "value",
            "count",
            F.round(F.col("count") / F.lit(self.rows), 4).alias("pct"),
        )

    def target_is_classes(self) -> bool:
        """Non-numeric targets, or numeric ones with few values, are reported as classes."""
        if self.target not in self.numeric_names:
            return True
        seen = (
            self.df.select(measured(self.df, self.target).alias("v"))
            .where("v is not null")
            .distinct()
            .limit(MAX_CLASSES + 1)
            .count()
        )
        return seen <= MAX_CLASSES

    def target_balance(self) -> DataFrame:
        counted = value_counts(self.df, [self.target])
        return counted.select(
            "value", "count", F.round(F.col("count") / F.lit(self.rows), 4).alias("pct")
        )

    def target_distribution(self) -> DataFrame:
        only = DistributionReport(self.df, [self.target], [], self.target)
        return only.numeric().select(F.col("column_name").alias("target"), "mean", "median", "std", "min", "max")

    def target_imbalance(self) -> DataFrame:
        """Largest over smallest class share, flagged above three."""
        ends = self.target_balance().agg(
            F.max("pct").alias("largest"), F.min("pct").alias("smallest"), F.count(F.lit(1)).alias("classes")
        )
        ratio = F.when(F.col("smallest") > 0, F.col("largest") / F.col("smallest")).otherwise(
            F.lit(float("inf"))
        )
        return ends.select(
            "classes",
            F.round(ratio, 4).alias("ratio"),
            ((F.col("classes") >= 2) & (ratio > IMBALANCE_RATIO)).alias("imbalanced"),
        )

    def summary(self) -> DataFrame:
        return local_frame(
            self.df.sparkSession,
            [(self.rows, len(self.df.columns), len(self.numeric_names), len(self.other_names))],
            "total_rows long, total_columns long, numeric_count long, categorical_count long",
        )

    def flags(self) -> DataFrame:
        """``(column_name, type, value)`` for skew, cardinality and class imbalance."""
        found = self.numeric().where("skew_flag is not null").select(
            "column_name", F.lit("skewed").alias("type"), F.col("skewness").alias("value")
        )
        if self.other_names:
            found = found.unionByName(
                self.categorical()
                .where("high_cardinality")
                .select(
                    "column_name", F.lit("high_cardinality").alias("type"), F.col("cardinality").cast("double").alias("value")
                )
            )
        if self.target and self.target_is_classes():
            found = found.unionByName(
                self.target_imbalance()
                .where("imbalanced")
                .select(F.lit(self.target).alias("column_name"), F.lit("class_imbalance").alias("type"), F.col("ratio").alias("value"))
            )
        return found


def distribution(
    df: DataFrame, target: str | None = None, columns: str | Sequence[str] | None = None, approx: bool = False
) -> DistributionReport:
    """Profile the listed columns (plus the target) or the whole table.

    With ``approx`` quantiles, cardinalities and top values are estimated by mergeable sketches; their errors are stated in
    ``functions/sketches.py``.
    """
    listed = parse_columns(columns)
    if listed:
        keep = set(listed) | ({target} if target else set())
        df = df.select(*[f"`{c}`" for c in df.columns if c in keep])
    numeric = numeric_columns(df)
    other = [name for name in df.columns if name not in numeric]
    return DistributionReport(df, numeric, other, target if target in df.columns else None, approx)
