"""Outliers per numeric column by quartile fences, z-score or either."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import measured, numeric_columns, resolve_columns
from tablewright.functions.stats import (
    COLUMNS_PER_JOB,
    batched,
    collect_aggregates,
    column_stats,
    local_frame,
    moments,
    quantiles,
)
from tablewright.operators.distribution import QUARTILES, DistributionReport

METHODS = ("iqr", "zscore", "both")
HIGH_RATE = 0.01
EXTREME_IQRS = 5
EXTREMES = 5

COLUMN_SCHEMA = (
    "column_name string, q1 double, q3 double, iqr double, lower double, upper double, mean double, std double, "
    "z_max double, outlier_count long, total long, min_value double, max_value double"
)


@dataclass(frozen=True)
class OutlierReport:
    df: DataFrame
    names: list[str]
    method: str
    multiplier: float
    threshold: float
    known: DistributionReport | None = None

    @cached_property
    def _facts(self) -> dict[str, dict]:
        """Moments and, for the fences and the extremes, exact quartiles of each column."""
        values = {name: measured(self.df, name) for name in self.names}
        if self.known is not None:
            facts = {name: self.known.facts(name) for name in values}
            kept = {name: value for name, value in values.items() if facts[name]["count"] > 0}
            cuts = {name: facts[name]["quartiles"] for name in kept}
        else:
            facts = column_stats(self.df, values, {**moments(), "rows": lambda _: F.count(F.lit(1))})
            kept = {name: value for name, value in values.items() if facts[name]["count"] > 0}
            cuts = quantiles(self.df, kept, QUARTILES, {n: facts[n]["count"] for n in kept})
        found = {}
        for name in kept:
            q1, median, q3 = cuts[name]
            iqr = q3 - q1
            std = facts[name]["std"]
            spread = None if not std else max(
                facts[name]["max"] - facts[name]["mean"], facts[name]["mean"] - facts[name]["min"]
            ) / std
            found[name] = {
                **facts[name],
                "q1": q1,
                "median": median,
                "q3": q3,
                "iqr": iqr,
                "lower": q1 - self.multiplier * iqr,
                "upper": q3 + self.multiplier * iqr,
                "z_max": 0.0 if std == 0 else spread,
            }
        return found

    def mask(self, name: str) -> Column:
        """True on outlying rows, false elsewhere; thresholds are literals."""
        fact, value = self._facts[name], measured(self.df, name)
        tests = []
        if self.method in ("iqr", "both"):
            tests.append((value < fact["lower"]) | (value > fact["upper"]))
        if self.method in ("zscore", "both") and fact["std"]:
            tests.append(F.abs((value - fact["mean"]) / fact["std"]) > self.threshold)
        found = F.lit(False)
        for test in tests:
            found = found | test
        return F.coalesce(found, F.lit(False))

    @cached_property
    def _outlier_counts(self) -> dict[str, int]:
        return collect_aggregates(self.df, {name: F.count_if(self.mask(name)) for name in self._facts})

    def columns(self) -> DataFrame:
        """One row per column that has a value, highest outlier share first."""
        quart, zed = self.method in ("iqr", "both"), self.method in ("zscore", "both")
        rows = []
        for name, f in self._facts.items():
            rows.append(
                (
                    name,
                    *((f["q1"], f["q3"], f["iqr"], f["lower"], f["upper"]) if quart else (None,) * 5),
                    *((f["mean"], f["std"], f["z_max"]) if zed else (None,) * 3),
                    self._outlier_counts[name],
                    f["rows"],
                    f["min"],
                    f["max"],
                )
            )
        table = local_frame(self.df.sparkSession, rows, COLUMN_SCHEMA)
        scored = table.withColumns(
            {
                "outlier_pct": F.round(F.col("outlier_count") / F.col("total"), 4),
                "above": F.when(F.col("iqr") > 0, F.greatest((F.col("max_value") - F.col("q3")) / F.col("iqr"), F.lit(0.0))),
                "below": F.when(F.col("iqr") > 0, F.greatest((F.col("q1") - F.col("min_value")) / F.col("iqr"), F.lit(0.0))),
            }
        )
        furthest = F.greatest("above", "below")
        return scored.select(
            "column_name",
            *[F.round(c, 4).alias(c) for c in ("q1", "q3", "iqr")],
            F.round("lower", 4).alias("lower_fence"),
            F.round("upper", 4).alias("upper_fence"),
            *[F.round(c, 4).alias(c) for c in ("mean", "std", "z_max")],
            "outlier_count",
            "outlier_pct",
            "min_value",
            "max_value",
            (F.col("outlier_pct") >= HIGH_RATE).alias("high_outlier_rate"),
            F.coalesce((F.col("outlier_count") > 0) & (furthest > EXTREME_IQRS), F.lit(False)).alias("extreme_outlier"),
            F.round(furthest, 1).alias("max_iqrs"),
        ).orderBy(F.col("outlier_pct").desc(), "column_name")

    def extremes(self, k: int = EXTREMES) -> DataFrame:
        """The ``k`` outliers per column furthest from the median.

        The rank filter lets Spark keep only ``k`` rows per column and task before the shuffle.
        """
        cells = [
            F.when(
                self.mask(name),
                F.struct(
                    F.lit(name).alias("column_name"),
                    measured(self.df, name).alias("value"),
                    F.abs(measured(self.df, name) - fact["median"]).alias("distance"),
                ),
            )
            for name, fact in self._facts.items()
        ]
        if not cells:
            return local_frame(self.df.sparkSession, [], "column_name string, rank long, value double")
        order = Window.partitionBy("column_name").orderBy(F.col("distance").desc(), "value")
        found = reduce(
            DataFrame.unionByName,
            [
                self.df.select(F.explode(F.array(*chunk)).alias("cell")).where("cell is not null").select("cell.*")
                for chunk in batched(cells, COLUMNS_PER_JOB)
            ],
        )
        return (
            found.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select("column_name", F.col("rank").cast("long").alias("rank"), "value")
        )

    def summary(self) -> DataFrame:
        counts = self._outlier_counts
        rows = next(iter(self._facts.values()))["rows"] if self._facts else self.df.count()
        return local_frame(
            self.df.sparkSession,
            [(rows, len(self.names), sum(1 for n in counts.values() if n), sum(counts.values()))],
            "total_rows long, numeric_columns long, columns_with_outliers long, total_outlier_cells long",
        )

    def flags(self) -> DataFrame:
        table = self.columns()
        rate = table.where("high_outlier_rate").select(
            "column_name", F.lit("high_outlier_rate").alias("type"), F.col("outlier_pct").alias("value")
        )
        far = table.where("extreme_outlier").select(
            "column_name", F.lit("extreme_outlier").alias("type"), F.col("max_iqrs").alias("value")
        )
        return rate.unionByName(far)


def outliers(
    df: DataFrame,
    method: str = "both",
    iqr_multiplier: float = 1.5,
    zscore_threshold: float = 3.0,
    columns: str | Sequence[str] | None = None,
    known: DistributionReport | None = None,
) -> OutlierReport:
    """Outlier report; the extreme-value flag is given for "iqr" and for "both".

    ``known`` is an exact distribution of the same table: its moments and quartiles are then not worked out again.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {METHODS}")
    names = numeric_columns(df)
    if columns:
        names = [name for name in resolve_columns(df, columns) if name in names]
    if known is not None and (known.df is not df or known.approx or not set(names) <= set(known.numeric_names)):
        raise ValueError("the known distribution is not an exact one of these columns of this table")
    return OutlierReport(df, names, method, float(iqr_multiplier), float(zscore_threshold), known)
