"""Column and parameter suggestions read off a profile and the report tables.

Every rule is a filter or a join over tables with one row per column or pair of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.stats import settled
from tablewright.operators.correlation import CorrelationReport
from tablewright.operators.distribution import DistributionReport
from tablewright.operators.missing import MissingReport
from tablewright.operators.outliers import OutlierReport

STRONG_SKEW = 1.0
OUTLIER_SHARE = 0.05
PAIR_CORRELATION = 0.5
MISSING_SHARE = 0.3
SELECTOR_THRESHOLD = 0.05


def correlation_section(report: CorrelationReport) -> DataFrame:
    """High pairs and target correlations in one table."""
    pairs = report.high_pairs().select(F.lit("high_pair").alias("kind"), "a", "b", "r")
    ranking = report.target_ranking().select(
        F.lit("target").alias("kind"), F.col("feature").alias("a"), F.lit(report.target).alias("b"), "r"
    )
    return pairs.unionByName(ranking)


def distribution_section(report: DistributionReport) -> DataFrame:
    return report.numeric().select("column_name", "skewness", "kurtosis", "mean", "std")


def missing_section(report: MissingReport) -> DataFrame:
    return report.columns().select("column_name", "missing_pct", "severity")


def outlier_section(report: OutlierReport) -> DataFrame:
    return (
        report.columns()
        .where(F.col("outlier_count") > 0)
        .select("column_name", F.lit(report.method).alias("method"), "outlier_pct", "z_max", "upper_fence")
    )


@dataclass(frozen=True)
class Suggestions:
    """Rules over a profile (one row per column) and whichever reports are at hand."""

    profile: DataFrame
    correlation: DataFrame | None = None
    distribution: DataFrame | None = None
    missing: DataFrame | None = None
    outliers: DataFrame | None = None

    def __post_init__(self):
        # One line per column or pair of columns: read once, not once per rule.
        for name in ("profile", "correlation", "distribution", "missing", "outliers"):
            frame = getattr(self, name)
            if frame is not None:
                object.__setattr__(self, name, settled(frame))

    def target(self) -> DataFrame:
        """The first column with the target role."""
        return self.profile.where(F.col("role") == "target").orderBy("position").limit(1).select("column_name")

    def _continuous(self) -> DataFrame:
        return self.profile.where(
            (F.col("semantic_type") == "continuous") & ~F.col("role").isin("identifier", "target")
        ).select("position", "column_name")

    def outlier_columns(self) -> DataFrame:
        return self._continuous().select("column_name")

    def scale_columns(self) -> DataFrame:
        return self._continuous().select("column_name")

    def log_columns(self) -> DataFrame:
        """Continuous columns that are skewed or rich in outliers; all of them if none is."""
        names = self._continuous()
        reasons = None
        if self.distribution is not None:
            reasons = self.distribution.where(F.abs("skewness") > STRONG_SKEW).select(
                "column_name", F.lit("skewed").alias("reason")
            )
        if self.outliers is not None:
            rich = self.outliers.where(F.col("outlier_pct") > OUTLIER_SHARE).select(
                "column_name", F.lit("outliers").alias("reason")
            )
            reasons = rich if reasons is None else reasons.unionByName(rich)
        fallback = names.select("column_name", F.lit("fallback").alias("reason"))
        if reasons is None:
            return fallback
        merged = reasons.groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_set("reason")), "+").alias("reason"))
        hits = names.join(merged, "column_name").select("column_name", "reason")
        scored = names.join(hits, "column_name", "left").withColumn(
            "any_hit", F.max(F.col("reason").isNotNull()).over(Window.partitionBy(F.lit(0)))
        )
        return scored.where(F.col("reason").isNotNull() | ~F.col("any_hit")).select(
            "column_name", F.coalesce("reason", F.lit("fallback")).alias("reason")
        )

    def interaction_pairs(self) -> DataFrame:
        return self.correlation.where((F.col("kind") == "high_pair") & (F.abs("r") > PAIR_CORRELATION)).select(
            "a", "b", "r"
        )

    def datetime_column(self) -> DataFrame:
        return self.profile.where(F.col("semantic_type") == "datetime").orderBy("position").limit(1).select("column_name")

    def drop_columns(self) -> DataFrame:
        return self.profile.where(F.col("role") == "identifier").select("column_name")

    def impute_constant(self) -> DataFrame:
        """Heavily incomplete columns; their presence suggests filling with the constant 0."""
        return self.missing.where(F.col("missing_pct") > MISSING_SHARE).select(
            "column_name", F.lit("constant").alias("strategy"), F.lit("0").alias("constant_value")
        )

    def selector(self) -> DataFrame:
        """Selection by target correlation as soon as such correlations are known."""
        return (
            self.correlation.where(F.col("kind") == "target")
            .limit(1)
            .select(F.lit("correlation_with_target").alias("method"), F.lit(SELECTOR_THRESHOLD).alias("threshold"))
        )

    def encode_columns(self) -> DataFrame:
        return self.profile.where(
            F.col("semantic_type").isin("categorical", "ordinal", "binary")
            & ~F.col("role").isin("target", "identifier")
        ).select("column_name")

    def table(self) -> DataFrame:
        """All column rules as ``(rule, column, reason)``."""
        rules = {
            "target": self.target(),
            "outlier_detection": self.outlier_columns(),
            "scale": self.scale_columns(),
            "log": self.log_columns(),
            "datetime": self.datetime_column(),
            "drop": self.drop_columns(),
            "encode": self.encode_columns(),
        }
        if self.missing is not None:
            rules["impute_constant"] = self.impute_constant()
        frames = []
        for rule, frame in rules.items():
            reason = F.col("reason") if "reason" in frame.columns else F.lit("profile")
            frames.append(frame.select(F.lit(rule).alias("rule"), "column_name", reason.alias("reason")))
        if self.correlation is not None:
            frames.append(
                self.interaction_pairs().select(
                    F.lit("interaction").alias("rule"), F.concat_ws(":", "a", "b").alias("column_name"), F.lit("correlated").alias("reason")
                )
            )
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out
