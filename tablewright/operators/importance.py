"""Ranked feature importance of a trained model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.stats import local_frame
from tablewright.operators.training import TrainedModel

DOMINANT, NEGLIGIBLE = 0.5, 0.01


@dataclass(frozen=True)
class ImportanceReport:
    model: TrainedModel

    def features(self, spark) -> DataFrame:
        """``(rank, feature, importance, raw_importance)``; importances sum to one."""
        found = self.model.raw_importances()
        values = found[1] if found else []
        total = sum(values)
        order = sorted(zip(self.model.features, values), key=lambda p: (-p[1], p[0]))
        rows = [(i + 1, f, v / total if total > 0 else v, v) for i, (f, v) in enumerate(order)]
        table = local_frame(spark, rows, "rank long, feature string, importance double, raw_importance double")
        return table.select(
            "rank", "feature", F.round("importance", 6).alias("importance"), F.round("raw_importance", 6).alias("raw_importance")
        )

    def top(self, spark, n: int) -> DataFrame:
        """The first ``n`` features and one line for the share of all others."""
        name = F.when(F.col("rank") <= n, F.col("feature")).otherwise("other")
        return (
            self.features(spark)
            .groupBy(name.alias("feature"))
            .agg(F.min("rank").alias("rank"), F.round(F.sum("importance"), 6).alias("importance"))
            .orderBy("rank")
        )

    def flags(self, spark) -> DataFrame:
        found = self.model.raw_importances()
        schema = "type string, feature string, value double"
        if found is None:
            return local_frame(spark, [("unsupported_model", self.model.kind, None)], schema)
        rows = self.features(spark).collect()
        flags = []
        if len(rows) >= 2 and rows[0]["importance"] > DOMINANT:
            flags.append(("dominant_feature", rows[0]["feature"], rows[0]["importance"]))
        weak = [r for r in rows if r["importance"] < NEGLIGIBLE]
        if weak and len(weak) < len(rows):
            flags.append(("negligible_features", None, float(len(weak))))
        if found[0] == "coefficient_magnitude":
            flags.append(("scaling", None, None))
        return local_frame(spark, flags, schema)


def feature_importance(model: TrainedModel) -> ImportanceReport:
    return ImportanceReport(model)
