"""Confusion matrix with per-class precision, recall and F1."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_text
from tablewright.functions.stats import local_frame

#: How a missing label is written.
NO_LABEL = "None"
#: Labels of a dense matrix at most: four million cells.
DENSE_LABELS = 2_000
IMBALANCE = 3
LOW_RECALL = 0.5


def ratio(top: Column, bottom: Column) -> Column:
    """0 where undefined, as the metrics want it."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def pair_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, y_true, y_pred, count)``: every classification metric derives from this."""
    labels = [F.coalesce(as_text(df, c), F.lit(NO_LABEL)).alias(c) for c in ("y_true", "y_pred")]
    return df.groupBy(*keys, *labels).agg(F.count(F.lit(1)).alias("count"))


def label_scores(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, label, tp, predicted, support, precision, recall, f1)``, unrounded.

    Labels are the union of the true and the predicted ones.
    """
    hit = F.col("y_true") == F.col("y_pred")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(hit, F.col("count")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("count").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    summed = (
        counts.select(*keys, F.explode(sides).alias("side"))
        .groupBy(*keys, "side.label")
        .agg(
            F.sum("side.tp").alias("tp"),
            F.sum("side.predicted").alias("predicted"),
            F.sum("side.support").alias("support"),
        )
    )
    return summed.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
            "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


@dataclass(frozen=True)
class ConfusionReport:
    predictions: DataFrame

    @property
    def absent(self) -> list[str]:
        return [c for c in ("y_true", "y_pred") if c not in self.predictions.columns]

    @cached_property
    def _counts(self) -> DataFrame:
        return pair_counts(self.predictions)

    @property
    def labels(self) -> DataFrame:
        """All labels as text, in one column ``label``."""
        return self._counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()

    def cells(self, dense: bool = True) -> DataFrame:
        """``(y_true, y_pred, count, row_share)``; ``dense`` lists the cells without a row too, labels x labels in all.

        More than ``DENSE_LABELS`` labels are refused unless ``dense`` is off, which gives one line per cell that has rows.
        """
        schema = "y_true string, y_pred string, count long, row_share double"
        if self.absent:
            return local_frame(self.predictions.sparkSession, [], schema)
        counts = self._counts
        if dense:
            many = self.labels.limit(DENSE_LABELS + 1).count()
            if many > DENSE_LABELS:
                raise ValueError(f"more than {DENSE_LABELS} labels; ask for dense=False")
            grid = self.labels.select(F.col("label").alias("y_true")).join(self.labels.select(F.col("label").alias("y_pred")))
            counts = grid.join(counts, ["y_true", "y_pred"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
        sums = counts.groupBy("y_true").agg(F.sum("count").alias("row_sum"))
        return counts.join(sums, "y_true").select(
            "y_true", "y_pred", "count", F.round(ratio(F.col("count"), F.col("row_sum")), 4).alias("row_share")
        )

    def per_class(self) -> DataFrame:
        if self.absent:
            return local_frame(
                self.predictions.sparkSession, [], "label string, precision double, recall double, f1 double, support long"
            )
        return label_scores(self._counts).select(
            "label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"
        )

    def summary(self) -> DataFrame:
        if self.absent:
            return self.predictions.agg(
                F.count(F.lit(1)).alias("total_samples"),
                F.lit(0).cast("long").alias("num_classes"),
                F.lit(0.0).alias("accuracy"),
            )
        scores = label_scores(self._counts)
        return scores.agg(
            F.sum("support").alias("total_samples"),
            F.count(F.lit(1)).alias("num_classes"),
            F.round(ratio(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        )

    def flags(self) -> DataFrame:
        """``(type, label)``; the imbalance flag has no label."""
        if self.absent:
            return local_frame(
                self.predictions.sparkSession, [("missing_columns", c) for c in self.absent], "type string, label string"
            )
        per_class = self.per_class()
        low = per_class.where((F.col("recall") < LOW_RECALL) & (F.col("support") > 0)).select(
            F.lit("low_recall").alias("type"), "label"
        )
        uneven = (
            per_class.agg(F.max("support").alias("most"), F.min("support").alias("least"))
            .where((F.col("most") > IMBALANCE * F.col("least")) & (F.col("least") > 0))
            .select(F.lit("class_imbalance").alias("type"), F.lit(None).cast("string").alias("label"))
        )
        return low.unionByName(uneven)


def confusion(predictions: DataFrame) -> ConfusionReport:
    return ConfusionReport(predictions)
