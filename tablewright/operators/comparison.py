"""Two to four models side by side on one test table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, log
from tablewright.operators.confusion import label_scores, pair_counts, ratio
from tablewright.operators.curves import sorted_labels
from tablewright.operators.metrics import regression_aggregates

HIGHER = ("accuracy", "precision", "recall", "f1_score", "r2")
LOWER = ("mse", "rmse", "mae")
TARGET_NAMES = ("target", "label", "y")
SMALL_TEST = 50
CLOSE_SCORE, CLOSE_ERROR = 0.02, 0.01


def pick_target(df: DataFrame, target: str | None = None) -> str:
    """The named column, else target, label or y, else the last column."""
    if target and target != "auto" and target in df.columns:
        return target
    for name in TARGET_NAMES:
        if name in df.columns:
            return name
    log.warning("no target column named; taking the last one, %s", df.columns[-1])
    return df.columns[-1]


@dataclass(frozen=True)
class Comparison:
    """``predictions`` has ``model, y_true, y_pred``, one block of rows per model."""

    predictions: DataFrame
    task: str
    names: list[str]

    @cached_property
    def _wide(self) -> DataFrame:
        if self.task == "regression":
            df = self.predictions
            parts = regression_aggregates(as_double(df, "y_true"), as_double(df, "y_pred"))
            found = df.groupBy("model").agg(*[c.alias(n) for n, c in parts.items()])
            return found.select("model", "mse", F.sqrt("mse").alias("rmse"), "mae", "r2", F.col("support").alias("rows"))
        scores = label_scores(pair_counts(self.predictions, ("model",)), ("model",))
        true_labels = self._true_labels
        weight = F.col("support")
        if len(true_labels) <= 2:
            # Binary: the scores of the positive class, which is 1 where present.
            positive = "1" if "1" in true_labels else true_labels[-1]
            chosen = {
                m: F.coalesce(F.max(F.when(F.col("label") == positive, F.col(m))), F.lit(0.0))
                for m in ("precision", "recall", "f1")
            }
        else:
            chosen = {m: ratio(F.sum(F.col(m) * weight), F.sum(weight)) for m in ("precision", "recall", "f1")}
        return scores.groupBy("model").agg(
            ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            chosen["precision"].alias("precision"),
            chosen["recall"].alias("recall"),
            chosen["f1"].alias("f1_score"),
            F.sum("support").alias("rows"),
        )

    @cached_property
    def _true_labels(self) -> list[str]:
        """True labels in order; only the first three matter for choosing the averaging."""
        df = self.predictions
        found = df.select(F.col("y_true").cast("string").alias("l")).distinct().limit(3).collect()
        return sorted_labels(df, "y_true", [r["l"] for r in found])

    def table(self) -> DataFrame:
        """``(model, metric, value, is_best)``; ties share the first place."""
        names = [c for c in self._wide.columns if c not in ("model", "rows")]
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        long = self._wide.select("model", F.explode(cells).alias("cell")).select("model", "cell.*")
        sign = F.when(F.col("metric").isin(*LOWER), -F.col("value")).otherwise(F.col("value"))
        # Two to four rows per metric.
        best = F.rank().over(Window.partitionBy("metric").orderBy(sign.desc()))
        return long.select("model", "metric", F.round("value", 6).alias("value"), (best == 1).alias("is_best"))

    def flags(self) -> DataFrame:
        """``(type, metric, value)``: results too close to tell apart, or a tiny test table."""
        spread = self.table().groupBy("metric").agg(
            (F.max("value") - F.min("value")).alias("spread"), F.max(F.abs("value")).alias("largest")
        )
        close = F.when(F.col("metric").isin(*HIGHER), F.col("spread") < CLOSE_SCORE).otherwise(
            F.col("spread") < CLOSE_ERROR * F.col("largest")
        )
        near = spread.where(close).select(
            F.lit("close_results").alias("type"), "metric", F.round("spread", 6).alias("value")
        )
        small = (
            self._wide.agg(F.max("rows").alias("rows"))
            .where(F.col("rows") < SMALL_TEST)
            .select(
                F.lit("small_test_set").alias("type"),
                F.lit(None).cast("string").alias("metric"),
                F.col("rows").cast("double").alias("value"),
            )
        )
        return near.unionByName(small)

    def summary(self) -> DataFrame:
        return self._wide.agg(
            F.count(F.lit(1)).alias("models_compared"), F.max("rows").alias("test_rows")
        ).withColumn("task", F.lit(self.task))


def compare_predictions(tables: dict[str, DataFrame], task: str | None = None) -> Comparison:
    """Compare ready prediction tables (``y_true``, ``y_pred``) by name."""
    from tablewright.operators.tasks import detect_task

    if not 2 <= len(tables) <= 4:
        raise ValueError(f"a comparison takes two to four models, not {len(tables)}")
    frames = [df.select(F.lit(name).alias("model"), "y_true", "y_pred") for name, df in tables.items()]
    task = task or detect_task(next(iter(tables.values())), "y_true")
    return Comparison(reduce(DataFrame.unionByName, frames), task, list(tables))


def compare_models(models: dict, test: DataFrame, target: str | None = None) -> Comparison:
    """Compare trained models on the same test table."""
    from tablewright.operators.tasks import detect_task

    if not 2 <= len(models) <= 4:
        raise ValueError(f"a comparison takes two to four models, not {len(models)}")
    target = pick_target(test, target)
    return compare_predictions(
        {name: model.predict(test, target) for name, model in models.items()}, detect_task(test, target)
    )
