"""Classification and regression metrics per split, and the summary of one prediction table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, col, is_numeric, measured
from tablewright.functions.keep import cached
from tablewright.functions.ranking import grouped_cut_points
from tablewright.functions.stats import local_frame
from tablewright.operators.confusion import label_scores, pair_counts, ratio
from tablewright.operators.curves import (
    PROB_PREFIX,
    label_text,
    probability_columns,
    score_steps,
    sorted_labels,
    step_areas,
)
from tablewright.splits import PARTS, Splits

ACCURACY_GAP = 0.05
RMSE_RATIO = 1.3
IMBALANCED = 0.65
MAX_CLASSES = 20


def _usable(splits: Splits) -> Splits:
    """Parts with the two label columns; an empty part simply has no rows in the reports."""
    if splits.source is not None:
        held = splits if {"y_true", "y_pred"} <= set(splits.source.columns) else None
    else:
        kept = {name: df for name, df in splits.items() if {"y_true", "y_pred"} <= set(df.columns)}
        held = Splits(**{"train": None, **kept}) if kept else None
    if held is None or held.tagged().isEmpty():
        raise ValueError("no part holds predictions with y_true and y_pred")
    return held


def _tagged(splits: Splits) -> DataFrame:
    """Labels of all parts in one table; probability columns are not needed for the counts."""
    return splits.project(lambda df: df.select(*[c for c in df.columns if c in ("split", "y_true", "y_pred")])).tagged()


def _paired(table: DataFrame) -> DataFrame:
    """One row with a ``train_`` and ``val_`` version of each column, if both parts exist."""
    names = [c for c in table.columns if c != "split"]
    return table.agg(
        *[
            F.max(F.when(F.col("split") == part, F.col(c))).alias(f"{part}_{c}")
            for part in ("train", "val")
            for c in names
        ]
    )


def split_areas(splits: Splits) -> DataFrame:
    """``(split, auc)``: the positive class's ROC area, or the mean over three or more classes.

    A split without probabilities, with one class, or with a class lacking its column has none.
    """
    df = splits.tagged()
    probs = probability_columns(df)
    empty = local_frame(df.sparkSession, [], "split string, auc double")
    if not probs:
        return empty
    grouped = (
        df.where(F.col("y_true").isNotNull())
        .groupBy("split", label_text(df, "y_true").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(col(p)).alias(f"d{i}") for i, p in enumerate(probs)])
    )
    named = F.col("label").isin([p.removeprefix(PROB_PREFIX) for p in probs])
    line = F.struct(*[F.col(c) for c in grouped.columns])
    # Labels with a probability column are read. Of the others, however many, the number and two per part: more than two
    # labels of which one has no column give no area.
    with cached(grouped) as held:
        groups = held.where(named).collect()
        others = held.where(~named).groupBy("split").agg(F.count(F.lit(1)).alias("k"), F.min(line).alias("lo"), F.max(line).alias("hi")).collect()
    groups += [r["lo"] for r in others] + [r["hi"] for r in others if r["k"] > 1]
    barred = {r["split"] for r in others if r["k"] > 2}
    cells, distinct, positives, negatives = [], {}, {}, {}
    for part in sorted({g["split"] for g in groups} - barred):
        mine = [g for g in groups if g["split"] == part]
        labels = sorted_labels(df, "y_true", [g["label"] for g in mine])
        named = {c: f"{PROB_PREFIX}{c}" for c in labels}
        if len(labels) == 2:
            last = named[labels[1]]
            named = {labels[1]: last if last in probs else sorted(probs)[-1]}
        if len(labels) < 2 or any(p not in probs for p in named.values()):
            continue
        sizes = {g["label"]: g["n"] for g in mine}
        for label, prob in named.items():
            key = f"{part}|{label}"
            at = probs.index(prob)
            score = as_double(df, prob)
            positives[key], negatives[key] = sizes[label], sum(sizes.values()) - sizes[label]
            distinct[key] = sum(g[f"d{at}"] for g in mine)
            cells.append(
                F.when(
                    F.col("split") == part,
                    F.struct(
                        F.lit(key).alias("class"),
                        (label_text(df, "y_true") == F.lit(label)).cast("long").alias("hit"),
                        score.alias("score"),
                    ),
                )
            )
    if not cells:
        return empty
    long = (
        df.where(F.col("y_true").isNotNull())
        .select(F.explode(F.array(*cells)).alias("cell"))
        .where("cell is not null")
        .select("cell.*")
    )
    cuts = grouped_cut_points(long, "class", "score", distinct)
    areas = step_areas(score_steps(long, cuts, positives, negatives))
    return areas.groupBy(F.split("class", "[|]")[0].alias("split")).agg(F.avg("roc_auc").alias("auc"))


@dataclass(frozen=True)
class ClassificationReport:
    splits: Splits

    @cached_property
    def _scores(self) -> DataFrame:
        return label_scores(pair_counts(_tagged(self.splits), ("split",)), ("split",))

    def per_label(self) -> DataFrame:
        return self._scores.select(
            "split", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
        )

    def metrics(self) -> DataFrame:
        """One row per split: label scores from one table of pair counts, areas from one of scores."""
        summed = self._scores.groupBy("split").agg(
            F.round(ratio(F.sum("tp"), F.sum("support")), 6).alias("accuracy"),
            F.round(F.avg("f1"), 6).alias("f1_macro"),
            F.round(F.avg("precision"), 6).alias("precision_macro"),
            F.round(F.avg("recall"), 6).alias("recall_macro"),
            F.sum("support").alias("support"),
        )
        return summed.join(split_areas(self.splits), "split", "left").withColumn("auc", F.round("auc", 6))

    def flags(self) -> DataFrame:
        """Overfitting: train accuracy more than 0.05 above validation."""
        pair = _paired(self.metrics().select("split", "accuracy"))
        gap = F.col("train_accuracy") - F.col("val_accuracy")
        return pair.where(gap > ACCURACY_GAP).select(
            F.lit("overfitting").alias("type"), F.round(gap, 6).alias("gap")
        )

    def class_info(self) -> DataFrame:
        """Majority label and balance in the largest split."""
        sized = self._scores.groupBy("split").agg(
            F.sum("support").alias("n"),
            F.count(F.lit(1)).alias("n_classes"),
            F.min_by("label", F.struct(-F.col("support"), F.col("label"))).alias("majority_label"),
            F.max("support").alias("most"),
        )
        order = F.create_map(*[F.lit(x) for i, p in enumerate(PARTS) for x in (p, i)])
        largest = sized.orderBy(F.col("n").desc(), order[F.col("split")]).limit(1)
        share = F.round(ratio(F.col("most"), F.col("n")), 4)
        return largest.select(
            "split",
            "n_classes",
            "majority_label",
            share.alias("majority_pct"),
            (F.col("n_classes") == 2).alias("is_binary"),
            (share > IMBALANCED).alias("is_imbalanced"),
        )

    def split_shares(self) -> DataFrame:
        """Rows per split and their share of all rows in whole percent."""
        sizes = self._scores.groupBy("split").agg(F.sum("support").alias("support"))
        # One row per split: at most three.
        total = sizes.agg(F.sum("support")).first()[0]
        return sizes.select(
            "split",
            "support",
            F.lit(total).cast("long").alias("total_samples"),
            F.bround(F.col("support") / F.lit(total) * 100, 0).cast("long").alias("pct"),
        )


def classification_metrics(splits: Splits) -> ClassificationReport:
    return ClassificationReport(_usable(splits))


def regression_aggregates(y: Column, p: Column) -> dict[str, Column]:
    """MAE, MSE and R² = 1 - SSres/SStot; a constant target gives 1 on a perfect fit, else 0."""
    error = y - p
    ss_res, ss_tot = F.sum(error * error), F.var_pop(y) * F.count(y)
    return {
        "mae": F.avg(F.abs(error)),
        "mse": F.avg(error * error),
        "r2": F.when(ss_tot > 0, F.lit(1.0) - F.try_divide(ss_res, ss_tot)).otherwise(
            F.when(ss_res == 0, 1.0).otherwise(0.0)
        ),
        "support": F.count(F.lit(1)),
    }


@dataclass(frozen=True)
class RegressionReport:
    splits: Splits

    def metrics(self) -> DataFrame:
        df = _tagged(self.splits)
        parts = regression_aggregates(as_double(df, "y_true"), as_double(df, "y_pred"))
        found = df.groupBy("split").agg(*[c.alias(n) for n, c in parts.items()])
        return found.select(
            "split",
            F.round("mae", 6).alias("mae"),
            F.round(F.sqrt("mse"), 6).alias("rmse"),
            F.round("r2", 6).alias("r2"),
            "support",
        )

    def flags(self) -> DataFrame:
        """Overfitting: validation RMSE more than 1.3 times the training RMSE."""
        pair = _paired(self.metrics().select("split", "rmse"))
        growth = F.try_divide("val_rmse", "train_rmse")
        exact = (F.col("train_rmse") == 0) & (F.col("val_rmse") > 0)
        return pair.where((growth > RMSE_RATIO) | exact).select(
            F.lit("overfitting").alias("type"), F.round(growth, 6).alias("ratio")
        )


def regression_metrics(splits: Splits) -> RegressionReport:
    return RegressionReport(_usable(splits))


@dataclass(frozen=True)
class PredictionSummary:
    """Preview of a prediction table; rows with a missing side are left out of the scores
    but still count in the size that accuracy is divided by."""

    predictions: DataFrame

    @cached_property
    def _pairs(self) -> DataFrame:
        df = self.predictions
        return df.select(
            _number(df, "y_true").alias("y"),
            _number(df, "y_pred").alias("p"),
        )

    @cached_property
    def task(self) -> str:
        valid = self._pairs.where("y is not null and p is not null")
        seen = valid.select("y").distinct().limit(MAX_CLASSES + 1).collect()
        whole = all(float(r["y"]).is_integer() for r in seen)
        return "classification" if whole and len(seen) <= MAX_CLASSES else "regression"

    def summary(self) -> DataFrame:
        y, p = F.col("y"), F.col("p")
        valid = y.isNotNull() & p.isNotNull()
        n = F.count(F.lit(1))
        if self.task == "classification":
            correct = F.count_if(valid & (y.cast("long") == F.rint(p).cast("long")))
            return self._pairs.agg(
                n.alias("n_samples"), correct.alias("correct"), F.round(ratio(correct, n), 4).alias("accuracy")
            )
        parts = regression_aggregates(F.when(valid, y), F.when(valid, p))
        ss_tot = F.var_pop(F.when(valid, y))
        return self._pairs.agg(
            n.alias("n_samples"),
            F.round(parts["mae"], 4).alias("mae"),
            F.round(F.sqrt(parts["mse"]), 4).alias("rmse"),
            F.round(F.when(ss_tot > 0, parts["r2"]).otherwise(0.0), 4).alias("r2"),
        )

    def cells(self) -> DataFrame:
        """Confusion counts of whole-number labels, predictions rounded half to even."""
        valid = self._pairs.where("y is not null and p is not null")
        return valid.groupBy(
            F.col("y").cast("long").cast("string").alias("y_true"),
            F.rint("p").cast("long").cast("string").alias("y_pred"),
        ).agg(F.count(F.lit(1)).alias("count"))


def _number(df: DataFrame, name: str) -> Column:
    return measured(df, name) if is_numeric(df, name) else F.col(name).try_cast("double")


def prediction_summary(predictions: DataFrame) -> PredictionSummary:
    return PredictionSummary(predictions)
