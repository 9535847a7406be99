"""Exact ROC and precision-recall curves from prediction tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, as_text, col, is_numeric
from tablewright.functions.keep import cached, lookup
from tablewright.functions.ranking import grouped_cut_points, running_totals
from tablewright.functions.stats import local_frame

MAX_POINTS = 200
PROB_PREFIX = "y_prob_"
#: Labels without a probability column that are named.
OTHER_LABELS = 1_000


def probability_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PROB_PREFIX)]


def label_text(df: DataFrame, name: str) -> Column:
    return as_text(df, name)


def sorted_labels(df: DataFrame, name: str, labels: list[str]) -> list[str]:
    """Labels in the order of their values, not of their text, when they are numbers."""
    return sorted(labels, key=float) if is_numeric(df, name) else sorted(labels)


def score_steps(
    long: DataFrame, cuts: dict[str, list], positives: dict[str, int], negatives: dict[str, int]
) -> DataFrame:
    """Running counts of hits and misses per distinct score, best first.

    ``long`` has ``class, hit, score``, one row per prediction and class.
    """
    keyed = (
        long.groupBy("class", "score")
        .agg(F.sum("hit").alias("pos"), (F.count(F.lit(1)) - F.sum("hit")).alias("neg"))
        .withColumn("one", F.lit(1).cast("long"))
    )
    steps = running_totals(
        keyed,
        "score",
        {"pos_before": "pos", "neg_before": "neg", "index": "one"},
        cuts,
        group="class",
        descending=True,
        follow={"next_pos": "pos", "next_neg": "neg"},
    )
    rows = [(c, positives[c], negatives[c]) for c in positives]
    sizes = local_frame(long.sparkSession, rows, "class string, positives long, negatives long")
    return steps.join(lookup(sizes, len(rows)), "class").withColumns(
        {"tp": F.col("pos_before") + F.col("pos"), "fp": F.col("neg_before") + F.col("neg")}
    )


def step_areas(steps: DataFrame) -> DataFrame:
    """Unrounded areas per class; classes with one side only have none."""
    trapezoid = F.col("neg") * (F.col("pos_before") + F.col("pos") / 2)
    gain = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    summed = steps.groupBy("class").agg(
        F.sum(trapezoid).alias("area"),
        F.sum(gain).alias("gain"),
        F.max("positives").alias("p"),
        F.max("negatives").alias("n"),
    )
    return summed.where((F.col("p") > 0) & (F.col("n") > 0)).select(
        "class",
        (F.col("area") / F.col("p") / F.col("n")).alias("roc_auc"),
        (F.col("gain") / F.col("p")).alias("average_precision"),
        (F.col("p") / (F.col("p") + F.col("n"))).alias("prevalence"),
        (F.col("p") + F.col("n")).cast("long").alias("n"),
    )


@dataclass(frozen=True)
class Curves:
    """Curves of a prediction table: one for a binary target, one per class otherwise."""

    predictions: DataFrame
    per_bucket: int | None = None

    @cached_property
    def _facts(self) -> dict:
        """Class sizes and how many distinct scores there may be, from one grouped pass."""
        df = self.predictions
        if "y_true" not in df.columns:
            raise ValueError(f"the predictions have no y_true column, only {df.columns}")
        probs = probability_columns(df)
        if not probs:
            raise ValueError("curves need probabilities in y_prob_<class> columns, not only predicted labels")
        counted = df.where(col("y_true").isNotNull()).groupBy(label_text(df, "y_true").alias("label"))
        grouped = counted.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.approx_count_distinct(col(p)).alias(f"d{i}") for i, p in enumerate(probs)],
        )
        named = F.col("label").isin([p.removeprefix(PROB_PREFIX) for p in probs])
        # Labels with a probability column are read; of the others, which may be as many as there are rows, only a few.
        with cached(grouped) as held:
            rows = held.where(named).collect()
            others, more = held.where(~named).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if others <= OTHER_LABELS:
                rows += held.where(~named).collect()
                others = more = 0
        labels = sorted_labels(df, "y_true", [r["label"] for r in rows])
        if len(labels) + others < 2:
            raise ValueError(f"curves need at least 2 classes, found {labels}")
        distinct = {p: sum(r[f"d{i}"] for r in rows) for i, p in enumerate(probs)}
        return {
            "labels": labels,
            "sizes": {r["label"]: r["n"] for r in rows},
            "total": sum(r["n"] for r in rows) + more,
            "others": others,
            "distinct": distinct,
            "probs": probs,
        }

    @property
    def labels(self) -> list[str]:
        """All labels; beyond ``OTHER_LABELS`` without a probability column, only those that have one."""
        return self._facts["labels"]

    @property
    def task(self) -> str:
        return "binary" if len(self.labels) == 2 and not self._facts["others"] else "multiclass"

    @cached_property
    def scored(self) -> dict[str, str]:
        """``{class: score column}`` of the curves that can be drawn."""
        probs = self._facts["probs"]
        if self.task == "binary":
            positive = self.labels[1]
            name = f"{PROB_PREFIX}{positive}"
            return {positive: name if name in probs else sorted(probs)[-1]}
        return {c: f"{PROB_PREFIX}{c}" for c in self.labels if f"{PROB_PREFIX}{c}" in probs}

    @cached_property
    def _steps(self) -> DataFrame:
        """One row per class and distinct score, with totals over all higher scores.

        Scores are counted per value before the shuffle, so ties form one point and cost
        one row. Running totals use buckets of scores instead of one ordered task.
        """
        df, facts = self.predictions, self._facts
        cells = [
            F.struct(
                F.lit(label).alias("class"),
                (label_text(df, "y_true") == F.lit(label)).cast("long").alias("hit"),
                as_double(df, name).alias("score"),
            )
            for label, name in self.scored.items()
        ]
        long = (
            df.where(col("y_true").isNotNull()).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
        )
        return score_steps(
            long,
            self._cuts,
            {c: facts["sizes"][c] for c in self.scored},
            {c: facts["total"] - facts["sizes"][c] for c in self.scored},
        )

    @cached_property
    def _cuts(self) -> dict[str, list]:
        """Cut points of the scores of every class, from one job."""
        df, names = self.predictions, self.scored
        cells = [F.struct(F.lit(c).alias("class"), as_double(df, name).alias("score")) for c, name in names.items()]
        long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
        distinct = {c: self._facts["distinct"][name] for c, name in names.items()}
        return grouped_cut_points(long, "class", "score", distinct, self.per_bucket)

    def areas(self) -> DataFrame:
        """Unrounded ``(class, roc_auc, average_precision, prevalence, n)``.

        The ROC area is the trapezoid sum, ties counting half; average precision is the
        step sum of precision over gains in recall.
        """
        return step_areas(self._steps)

    def summary(self) -> DataFrame:
        return self.areas().select(
            "class",
            F.round("roc_auc", 4).alias("roc_auc"),
            F.round("average_precision", 4).alias("average_precision"),
            F.round("prevalence", 4).alias("prevalence"),
            "n",
        )

    def macro(self) -> DataFrame:
        """Means over the classes of the already rounded values."""
        return self.summary().agg(
            F.round(F.coalesce(F.avg("roc_auc"), F.lit(0.0)), 4).alias("macro_roc_auc"),
            F.round(F.coalesce(F.avg("average_precision"), F.lit(0.0)), 4).alias("macro_average_precision"),
            F.lit(len(self.labels)).cast("long").alias("n_classes"),
            F.lit(self._facts["total"]).cast("long").alias("n"),
        )

    def flags(self) -> DataFrame:
        """``(class, type)``: weak areas of a binary target, missing score columns otherwise."""
        spark = self.predictions.sparkSession
        if self.task == "multiclass":
            absent = [(c, "missing_prob_column") for c in self.labels if c not in self.scored]
            return local_frame(spark, absent, "class string, type string")
        auc, ap, share = F.col("roc_auc"), F.col("average_precision"), F.col("prevalence")
        tests = F.array(
            F.when(auc < 0.6, "low_roc_auc").when(auc < 0.7, "medium_roc_auc"),
            F.when(share < 0.1, "high_imbalance"),
            F.when((ap < share * 1.5) & (share < 0.5), "low_average_precision"),
        )
        return self.areas().select("class", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("type"))

    def _spread(self, points: DataFrame, x: str, y: str) -> DataFrame:
        """At most ``MAX_POINTS`` evenly spaced points per class, first and last included."""
        sizes = points.groupBy("class").agg(F.count(F.lit(1)).alias("total"))
        return (
            points.join(lookup(sizes, len(self.scored)), "class")
            .where(is_kept(F.col("i"), F.col("total")))
            .select("class", "i", F.round(x, 6).alias(x), F.round(y, 6).alias(y))
            .orderBy("class", "i")
        )

    def roc(self) -> DataFrame:
        """Curve points from (0, 0) on, corners only: points inside a straight run are left out."""
        inner = F.col("next_pos").isNotNull() & (F.col("index") > 0)
        straight = inner & (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        corners = self._steps.where(~F.coalesce(straight, F.lit(False))).select("class", "score", "tp", "fp", "positives", "negatives")
        keyed = corners.withColumn("one", F.lit(1).cast("long"))
        numbered = running_totals(keyed, "score", {"i": "one"}, self._cuts, group="class", descending=True)
        points = numbered.select(
            "class",
            (F.col("i") + 1).alias("i"),
            (F.col("fp") / F.col("negatives")).alias("fpr"),
            (F.col("tp") / F.col("positives")).alias("tpr"),
        )
        origin = local_frame(
            self.predictions.sparkSession,
            [(c, 0, 0.0, 0.0) for c in self.scored],
            "class string, i long, fpr double, tpr double",
        )
        return self._spread(points.unionByName(origin), "fpr", "tpr")

    def pr(self) -> DataFrame:
        """Curve points from full recall down to (0, 1)."""
        counted = self._steps.groupBy("class").agg(F.count(F.lit(1)).alias("steps"))
        points = self._steps.join(lookup(counted, len(self.scored)), "class").select(
            "class",
            (F.col("steps") - 1 - F.col("index")).alias("i"),
            (F.col("tp") / F.col("positives")).alias("recall"),
            (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        )
        last = counted.select(
            "class", F.col("steps").alias("i"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
        )
        return self._spread(points.unionByName(last), "recall", "precision")


def is_kept(i: Column, total: Column, keep: int = MAX_POINTS) -> Column:
    """True for the positions floor(j * step), 0 <= j < keep - 1, and for the last one."""
    step = (total - 1) / F.lit(float(keep - 1))
    near = F.floor(i / step)

    def on_grid(j: Column) -> Column:
        return (j < keep - 1) & (F.floor(j * step) == i)

    return (total <= keep) | (i == total - 1) | on_grid(near) | on_grid(near + 1)


def curves(predictions: DataFrame) -> Curves:
    return Curves(predictions)
