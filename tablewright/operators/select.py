"""Drop numeric features that carry too little, judged on the training part."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, numeric_columns, require_distinct_names, require_target
from tablewright.functions.keep import persisted
from tablewright.functions.ranking import bucket_of
from tablewright.functions.stats import column_stats, local_frame, quantiles, settled
from tablewright.operators.fitted import Projection

METHODS = ("variance_threshold", "correlation_with_target", "mutual_information")
MAX_BINS = 20


@dataclass(frozen=True)
class FeatureSelector:
    """Only numeric features are scored; the others and the target stay."""

    method: str = "variance_threshold"
    threshold: float = 0.01
    target: str | None = None

    def scores(self, train: DataFrame) -> DataFrame:
        """``(feature, score, dropped)``; a feature without values has no score."""
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; choose one of {METHODS}")
        require_distinct_names(train)
        if self.method != "variance_threshold":
            require_target(train, self.target)
        features = numeric_columns(train, exclude=[self.target])
        table = getattr(self, f"_{self.method}")(train, {f: as_double(train, f) for f in features})
        poor = F.col("score") <= self.threshold if self.method == "variance_threshold" else F.col("score") < self.threshold
        return table.withColumn("dropped", F.coalesce(poor, F.lit(True)))

    def fit(self, train: DataFrame) -> Projection:
        # One line per numeric column.
        rows = self.scores(train).collect()
        dropped = tuple(r["feature"] for r in rows if r["dropped"])
        if len(dropped) == len(rows):
            raise ValueError(f"all {len(rows)} numeric features fall below the threshold {self.threshold}")
        return Projection(
            dropped=dropped,
            rows=tuple((r["feature"], self.method, r["score"], r["dropped"]) for r in rows),
            schema="feature string, method string, score double, dropped boolean",
        )

    def _variance_threshold(self, train: DataFrame, values: dict[str, Column]) -> DataFrame:
        found = column_stats(train, values, {"var": F.var_samp})
        return local_frame(
            train.sparkSession, [(n, f["var"]) for n, f in found.items()], "feature string, score double"
        )

    def _correlation_with_target(self, train: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Absolute Pearson r over the rows where both sides are present; undefined counts as 0."""
        y = as_double(train, self.target)
        found = column_stats(
            train,
            values,
            {
                "n": F.count,
                "r": lambda x: F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))),
            },
        )
        rows = []
        for name, f in found.items():
            r = f["r"]
            r = 0.0 if r is None or math.isnan(r) else abs(r)
            rows.append((name, r if f["n"] else None))
        return local_frame(train.sparkSession, rows, "feature string, score double")

    def _mutual_information(self, train: DataFrame, values: dict[str, Column]) -> DataFrame:
        if not values:
            return local_frame(train.sparkSession, [], "feature string, score double")
        # Read five times, so the numeric columns are kept for the duration.
        narrow = train.select(*[value.alias(f"f{i}") for i, value in enumerate(values.values())], as_double(train, self.target).alias("t"))
        with persisted(narrow) as held:
            plain = {name: F.col(f"f{i}") for i, name in enumerate(values)}
            return settled(mutual_information(held, plain, F.col("t")))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def mutual_information(df: DataFrame, values: dict[str, Column], target: Column) -> DataFrame:
    """``(feature, score)``: mutual information in nats over quantile bins of both sides.

    Bin edges are exact quantiles over the rows where both sides are finite. The joint table
    has at most 20 x 20 cells per feature and is counted map-side.
    """
    both = {n: _finite(v) & _finite(target) for n, v in values.items()}
    pairs = {("x", n): F.when(both[n], v) for n, v in values.items()}
    pairs |= {("y", n): F.when(both[n], target) for n in values}
    sizes = {n: f["n"] for n, f in column_stats(df, {n: pairs["x", n] for n in values}, {"n": F.count}).items()}
    probs, counts = {}, {}
    for n, size in sizes.items():
        bins = min(MAX_BINS, max(2, math.isqrt(size)))
        inner = [i / bins for i in range(1, bins)]
        probs["x", n] = probs["y", n] = inner
        counts["x", n] = counts["y", n] = size
    edges = quantiles(df, pairs, probs, counts)
    cells, unscored, placed = [], [], {}
    for n, size in sizes.items():
        if size < 2:
            unscored.append((n, None if size == 0 else 0.0))
            continue
        at = len(cells)
        placed[f"x{at}"], placed[f"y{at}"] = pairs["x", n], pairs["y", n]
        xb = bucket_of(F.col(f"x{at}"), sorted(set(edges["x", n])))
        yb = bucket_of(F.col(f"y{at}"), sorted(set(edges["y", n])))
        cells.append(
            F.when(F.col(f"x{at}").isNotNull(), F.struct(F.lit(n).alias("feature"), xb.alias("xb"), yb.alias("yb")))
        )
    fixed = local_frame(df.sparkSession, unscored, "feature string, score double")
    if not cells:
        return fixed
    joint = (
        df.select(*[value.alias(name) for name, value in placed.items()])
        .select(F.explode(F.array(*cells)).alias("cell"))
        .where("cell is not null")
        .groupBy("cell.feature", "cell.xb", "cell.yb")
        .count()
    )
    shares = joint.select(
        "feature",
        "count",
        F.sum("count").over(Window.partitionBy("feature")).alias("n"),
        F.sum("count").over(Window.partitionBy("feature", "xb")).alias("nx"),
        F.sum("count").over(Window.partitionBy("feature", "yb")).alias("ny"),
    )
    p = F.col("count") / F.col("n")
    gain = p * F.log(F.col("count") * F.col("n") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.greatest(F.sum(gain), F.lit(0.0)).alias("score")).unionByName(fixed)
