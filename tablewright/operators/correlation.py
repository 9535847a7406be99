"""Pearson and Spearman correlation of every pair of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.column_ranks import rank_correlations
from tablewright.functions.columns import measured, numeric_columns, resolve_columns
from tablewright.functions.products import masked_products, pair_moments
from tablewright.functions.stats import collect_aggregates, column_stats, local_frame

HIGH = 0.8
#: With more complete columns than this, pairs come from one matrix product.
GRAM_COLUMNS = 12
PAIR_SCHEMA = "method string, a string, b string, r double, abs_r double, high boolean"
METHODS = ("pearson", "spearman", "both")


@dataclass(frozen=True)
class CorrelationReport:
    """``pairs`` covers the upper triangle; ``main`` names the method flags are drawn from."""

    columns: list[str]
    pairs: DataFrame
    main: str
    target: str | None

    def ordered(self) -> DataFrame:
        return self.pairs.orderBy("method", F.col("abs_r").desc(), "a", "b")

    def high_pairs(self) -> DataFrame:
        return self.pairs.where((F.col("method") == self.main) & F.col("high")).select("a", "b", "r")

    def target_ranking(self) -> DataFrame:
        """Correlation of each other column with the target, strongest first."""
        target = F.lit(self.target)
        mine = self.pairs.where(
            (F.col("method") == self.main) & ((F.col("a") == target) | (F.col("b") == target))
        )
        feature = F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a"))
        return mine.select("method", feature.alias("feature"), "r").orderBy(F.abs("r").desc(), "feature")

    def matrix(self) -> DataFrame:
        """Long form of the full symmetric matrix, diagonal included."""
        upper = self.pairs.select("method", F.col("a").alias("row"), F.col("b").alias("col"), "r")
        lower = self.pairs.select("method", F.col("b").alias("row"), F.col("a").alias("col"), "r")
        diagonal = (
            self.pairs.select("method")
            .distinct()
            .select("method", F.explode(F.array(*[F.lit(c) for c in self.columns])).alias("row"))
            .select("method", "row", F.col("row").alias("col"), F.lit(1.0).alias("r"))
        )
        return upper.unionByName(lower).unionByName(diagonal)

    def summary(self) -> DataFrame:
        n = len(self.columns)
        counted = self.pairs.where(F.col("method") == self.main).agg(
            F.count(F.lit(1)).alias("total_pairs"),
            F.count_if(F.coalesce("high", F.lit(False))).alias("high_correlation_pairs"),
        )
        return counted.select(
            F.lit(n).cast("long").alias("numeric_columns"), "total_pairs", "high_correlation_pairs"
        )

    def flags(self) -> DataFrame:
        spark = self.pairs.sparkSession
        if len(self.columns) < 2:
            return local_frame(
                spark, [("insufficient_columns", None, None, None)], "type string, a string, b string, r double"
            )
        return self.high_pairs().select(F.lit("high_correlation").alias("type"), "a", "b", "r")


def correlation(
    df: DataFrame,
    method: str = "pearson",
    target: str | None = None,
    columns: str | Sequence[str] | None = None,
) -> CorrelationReport:
    """Pairwise-complete correlation; fewer than two numeric columns give an empty report."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {METHODS}")
    names = numeric_columns(df)
    if columns:
        names = [name for name in resolve_columns(df, columns) if name in names]
    spark = df.sparkSession
    main = "spearman" if method == "spearman" else "pearson"
    pairs = list(combinations(names, 2))
    if not pairs:
        return CorrelationReport(names, local_frame(spark, [], PAIR_SCHEMA), main, target)

    values = {name: measured(df, name) for name in names}
    facts = column_stats(
        df,
        values,
        {
            "count": F.count,
            "mean": F.avg,
            "min": F.min,
            "max": F.max,
            "distinct": F.approx_count_distinct,
            "rows": lambda _: F.count(F.lit(1)),
        },
    )
    rows = []
    if method in ("pearson", "both"):
        found = pearson_pairs(df, values, pairs, facts)
        rows += [("pearson", a, b, r) for (a, b), r in found.items()]
    if method in ("spearman", "both"):
        found = spearman_pairs(df, values, pairs, facts)
        rows += [("spearman", a, b, r) for (a, b), r in found.items()]
    table = local_frame(spark, rows, "method string, a string, b string, r double").select(
        "method", "a", "b", F.round("r", 6).alias("r"), F.round(F.abs("r"), 6).alias("abs_r")
    )
    return CorrelationReport(names, table.withColumn("high", F.col("abs_r") > HIGH), main, target)


def _is_complete(fact: dict) -> bool:
    return fact["count"] == fact["rows"]


def _is_constant(fact: dict) -> bool:
    return fact["count"] == 0 or fact["min"] == fact["max"]


def pearson_pairs(
    df: DataFrame,
    values: dict[str, Column],
    pairs: Sequence[tuple[str, str]],
    facts: dict[str, dict],
) -> dict[tuple[str, str], float | None]:
    """Pearson r per pair.

    Complete columns share plain sums of centred products (one product per pair and one
    square per column). Pairs with gaps need their own moments over the rows they share; one
    pass of masked products gives them all, and a second one, around the pair's own means, those
    whose values barely spread there. A column that holds an infinite value has no correlation.
    """
    solid = {name for name in values if _is_complete(facts[name])}
    result: dict[tuple[str, str], float | None] = {}
    aggregates: dict[tuple, Column] = {}
    centred = {name: values[name] - F.lit(facts[name]["mean"]) for name in solid if not _is_constant(facts[name])}
    live = [pair for pair in pairs if not (_is_constant(facts[pair[0]]) or _is_constant(facts[pair[1]]))]
    dense = [pair for pair in live if pair[0] in solid and pair[1] in solid]
    gappy = [pair for pair in live if pair not in set(dense)]
    names = sorted({name for pair in dense for name in pair})
    if len(names) > GRAM_COLUMNS:
        gram = _matrix(df, values, names)
        result.update({(a, b): float(gram[names.index(a)][names.index(b)]) for a, b in dense})
        dense, names = [], []
    for name in names:
        aggregates[("s", name)] = F.sum(centred[name])
        aggregates[("ss", name)] = F.sum(centred[name] * centred[name])
    for a, b in dense:
        aggregates[("sp", a, b)] = F.sum(centred[a] * centred[b])
    result.update(_gappy_pairs(df, values, gappy, facts))
    found = collect_aggregates(df, aggregates) if aggregates else {}
    for a, b in pairs:
        if (a, b) in result:
            continue
        if ("sp", a, b) in found:
            n = facts[a]["rows"]
            sxy = found["sp", a, b] - found["s", a] * found["s", b] / n
            sxx = found["ss", a] - found["s", a] ** 2 / n
            syy = found["ss", b] - found["s", b] ** 2 / n
            spread = (sxx * syy) ** 0.5
            result[a, b] = max(-1.0, min(1.0, sxy / spread)) if spread > 0 else None
        else:
            result[a, b] = None
    return result


def _gappy_pairs(df, values, pairs, facts) -> dict[tuple[str, str], float | None]:
    finite = {n for pair in pairs for n in pair if math.isfinite(facts[n]["min"]) and math.isfinite(facts[n]["max"])}
    result: dict[tuple[str, str], float | None] = {pair: None for pair in pairs}
    pairs = [pair for pair in pairs if pair[0] in finite and pair[1] in finite]
    if not pairs:
        return result
    names = list(dict.fromkeys(name for pair in pairs for name in pair))
    at = {name: i for i, name in enumerate(names)}
    held = {name: values[name] for name in names}
    sums = masked_products(df, held, [facts[name]["mean"] for name in names])
    moments, doubtful = {}, []
    for a, b in pairs:
        i, j = at[a], at[b]
        if sums.n[i, j] > 0 and sums.doubtful(i, j):
            doubtful.append((i, j))
        moments[i, j] = sums.moments(i, j)
    if doubtful:
        middle = [facts[name]["mean"] for name in names]
        centres = [(middle[i] + sums.s[i, j] / sums.n[i, j], middle[j] + sums.s[j, i] / sums.n[i, j]) for i, j in doubtful]
        for pair, (sxx, syy, sxy, constant) in pair_moments(df, held, doubtful, centres).items():
            moments[pair] = (0.0, 0.0, 0.0) if constant else (sxx, syy, sxy)
    for a, b in pairs:
        sxx, syy, sxy = moments[at[a], at[b]]
        spread = sxx * syy
        result[a, b] = float(max(-1.0, min(1.0, sxy / spread**0.5))) if spread > 0 else None
    return result


def _matrix(df: DataFrame, values: dict[str, Column], names: list[str]):
    """All pairs of many complete columns at once, from MLlib's one-pass matrix product."""
    plain = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
    vectors = VectorAssembler(inputCols=plain.columns, outputCol="v").transform(plain).select("v")
    return Correlation.corr(vectors, "v").first()[0].toArray()


def spearman_pairs(
    df: DataFrame,
    values: dict[str, Column],
    pairs: Sequence[tuple[str, str]],
    facts: dict[str, dict],
    per_bucket: int | None = None,
) -> dict[tuple[str, str], float | None]:
    """Pearson r of average ranks, ranked among the rows complete for the pair."""
    return rank_correlations(df, values, pairs, facts, per_bucket, None if per_bucket is None else 0)
