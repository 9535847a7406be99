"""Opt-in approximate statistics from mergeable sketches, one pass over any number of columns.

Distinct values: HyperLogLog of 2**14 registers, standard error 0.8 %. Quantiles: KLL with k = 2000, within 0.3 % of the rank
(99 % of the time). Frequent values: counts off by at most about 4 / ``TRACKED`` of the rows, exact up to about that many values.

``distinct_sketches`` and ``quantile_sketches`` keep the sketches as columns, one row per column of the table, so that those of
days or partitions can be stored and joined later with ``merged`` without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_text, measured, missing
from tablewright.functions.stats import AGGREGATES_PER_JOB, batched

DISTINCT_LG_K = 14
#: Three standard errors of a distinct count, as a share of it.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_LG_K / 2)
QUANTILE_K = 2000
QUANTILE_ERROR = 0.003
TRACKED = 10_000


def hashed(df: DataFrame, name: str) -> Column:
    """64 bits of a cell's value, null where it is missing; the same for equal values of any type."""
    kind = dict(df.dtypes)[name]
    value = measured(df, name) + F.lit(0.0) if kind in ("double", "float") else as_text(df, name)
    return F.when(~missing(df, name), F.xxhash64(value))


def _one_row_per_column(df: DataFrame, sketches: dict[str, Column]) -> DataFrame:
    """``(column_name, sketch)`` from aggregates over the whole table."""
    frames = []
    for names in batched(list(sketches), AGGREGATES_PER_JOB):
        held = df.agg(*[sketches[n].alias(f"s{i}") for i, n in enumerate(names)])
        rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, n in enumerate(names)])
        frames.append(held.select(F.explode(rows).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, frames)


def distinct_sketches(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, sketch)``: a HyperLogLog sketch of every column's values."""
    names = list(df.columns if names is None else names)
    return _one_row_per_column(df, {n: F.hll_sketch_agg(hashed(df, n), DISTINCT_LG_K) for n in names})


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """``(column_name, unique_count)`` of distinct sketches."""
    return sketches.select("column_name", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long").alias("unique_count"))


def quantile_sketches(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(column_name, sketch)``: a KLL sketch of every column's numbers."""
    return _one_row_per_column(df, {n: F.kll_sketch_agg_double(v, QUANTILE_K) for n, v in values.items()})


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``(column_name, quantiles)``: one array per column, null without values."""
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    found = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))
    return sketches.select("column_name", found.alias("quantiles"))


def merged(sketches: DataFrame, kind: str) -> DataFrame:
    """Sketches of several tables, added by column: kind is ``distinct`` or ``quantile``."""
    if kind not in ("distinct", "quantile"):
        raise ValueError(f"unknown kind of sketch {kind!r}; choose distinct or quantile")
    union = F.hll_union_agg("sketch") if kind == "distinct" else F.kll_merge_agg_double("sketch")
    return sketches.groupBy("column_name").agg(union.alias("sketch"))


def approx_quantiles(df: DataFrame, values: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """``{column: quantiles}``, None where a column has no value."""
    if not values:
        return {}
    found = dict(sketched_quantiles(quantile_sketches(df, values), probs).collect())
    return {n: list(found[n]) if found[n] else [None] * len(probs) for n in values}


def approx_top_values(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """``(column_name, value, count)``: the ``k`` most frequent values of each column and some more, without a shuffle of values."""
    frames = []
    for chunk in batched(list(names), AGGREGATES_PER_JOB):
        texts = df.select(*[as_text(df, n).alias(f"t{i}") for i, n in enumerate(chunk)])
        # more than k, for ties at the end and for nulls, which take a place
        held = texts.agg(*[F.expr(f"approx_top_k(t{i}, {max(k + 1, TRACKED // 10)}, {TRACKED})").alias(f"s{i}") for i in range(len(chunk))])
        rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"s{i}").alias("top")) for i, n in enumerate(chunk)])
        top = held.select(F.explode(rows).alias("r")).select("r.column_name", F.explode("r.top").alias("x"))
        frames.append(top.select("column_name", F.col("x.item").alias("value"), F.col("x.count").alias("count")).where("value is not null"))
    return reduce(DataFrame.unionByName, frames)
