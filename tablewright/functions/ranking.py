"""Ranks and running totals over distinct keys without a single-task sort.

A table with one row per key is cut into buckets by literal cut points, which are a pure
function of the key: retries and repartitioning cannot move a row. Rows are ranked inside
their bucket and shifted by the totals of the buckets before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.keep import lookup

#: Keys one task may order by itself. More keys are cut into several buckets.
KEYS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 2_000
SAMPLED_KEYS_PER_BUCKET = 50


def cut_points(keys: DataFrame, key: str, n_keys: int, per_bucket: int | None = None) -> list[Any]:
    """Sorted cut points splitting the distinct values of ``key`` into even buckets.

    The sample is picked by the hash of the value, so a hot value counts once, and holds
    at most about ``MAX_BUCKETS * SAMPLED_KEYS_PER_BUCKET`` values.
    """
    per_bucket = KEYS_PER_BUCKET if per_bucket is None else per_bucket
    n_buckets = min(MAX_BUCKETS, -(-n_keys // per_bucket))
    if n_buckets <= 1:
        return []
    modulus = max(1, n_keys // (n_buckets * SAMPLED_KEYS_PER_BUCKET))
    sample = (
        keys.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(modulus)) == 0))
        .select(key)
        .distinct()
    )
    found = sorted(row[0] for row in sample.collect())
    step = len(found) / n_buckets
    picks = sorted({found[int(step * i)] for i in range(1, n_buckets)}) if found else []
    return picks


def grouped_cut_points(
    keys: DataFrame, group: str, key: str, n_keys: dict[Any, int], per_bucket: int | None = None
) -> dict[Any, list[Any]]:
    """Cut points of every group's keys, from one job for all groups that need any."""
    per_bucket = KEYS_PER_BUCKET if per_bucket is None else per_bucket
    buckets = {g: min(MAX_BUCKETS, -(-n // per_bucket)) for g, n in n_keys.items()}
    cuts: dict[Any, list[Any]] = {g: [] for g in n_keys}
    large = {g: max(1, n_keys[g] // (b * SAMPLED_KEYS_PER_BUCKET)) for g, b in buckets.items() if b > 1}
    if not large:
        return cuts
    modulus = F.lit(1)
    for m in set(large.values()):
        modulus = F.when(F.col(group).isin([g for g in large if large[g] == m]), m).otherwise(modulus)
    sample = keys.where(F.col(group).isin(list(large)) & F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), modulus) == 0))
    found: dict[Any, list[Any]] = {g: [] for g in large}
    for g, value in sample.select(group, key).distinct().collect():
        found[g].append(value)
    for g, values in found.items():
        values.sort()
        if values:
            cuts[g] = sorted({values[int(len(values) / buckets[g] * i)] for i in range(1, buckets[g])})
    return cuts


def bucket_of(key: Column, cuts: Sequence[Any]) -> Column:
    """Number of cut points at or below ``key``, found by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def running_totals(
    keyed: DataFrame,
    key: str,
    totals: dict[str, str],
    cuts: Sequence[Any] | dict[Any, Sequence[Any]] = (),
    group: str | None = None,
    descending: bool = False,
    follow: dict[str, str] | None = None,
) -> DataFrame:
    """Add, per row, the sum of columns over all rows with an earlier key.

    ``keyed`` has one row per (group, key). ``totals`` maps new column -> summed column.
    ``follow`` maps new column -> column whose value in the next row (in key order) is
    wanted. ``cuts`` is a list, or one list per group value.
    """
    follow = follow or {}
    groups = [group] if group else []
    if isinstance(cuts, dict):
        bucket = F.lit(0)
        for value, points in cuts.items():
            if points:
                bucket = F.when(F.col(group) == F.lit(value), bucket_of(F.col(key), points)).otherwise(bucket)
        cut = any(cuts.values())
    else:
        bucket, cut = bucket_of(F.col(key), cuts), bool(cuts)
    order = F.col(key).desc() if descending else F.col(key).asc()
    work = keyed.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    columns = {name: F.coalesce(F.sum(source).over(earlier), F.lit(0)) for name, source in totals.items()}
    columns |= {name: F.lead(source).over(inside) for name, source in follow.items()}
    ranked = work.withColumns(columns)
    if not cut:
        return ranked.drop("_bucket")

    # At most MAX_BUCKETS rows per group: one row per bucket.
    first = F.max if descending else F.min
    parts = work.groupBy(*groups, "_bucket").agg(
        *[F.sum(source).alias(f"_sum_{name}") for name, source in totals.items()],
        *[
            first(F.struct(F.col(key), F.col(source)))[source].alias(f"_first_{name}")
            for name, source in follow.items()
        ],
    )
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    over = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(bucket_order)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
        *[F.lead(f"_first_{name}").over(over).alias(f"_next_{name}") for name in follow],
    )
    n_groups = len(cuts) if isinstance(cuts, dict) else 1
    joined = ranked.join(lookup(offsets, n_groups * MAX_BUCKETS), [*groups, "_bucket"])
    shifted = {name: F.col(name) + F.col(f"_off_{name}") for name in totals}
    shifted |= {name: F.coalesce(F.col(name), F.col(f"_next_{name}")) for name in follow}
    extra = ["_bucket", *[f"_off_{n}" for n in totals], *[f"_next_{n}" for n in follow]]
    return joined.withColumns(shifted).drop(*extra)


def average_ranks(df: DataFrame, name: str, value: Column, n_distinct: int, per_bucket: int | None = None) -> DataFrame:
    """``(value, rank)``: the mean 1-based rank shared by all rows holding a value."""
    keyed = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
    cuts = cut_points(df.select(value.alias("value")), "value", n_distinct, per_bucket)
    ranked = running_totals(keyed, "value", {"before": "n"}, cuts)
    return ranked.select(
        F.col("value").alias(f"_key_{name}"),
        (F.col("before") + (F.col("n") + 1) / 2).alias(f"_rank_{name}"),
    )
