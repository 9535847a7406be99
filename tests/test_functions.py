import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import ranking, sketches, stats
from tablewright.functions.column_ranks import (
    Ranked,
    _Blocks,
    _count_bands,
    _Plan,
    _points,
    _products_by_exchange,
    rank_correlations,
)
from tablewright.functions.columns import parse_columns, require_distinct_names, resolve_columns
from tablewright.functions.keep import spread
from tablewright.functions.products import plain_columns
from tablewright.functions.stats import MEASURES_PER_JOB, column_stats, shape_moments
from tablewright.operators.correlation import correlation, spearman_pairs


def doubles(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


CASES = {
    "spread": lambda r: [r.random() * 1000 for _ in range(3000)],
    "few values": lambda r: [r.choice([1, 2, 5]) for _ in range(3000)],
    "hot value": lambda r: [7.0 if r.random() < 0.4 else r.random() * 20 for _ in range(3000)],
    "two hot ends": lambda r: [r.choice([0.0, 0.0, 10.0, 10.0, r.random() * 10]) for _ in range(3000)],
    "constant": lambda r: [3.25] * 500,
    "negative": lambda r: [-r.random() ** 3 for _ in range(2000)],
    "two rows": lambda r: [1.0, 4.0],
    "one row": lambda r: [9.0],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("direct", [0, 10**6])
def test_quantiles_match_numpy(spark, case, direct):
    values = CASES[case](random.Random(3))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = doubles(spark, values).repartition(5)
    found = stats.quantiles(df, {"v": F.col("v")}, probs, {"v": len(values)}, direct_rows=direct, readable_rows=3)
    assert found["v"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(float(i) if i % 2 else None, None) for i in range(100)], "v double, w double")
    values = {"v": F.col("v"), "w": F.col("w")}
    found = stats.quantiles(df, values, [0.5], {"v": 50, "w": 0}, direct_rows=0, readable_rows=2)
    assert found == {"v": [50.0], "w": [None]}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_do_not_depend_on_buckets(spark, descending):
    r = random.Random(5)
    data = {(g, r.randrange(500)): r.randrange(9) for g in ("a", "b") for _ in range(300)}
    keyed = spark.createDataFrame([(g, float(k), n) for (g, k), n in data.items()], "g string, k double, n long")
    cuts = {g: ranking.cut_points(keyed.where(F.col("g") == g), "k", 300, per_bucket=20) for g in ("a", "b")}
    assert all(len(c) > 5 for c in cuts.values())
    args = dict(totals={"before": "n"}, group="g", descending=descending, follow={"next_n": "n"})
    whole = ranking.running_totals(keyed, "k", cuts={}, **args).toPandas()
    split = ranking.running_totals(keyed.repartition(7), "k", cuts=cuts, **args).toPandas()
    order = ["g", "k"]
    cols = ["g", "k", "n", "before", "next_n"]
    a, b = (f[cols].sort_values(order).reset_index(drop=True) for f in (whole, split))
    pd.testing.assert_frame_equal(a, b)
    one = a[a.g == "a"].sort_values("k", ascending=not descending)
    assert list(one.before) == [0, *one.n.cumsum().iloc[:-1]]
    assert list(one.next_n.iloc[:-1]) == list(one.n.iloc[1:])


def test_cut_points_of_text(spark):
    df = spark.createDataFrame([(f"key{i:05d}",) for i in range(4000)] + [("hot",)] * 2000, "k string")
    cuts = ranking.cut_points(df, "k", 4001, per_bucket=500)
    assert cuts == sorted(cuts) and 4 <= len(cuts) <= 9
    sizes = df.distinct().groupBy(ranking.bucket_of(F.col("k"), cuts)).count().toPandas()["count"]
    assert sizes.max() < 1500


def test_average_ranks_match_pandas(spark):
    r = random.Random(1)
    values = [float(r.choice([1, 1, 1, r.randrange(400)])) for _ in range(2000)]
    df = doubles(spark, values)
    for per_bucket in (None, 10):
        found = ranking.average_ranks(df, "x", F.col("v"), 400, per_bucket).toPandas()
        expected = pd.Series(values).rank()
        by_value = dict(zip(values, expected))
        assert dict(zip(found._key_x, found._rank_x)) == by_value


def test_spearman_in_buckets_matches_pandas(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=1500), 1)
    frame = pd.DataFrame({"a": x, "b": x**3 + r.normal(size=1500), "c": r.integers(0, 4, 1500).astype(float)})
    df = spark.createDataFrame(frame)
    facts = {n: {"count": 1500, "rows": 1500, "distinct": frame[n].nunique()} for n in frame}
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    found = spearman_pairs(df, {n: F.col(n) for n in frame}, pairs, facts, per_bucket=40)
    expected = frame.corr("spearman")
    for a, b in pairs:
        assert found[a, b] == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_results_do_not_change_with_partitioning(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"a": r.normal(size=900), "b": r.integers(0, 9, 900)}))
    seen = {tuple(map(tuple, correlation(df.repartition(n), "both").ordered().collect())) for n in (1, 7, 64)}
    assert len(seen) == 1


def test_sample_moments_match_pandas():
    s = pd.Series([1.0, 2.0, 2.5, 9.0, 12.0, -3.0])
    n, m = len(s), s - s.mean()
    g1 = (m**3).mean() / (m**2).mean() ** 1.5
    g2 = (m**4).mean() / (m**2).mean() ** 2 - 3
    assert stats.sample_skewness(n, g1, s.std()) == pytest.approx(s.skew())
    assert stats.sample_kurtosis(n, g2, s.std()) == pytest.approx(s.kurtosis())
    assert stats.sample_skewness(2, 0.0, 1.0) is None and stats.sample_skewness(5, None, 0.0) == 0.0


def test_column_lists(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert parse_columns(" a , ,b") == ["a", "b"] and parse_columns(None) == []
    assert resolve_columns(df, "a,z") == ["a"] and resolve_columns(df, "z", "warn") == []
    with pytest.raises(ValueError, match="do not exist"):
        resolve_columns(df, "z", "error")
    with pytest.raises(ValueError, match="only by case"):
        require_distinct_names(spark.createDataFrame([(1, 2)], "a int, A int"))


def spearman_case(seed, rows):
    r = np.random.default_rng(seed)
    frame = pd.DataFrame({"hot": np.where(r.random(rows) < 0.4, 7.0, r.normal(size=rows)), "few": r.integers(0, 5, rows).astype(float)})
    frame["wide"] = frame.hot * 2 + r.normal(size=rows)
    frame["same"] = np.where(r.random(rows) < 0.3, np.nan, r.normal(size=rows))
    frame["twin"] = np.where(frame.same.isna(), np.nan, frame.same.round(1) + frame.few)
    frame["gap"] = np.where(r.random(rows) < 0.5, np.nan, -frame.wide + r.normal(size=rows) * 3)
    frame["flat"] = 1.5
    return frame


@pytest.mark.parametrize("per_band, tabled", [(None, None), (10, 0), (10, 40), (200, 0)])
def test_rank_correlations_match_pandas(spark, per_band, tabled):
    frame = spearman_case(3, 1200)
    df = spark.createDataFrame(frame).repartition(5)
    values = {n: F.when(~F.isnan(n), F.col(n)) for n in frame}
    facts = {n: {"rows": len(frame), "count": int(frame[n].notna().sum()), "distinct": frame[n].nunique()} for n in frame}
    pairs = list(combinations(frame, 2))
    found = rank_correlations(df, values, pairs, facts, per_band, tabled)
    expected = frame.corr("spearman")
    for a, b in pairs:
        if "flat" in (a, b):
            assert found[a, b] is None
        else:
            assert found[a, b] == pytest.approx(expected.loc[a, b], abs=1e-12)


def test_rank_correlations_move_rows_twice(spark):
    """Two exchanges of cells for all columns together, and a value that fills a third of its column is not sorted."""
    frame = spearman_case(4, 3000)[["hot", "wide"]]
    df = spark.createDataFrame(frame)
    plan = _Plan([Ranked(0, -1), Ranked(1, -1)], 2, _points(plain_columns(df, {n: F.col(n) for n in frame}), 3000, [9999] * 2, 100, 0))
    work = plain_columns(df, {n: F.col(n) for n in frame})
    plan.settle(_count_bands(work, plan))
    lines = _products_by_exchange(work, plan, _Blocks([(0, 1)], [-1, -1], plan.ranked))
    told = lines._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange hashpartitioning") == 2
    at = int(np.searchsorted(plan.points[0], 7.0))
    assert plan.points[0][at] == 7.0 and not np.isnan(plan.known[0][2 * at + 1])


def test_rank_tasks_grow_with_the_rows(spark):
    """However few partitions a shuffle has and however they are merged, a task ranks a bounded number of rows."""
    frame = spearman_case(5, 3000)[["hot", "wide"]]
    work = plain_columns(spark.createDataFrame(frame), {n: F.col(n) for n in frame})
    plan = _Plan([Ranked(0, -1), Ranked(1, -1)], 2, _points(work, 3000, [9999] * 2, 100, 0))
    plan.settle(_count_bands(work, plan))
    lines = _products_by_exchange(work, plan, _Blocks([(0, 1)], [-1, -1], plan.ranked), 3000, 100)
    told = lines._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", told) == [str(1 + 3000 * len(plan.open) // 100)] * 2


def test_rank_correlations_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    facts = {"a": {"rows": 1, "count": 0, "distinct": 0}, "b": {"rows": 1, "count": 1, "distinct": 1}}
    assert rank_correlations(df, {"a": F.col("a"), "b": F.col("b")}, [("a", "b")], facts) == {("a", "b"): None}


def test_only_small_tables_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    large, small = spark.range(cores * (8 << 20)), spark.range(1000)
    assert spread(large) is large
    assert "Repartition" in spread(small)._jdf.queryExecution().optimizedPlan().toString()


def test_moments_are_worked_out_in_narrow_jobs(spark):
    """Wide aggregates of moments run uncompiled; each job takes a few columns, with the same results."""
    df = spark.range(100).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(7)])
    values = {c: F.col(c) for c in df.columns}
    asked = []

    class Told:
        def agg(self, *exprs):
            asked.append(len(exprs))
            return df.agg(*exprs)

    found = column_stats(Told(), values, shape_moments())
    assert max(asked) <= MEASURES_PER_JOB < len(values) * len(shape_moments())
    assert [found[c]["mean"] for c in df.columns] == [49.5 * (i + 1) for i in range(7)]


def test_sketches_stay_within_their_errors(spark):
    df = spark.range(60_000, numPartitions=6).selectExpr("id", "CAST(id % 7000 AS STRING) AS s", "sqrt(id) AS v", "CAST(NULL AS DOUBLE) AS none")
    exact = {"id": 60_000, "s": 7000, "v": 60_000, "none": 0}
    whole = dict(sketches.distinct_counts(sketches.distinct_sketches(df)).collect())
    assert all(abs(whole[c] - n) <= sketches.DISTINCT_ERROR * n for c, n in exact.items())
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = sketches.approx_quantiles(df, {"v": F.col("v"), "none": F.col("none")}, probs)
    assert found["none"] == [None] * 5
    for p, q in zip(probs, found["v"], strict=True):
        assert abs(q * q / 59_999 - p) <= sketches.QUANTILE_ERROR


def test_sketches_of_parts_merge(spark):
    low, high = spark.range(0, 30_000).selectExpr("id AS a"), spark.range(20_000, 50_000).selectExpr("id AS a")
    both = sketches.distinct_sketches(low).unionAll(sketches.distinct_sketches(high))
    assert abs(dict(sketches.distinct_counts(sketches.merged(both, "distinct")).collect())["a"] - 50_000) <= sketches.DISTINCT_ERROR * 50_000
    values = {"a": F.col("a").cast("double")}
    both = sketches.quantile_sketches(low, values).unionAll(sketches.quantile_sketches(high, values))
    (median,) = sketches.sketched_quantiles(sketches.merged(both, "quantile"), [0.5]).first()["quantiles"]
    assert abs(median - 25_000) <= 2 * sketches.QUANTILE_ERROR * 60_000 + 1
    with pytest.raises(ValueError, match="unknown kind"):
        sketches.merged(both, "mode")


def test_equal_values_hash_alike(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "v double")
    hashes = [r[0] for r in df.select(sketches.hashed(df, "v")).collect()]
    assert hashes[0] == hashes[1] and hashes[2:] == [None, None]


def test_approx_top_values_match_exact_ones(spark):
    df = spark.createDataFrame([(f"v{min(i % 40, 25)}", None if i % 3 else "x") for i in range(4000)], "a string, b string")
    found = {(r[0], r[1]): r[2] for r in sketches.approx_top_values(df, ["a", "b"], 5).collect()}
    exact = {("a", r[0]): r[1] for r in df.groupBy("a").count().collect()} | {("b", "x"): 1334}
    assert found == exact
