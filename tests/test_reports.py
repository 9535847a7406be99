from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.columns import measured
from tablewright.operators.correlation import correlation, pearson_pairs
from tablewright.operators.distribution import distribution
from tablewright.operators.missing import missing_values
from tablewright.operators.outliers import outliers
from tablewright.operators.schema import cast_by_profile, profile, smallest_values, unique_counts
from tablewright.operators.suggest import Suggestions, correlation_section


def pair_map(report):
    return {(r["method"], r["a"], r["b"]): r["r"] for r in report.pairs.collect()}


def test_correlation_exact_and_monotone(spark):
    exact = spark.createDataFrame([(i, 2 * i) for i in range(1, 6)], "a int, b int")
    assert pair_map(correlation(exact)) == {("pearson", "a", "b"): 1.0}
    bent = spark.createDataFrame([(i, i * i) for i in range(1, 6)], "x int, y int")
    found = pair_map(correlation(bent, "both"))
    assert found["spearman", "x", "y"] == 1.0 and found["pearson", "x", "y"] < 1


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i % 3)) for i in range(20)], "a double, flat double, c double")
    found = pair_map(correlation(df, "both"))
    assert found["pearson", "a", "flat"] is None and found["spearman", "a", "flat"] is None


def test_correlation_skips_nan_and_null_pairwise(spark):
    r = np.random.default_rng(0)
    frame = pd.DataFrame(r.normal(size=(60, 3)), columns=list("abc"))
    frame.loc[::5, "a"] = np.nan
    frame.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(frame)
    df = df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    for method in ("pearson", "spearman"):
        expected = frame.corr(method)
        for (_, a, b), value in pair_map(correlation(df, method)).items():
            assert value == pytest.approx(expected.loc[a, b], abs=1e-6)


def test_too_few_numeric_columns(spark):
    report = correlation(spark.createDataFrame([(1, "x")], "a int, s string"))
    assert report.pairs.count() == 0
    assert [r["type"] for r in report.flags().collect()] == ["insufficient_columns"]


def test_correlation_rejects_unknown_method(spark):
    with pytest.raises(ValueError, match="unknown method"):
        correlation(spark.range(3), "kendall")


def test_target_ranking_order(spark):
    df = spark.createDataFrame([(i, 6 - i, i * i) for i in range(1, 6)], "a int, b int, target int")
    ranked = [r["feature"] for r in correlation(df, target="target").target_ranking().collect()]
    assert ranked == ["a", "b"]


def test_distribution_matches_pandas(spark):
    r = np.random.default_rng(7)
    frame = pd.DataFrame({"v": r.exponential(size=400)})
    row = distribution(spark.createDataFrame(frame)).numeric().first()
    s = frame.v
    assert row["skewness"] == pytest.approx(s.skew(), abs=1e-4)
    assert row["kurtosis"] == pytest.approx(s.kurtosis(), abs=1e-4)
    assert row["std"] == pytest.approx(s.std(), abs=1e-4) and row["skew_flag"].endswith("right")
    counts, edges = np.histogram(s, bins=10)
    bins = distribution(spark.createDataFrame(frame)).histogram().orderBy("bin").collect()
    assert [b["count"] for b in bins] == list(counts)
    assert [b["lo"] for b in bins] == pytest.approx(list(edges[:-1]), abs=1e-4)


@pytest.mark.parametrize("values", [[2.0], [None, None], [4.0] * 5, [float("nan"), None, 1.0, 2.0]])
def test_distribution_edges(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int")
    row = distribution(df, columns="v").numeric().first()
    kept = [v for v in values if v is not None and v == v]
    assert row["count"] == len(kept)
    bins = distribution(df, columns="v").histogram().collect()
    assert len(bins) == 10 and sum(b["count"] for b in bins) == len(kept)
    if not kept:
        assert (min(b["lo"] for b in bins), max(b["hi"] for b in bins)) == (0.0, 1.0)
    if len(set(kept)) == 1:
        assert (min(b["lo"] for b in bins), max(b["hi"] for b in bins)) == (kept[0] - 0.5, kept[0] + 0.5)


def test_target_sections(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 90 else "b") for i in range(100)], "v double, y string")
    report = distribution(df, target="y")
    assert report.target_is_classes()
    assert report.target_imbalance().first()["imbalanced"]
    assert {r["type"] for r in report.flags().collect()} == {"class_imbalance"}
    assert not distribution(df, target="v").target_is_classes()


def test_missing_fixture(spark):
    rows = [(i, None if i < 1 else 1.0, None if i < 10 else 1.0, None if i < 50 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "complete int, low double, medium double, high double")
    report = missing_values(df)
    assert {r["column_name"]: r["severity"] for r in report.columns().collect()} == {"high": "high", "medium": "medium", "low": "low"}
    summary = report.summary().first()
    assert (summary["total_missing_cells"], summary["total_cells"], summary["no_missing_count"]) == (61, 400, 1)
    assert missing_values(df.limit(0)).summary().first()["overall_missing_pct"] == 0.0


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert missing_values(df).columns().first()["missing_count"] == 2


def test_outlier_fixture(spark):
    df = spark.createDataFrame([(i,) for i in [*range(1, 101), 500, 600, 700]], "value int")
    row = outliers(df, "iqr").columns().first()
    assert row["outlier_count"] == 3 and row["high_outlier_rate"] and row["extreme_outlier"]
    assert [r["value"] for r in outliers(df).extremes().orderBy("rank").collect()] == [700.0, 600.0, 500.0]
    z = spark.createDataFrame([(i,) for i in [*range(1, 101), 1000]], "value int")
    assert outliers(z, "zscore").columns().first()["outlier_count"] == 1


@pytest.mark.parametrize("values", [[1.0], [5.0] * 4, [None, None]])
def test_outlier_edges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for method in ("iqr", "zscore", "both"):
        found = outliers(df, method).columns().collect()
        assert [r["outlier_count"] for r in found] in ([], [0])


def test_profile_rules(spark):
    n = 60
    df = spark.createDataFrame(
        [(i, i % 2, f"n{i}", "xy"[i % 2], i * 1.5, i % 3, b"k", [i], "2024-01-01", i % 2 == 0) for i in range(n)],
        "user_id int, churn int, name string, kind string, amount double, grade int, raw binary, tags array<int>, "
        "lifetime string, humidity boolean",
    )
    found = {r["column_name"]: (r["semantic_type"], r["role"]) for r in profile(df).collect()}
    assert found == {
        "user_id": ("identifier", "identifier"),
        "churn": ("binary", "target"),
        "name": ("identifier", "identifier"),
        "kind": ("binary", "feature"),
        "amount": ("continuous", "feature"),
        "grade": ("categorical", "feature"),
        "raw": ("unknown", "ignore"),
        "tags": ("unknown", "ignore"),
        "lifetime": ("datetime", "metadata"),
        "humidity": ("binary", "feature"),
    }


def test_profile_of_nothing(spark):
    row = profile(spark.createDataFrame([], "v double")).first()
    assert row["unique_count"] == 0 and row["unique_ratio"] == 0.0 and row["samples"] == []


def test_cast_parses_like_a_number_reader(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "1d", "0x10", "n/a"] + ["7"] * 43
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marked = profile(df).withColumn("semantic_type", F.lit("continuous"))
    out, status = cast_by_profile(df, marked)
    line = status.first()
    assert (line["status"], line["success_rate"]) == ("cast", 0.94)
    assert [r["t"] for r in out.limit(7).collect()] == [1.0, 2.5, -300.0, 0.5, None, None, None]


def test_suggestions_without_reports(spark):
    df = spark.createDataFrame([(i * 1.1, i * 2.0) for i in range(50)], "a double, b double")
    found = Suggestions(profile(df), correlation_section(correlation(df, target="b")))
    assert [r["reason"] for r in found.log_columns().collect()] == ["fallback", "fallback"]
    assert found.interaction_pairs().first()["r"] == 1.0
    assert found.selector().count() == 1


def test_correlation_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr("tablewright.operators.correlation.GRAM_COLUMNS", 3)
    r = np.random.default_rng(5)
    frame = pd.DataFrame(r.normal(size=(200, 5)), columns=list("abcde"))
    frame["e"] = frame.a * 2 - frame.b
    frame["flat"] = 1.5
    expected = frame.corr()
    for (_, a, b), value in pair_map(correlation(spark.createDataFrame(frame))).items():
        if "flat" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-6)


def test_correlation_of_many_columns_with_gaps(spark):
    """200 columns, each with gaps of its own or one of a few shared patterns, in a fixed number of jobs."""
    r = np.random.default_rng(8)
    base = r.normal(size=(400, 12))
    values = base @ r.normal(size=(12, 200)) + r.normal(size=(400, 200))
    frame = pd.DataFrame(values, columns=[f"c{i}" for i in range(200)])
    for i in range(200):
        if i % 4:
            frame.loc[r.random(400) < 0.2 if i % 4 == 1 else np.arange(400) % (2 + i % 4) == 0, f"c{i}"] = np.nan
    df = spark.createDataFrame(frame).repartition(4)
    values = {n: measured(df, n) for n in frame}
    facts = {n: {"rows": 400, "count": int(c.count()), "mean": float(c.mean()), "min": float(c.min()), "max": float(c.max())} for n, c in frame.items()}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gaps", "gaps")
    found = pearson_pairs(df, values, list(combinations(frame, 2)), facts)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("gaps")) <= 8 and len(found) == 19_900
    expected = frame.corr()
    assert max(abs(v - expected.loc[a, b]) for (a, b), v in found.items()) < 1e-9


def test_pairs_that_share_a_constant(spark):
    """Constant only where the other column has values; nearly constant there; nothing shared."""
    rows = [(1e6, 1.0, None), (1e6, 2.0, None), (1e6, 3.5, None), (-5.0, None, 1.0), (7.0, None, 3.0), (0.1, None, 9.0)]
    near = [(x, y, z, (1e6 + i * 1e-4) if i < 3 else float(i)) for i, (x, y, z) in enumerate(rows)]
    found = pair_map(correlation(spark.createDataFrame(near, "a double, b double, c double, d double"), "both"))
    assert found["pearson", "a", "b"] is None and found["spearman", "a", "b"] is None
    assert found["pearson", "b", "c"] is None and found["spearman", "b", "c"] is None
    assert found["pearson", "b", "d"] == pytest.approx(np.corrcoef([1, 2, 3.5], [0, 1, 2])[0, 1], abs=1e-5)


def test_infinite_values_have_no_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (float("inf"), 3.0, 2.0), (2.0, None, 4.0), (3.0, 1.0, 7.0)], "a double, b double, c double")
    found = pair_map(correlation(df, "both"))
    assert found["pearson", "a", "b"] is None
    assert found["pearson", "b", "c"] == pytest.approx(np.corrcoef([2, 3, 1], [1, 2, 7])[0, 1], abs=1e-6)
    assert found["spearman", "a", "c"] == pytest.approx(0.4)


def profile_case(spark):
    rows = [(i, float(i % 9) if i % 4 else float("nan"), ("x" * 2000 + str(i % 300)), i % 2 == 0, f"{(i * 7) % 50 - 20}.5") for i in range(900)]
    df = spark.createDataFrame(rows, "key long, real double, body string, flag boolean, price string").repartition(5)
    return df.withColumn("price", F.col("price").cast("decimal(9,1)"))


def test_profile_counts_and_smallest_values(spark):
    df = profile_case(spark)
    found = {r["column_name"]: r for r in profile(df).collect()}
    assert {c: r["unique_count"] for c, r in found.items()} == {"key": 900, "real": 9, "body": 300, "flag": 2, "price": 50}
    assert list(found["key"]["samples"]) == ["0", "1", "2", "3", "4"] and found["key"]["all_values"] is None
    assert list(found["real"]["all_values"]) == [str(float(i)) for i in range(9)]
    assert list(found["body"]["samples"]) == sorted("x" * 2000 + str(i) for i in range(300))[:5]
    assert list(found["price"]["samples"]) == [f"{i}.5" for i in (-20, -19, -18, -17, -16)]
    assert list(found["flag"]["all_values"]) == ["false", "true"]


def test_profile_shuffles_hashes_not_texts(spark):
    df = profile_case(spark)
    told = unique_counts(df)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in told.splitlines() if "Exchange hashpartitioning" in line]
    assert sent and all("body" not in line and "text" not in line for line in sent)
    assert smallest_values(df, 4).count() == 4 * 4 + 2


def test_profile_by_sketches(spark):
    df = profile_case(spark)
    found = {r["column_name"]: r for r in profile(df, approx=True).collect()}
    exact = {r["column_name"]: r for r in profile(df).collect()}
    for name, r in exact.items():
        assert abs(found[name]["unique_count"] - r["unique_count"]) <= 0.03 * r["unique_count"]
        assert found[name]["samples"] == r["samples"] and found[name]["all_values"] == r["all_values"]
        assert r["unique_count"] > 20 or found[name]["unique_count"] == r["unique_count"]


def test_distribution_by_sketches(spark):
    df = profile_case(spark)
    exact, found = distribution(df), distribution(df, approx=True)
    for a, b in zip(exact.categorical().orderBy("column_name").collect(), found.categorical().orderBy("column_name").collect(), strict=True):
        assert a["count"] == b["count"] and abs(a["cardinality"] - b["cardinality"]) <= 0.03 * a["cardinality"]
    assert found.top_values().exceptAll(exact.top_values()).count() == 0
    assert found.numeric().select("column_name", "count", "mean").exceptAll(exact.numeric().select("column_name", "count", "mean")).count() == 0


def test_unique_counts_of_numbers_take_one_hash(spark):
    """Spark's hash of eight bytes is one to one: numbers are sent as one hash, all else as two."""
    df = spark.createDataFrame(
        [(1, 0.0, "a", 7), (2, -0.0, "b", 7), (2, float("nan"), None, None), (None, 1.5, "b", 8)], "a long, b double, c string, d int"
    )
    counted = unique_counts(df)
    assert dict(counted.collect()) == {"a": 2, "b": 2, "c": 2, "d": 2}
    assert dict(unique_counts(df.select("a", "b")).collect()) == {"a": 2, "b": 2}
    told = unique_counts(df.select("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS g#" not in told and "g:bigint" not in told
    told = unique_counts(df.select("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(1, " in told


def test_outliers_take_over_a_known_distribution(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 17), i * i, None) for i in range(200)], "a double, b long, empty double").persist()
    alone = outliers(df).columns().collect()
    shape = distribution(df)
    shape.numeric()

    def again(*_):
        raise AssertionError("worked out again")

    monkeypatch.setattr("tablewright.operators.outliers.quantiles", again)
    monkeypatch.setattr("tablewright.operators.outliers.column_stats", again)
    monkeypatch.setattr("tablewright.operators.distribution.quantiles", again)
    assert outliers(df, known=shape).columns().collect() == alone
    with pytest.raises(ValueError, match="known distribution"):
        outliers(df.select("a"), known=shape)
