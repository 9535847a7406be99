import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators.dates import DatetimeEncoder
from tablewright.operators.drop import ColumnDropper
from tablewright.operators.encode import Encoder, _dictionary
from tablewright.operators.impute import Imputer
from tablewright.operators.interact import Interactions, parse_pairs
from tablewright.operators.logs import LogTransform, yeo_johnson
from tablewright.operators.scale import Scaler
from tablewright.operators.select import FeatureSelector, mutual_information
from tablewright.splits import Splits


def values(df, name):
    return [r[0] for r in df.select(f"`{name}`").collect()]


# --- drop ---


def test_drop_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    assert ColumnDropper("a,y", target="y").fit(df).transform(df).columns == ["b", "y"]
    for columns, message in (("", "at least one"), ("zz", "do not exist"), ("y", "nothing is left")):
        with pytest.raises(ValueError, match=message):
            ColumnDropper(columns, target="y").fit(df)


# --- impute ---


def impute_parts(spark):
    schema = "age double, years int, city string, gone double, y int"
    train = spark.createDataFrame([(1.0, 1, "b", None, 1), (None, None, "a", None, None), (4.0, 4, None, None, 0), (4.0, 2, "a", None, 1)], schema)
    val = spark.createDataFrame([(None, None, None, None, None), (float("nan"), 9, "z", 1.0, 1)], schema)
    return Splits(train, val, train.limit(0))


def test_impute_uses_train_only(spark):
    parts = impute_parts(spark)
    out = Imputer("mean", target="y").fit(parts.train).apply(parts)
    assert values(out.val, "age")[0] == 3.0 and math.isnan(values(out.val, "age")[1])
    assert values(out.val, "years") == [7 / 3, 9.0]
    assert values(out.val, "city") == [None, "z"] and values(out.val, "gone") == [None, 1.0]
    assert values(out.val, "y") == [None, 1]
    assert out.test.columns == parts.test.columns and out.test.count() == 0


def test_impute_median_mode_constant(spark):
    parts = impute_parts(spark)
    assert values(Imputer("median").fit(parts.train).transform(parts.val), "years")[0] == 2.0
    mode = Imputer("mode").fit(parts.train).transform(parts.val)
    assert (values(mode, "age")[0], values(mode, "city")[0]) == (4.0, "a")
    fixed = Imputer("constant", constant="0").fit(parts.train).transform(parts.val)
    assert (values(fixed, "age")[0], values(fixed, "city")[0]) == (0.0, "0")
    text = Imputer("constant", constant="none", columns="years").fit(parts.train).transform(parts.val)
    assert values(text, "years") == ["none", "9"]
    with pytest.raises(ValueError, match="needs a constant"):
        Imputer("constant").fit(parts.train)


def test_mode_of_many_values(spark, monkeypatch):
    monkeypatch.setattr("tablewright.operators.impute.MODE_VALUES", 5)
    df = spark.createDataFrame([(str(i),) for i in range(40)] + [("b",), ("b",), ("a",), ("a",), (None,)], "s string")
    assert "a" in values(Imputer("mode").fit(df).transform(df.where("s is null")), "s")


# --- encode ---


def encode_parts(spark):
    schema = "color string, size string, price double, y string"
    train = spark.createDataFrame([(c, s, 1.0, "t") for c, s in [("red", "S"), ("blue", "M"), ("green", "L"), (None, "S")]], schema)
    val = spark.createDataFrame([("purple", "M", 2.0, "t"), ("red", None, 2.0, "u")], schema)
    return Splits(train, val)


@pytest.mark.parametrize("limit", [1000, 0])
def test_label_codes(spark, limit):
    parts = encode_parts(spark)
    out = Encoder("label", target="y", literal_categories=limit).fit(parts.train).apply(parts)
    assert sorted(values(out.train, "color")) == [-1, 0, 1, 2]
    found = {r["price"]: r for r in out.val.where("y = 't'").collect()}
    assert (found[2.0]["color"], found[2.0]["size"]) == (-1, 1)
    assert out.val.where("y = 'u'").first()["size"] == -1
    assert dict(out.train.dtypes)["color"] == "bigint" and out.train.columns == parts.train.columns


@pytest.mark.parametrize("limit", [1000, 0])
def test_unseen_category_is_an_error(spark, limit):
    parts = encode_parts(spark)
    step = Encoder("label", "color", handle_unknown="error", literal_categories=limit).fit(parts.train)
    with pytest.raises(ValueError, match="'purple' of column 'color' in val"):
        step.apply(parts)


def test_one_hot(spark):
    parts = encode_parts(spark)
    out = Encoder("one_hot", "color").fit(parts.train).apply(parts)
    assert out.val.columns == ["size", "price", "y", "color_blue", "color_green", "color_red"]
    assert [tuple(r)[3:] for r in out.val.collect()] == [(0, 0, 0), (0, 0, 1)]
    assert (None, None, None) in [tuple(r)[3:] for r in out.train.collect()]


def test_one_hot_of_many_categories(spark):
    parts = encode_parts(spark)
    out = Encoder("one_hot", "color", output="vector").fit(parts.train).transform(parts.val)
    assert [r["color_onehot"].toArray().tolist() for r in out.orderBy("size").collect()] == [[0, 0, 1], [0, 0, 0]]


def test_output_of_one_hot_does_not_switch(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(60)], "k string")
    with pytest.raises(ValueError, match="output='vector'"):
        Encoder("one_hot", "k", literal_categories=59).fit(df)
    assert len(Encoder("one_hot", "k", literal_categories=60).fit(df).transform(df).columns) == 60
    assert Encoder("one_hot", "k", output="vector").fit(df).transform(df).columns == ["k_onehot"]


@pytest.mark.parametrize("size", [40, 300])
def test_codes_by_literal_and_by_join(spark, size):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(size)] + [(None,)], "k string")
    step = Encoder("label", "k").fit(df)
    found = step.transform(spark.createDataFrame([("k007",), ("new",), (None,)], "k string")).collect()
    assert sorted(r["k"] for r in found) == [-1, -1, 7]


def test_large_dictionary_is_fitted_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("b",), ("c",)], "k string").write.parquet(path)
    step = Encoder("label", "k", literal_categories=0).fit(spark.read.parquet(path))
    spark.createDataFrame([("a",), ("b",), ("c",)], "k string").write.mode("overwrite").parquet(path)
    assert sorted(r["k"] for r in step.transform(spark.createDataFrame([("b",), ("a",)], "k string")).collect()) == [-1, 0]


@pytest.mark.parametrize("direct", [0, 50_000])
def test_nan_has_no_rank(spark, monkeypatch, direct):
    monkeypatch.setattr("tablewright.functions.stats.DIRECT_QUANTILE_ROWS", direct)
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(float("nan"),)] * 3 + [(None,)], "x double")
    filled = Imputer("median", columns="x").fit(df)
    assert filled.rows[0][2] == "5.0"
    name, _, shift, spread = Scaler("RobustScaler", "x").fit(df).rows[0]
    assert (name, shift, spread) == ("x", 5.0, 4.0)


def test_dictionary_in_buckets(spark):
    df = spark.createDataFrame([(f"k{i % 900:04d}",) for i in range(3000)], "k string")
    found = {r["value"]: r["code"] for r in _dictionary(df, "k", 900, per_bucket=50).collect()}
    assert found == {f"k{i:04d}": i for i in range(900)}


def test_nothing_to_encode(spark):
    df = spark.createDataFrame([(1, None)], "a int, s string")
    assert Encoder().fit(df).transform(df).collect() == df.collect()


# --- scale ---


def test_scaled_train_has_mean_0_and_std_1(spark):
    df = spark.createDataFrame([(float(i), 10 * i, 5.0, "x", i % 2) for i in range(80)], "a double, b int, flat double, s string, y int")
    step = Scaler(target="y").fit(df)
    out = step.transform(df)
    for c in ("a", "b"):
        m, s = out.agg(F.avg(c), F.stddev_samp(c)).first()
        assert (m, s) == (pytest.approx(0, abs=1e-12), pytest.approx(1))
    assert values(out, "flat")[0] == 5.0 and values(out, "y") == values(df, "y")
    shifted = step.transform(df.withColumn("a", F.col("a") + 100))
    assert shifted.agg(F.avg("a")).first()[0] > 3


def test_min_max_is_not_clipped_and_nulls_stay(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (None,)], "a double")
    step = Scaler("MinMaxScaler").fit(df)
    assert values(step.transform(spark.createDataFrame([(20.0,), (None,)], "a double")), "a") == [2.0, None]
    robust = Scaler("RobustScaler").fit(df).transform(df)
    assert values(robust, "a") == [-1.0, 1.0, None]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "p"), (3.0, 6.0, "q"), (5.0, 7.0, "p")], "`a.b` double, `c d` double, `e``f` string")
    out = Scaler().fit(df).transform(df)
    out = Encoder().fit(df).transform(out)
    out = Interactions([("a.b", "c d")], "add").fit(df).transform(out)
    assert out.columns == ["a.b", "c d", "e`f", "a.b_plus_c d"] and values(out, "a.b") == [-1.0, 0.0, 1.0]


# --- logs ---


def test_log_values_at_the_edges(spark):
    df = spark.createDataFrame([(-0.5,), (-1.0,), (-2.0,), (10.0,), (None,)], "v double")
    out = values(LogTransform("log1p").fit(df).transform(df), "v")
    assert out[0] == pytest.approx(math.log(0.5)) and out[1] == -math.inf and math.isnan(out[2])
    assert out[3] == pytest.approx(math.log(11)) and out[4] is None
    signed = values(LogTransform().fit(df).transform(df), "v")
    assert signed[2] == pytest.approx(-math.log(3))


def test_log_column_rules(spark):
    df = spark.createDataFrame([(1.0, "x", 2)], "a double, s string, y int")
    assert values(LogTransform(columns="a,s").fit(df).transform(df), "s") == ["x"]
    for kw, message in ((dict(columns="zz"), "do not exist"), (dict(columns="s"), "no numeric column"), (dict(method="ln"), "unknown method")):
        with pytest.raises(ValueError, match=message):
            LogTransform(**kw).fit(df)


@pytest.mark.parametrize("seed, make", [(1, "exponential"), (2, "normal"), (3, "lognormal")])
def test_yeo_johnson_exponent_is_the_likelihood_peak(spark, seed, make):
    x = getattr(np.random.default_rng(seed), make)(size=300)

    def fit(lam):
        with np.errstate(all="ignore"):
            up = np.log1p(np.abs(x)) if abs(lam) < 1e-12 else ((np.abs(x) + 1) ** lam - 1) / lam
            low = -np.log1p(np.abs(x)) if abs(lam - 2) < 1e-12 else -((1 + np.abs(x)) ** (2 - lam) - 1) / (2 - lam)
        t = np.where(x >= 0, up, low)
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    lam = LogTransform("yeo_johnson").fit(df).info(spark).first()["exponent"]
    near = np.arange(lam - 0.01, lam + 0.01, 1e-4)
    assert abs(max(near, key=fit) - lam) < 2e-4
    assert fit(lam) >= max(fit(g) for g in np.arange(-3, 4, 0.05)) - 1e-6


def test_yeo_johnson_leaves_a_constant_alone(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert values(LogTransform("yeo_johnson").fit(df).transform(df), "v") == [3.0] * 5
    assert df.select(yeo_johnson(F.lit(None).cast("double"), 0.5)).first()[0] is None


# --- interactions and dates ---


def test_interactions(spark):
    df = spark.createDataFrame([(10.0, 2.0), (0.0, 0.0), (1.0, 0.0)], "a double, b double")
    assert values(Interactions("a:b").fit(df).transform(df), "a_x_b") == [20.0, 0.0, 0.0]
    assert values(Interactions("a:b", "ratio").fit(df).transform(df), "a_div_b") == [5.0, None, None]
    for pairs, message in (("a", "not of the form"), ("a:z", "do not exist"), ("", "at least one"), (" , ", "at least one")):
        with pytest.raises(ValueError, match=message):
            Interactions(pairs).fit(df)
    with pytest.raises(ValueError, match="unknown operation"):
        Interactions("a:b", "power").fit(df)
    assert parse_pairs("a:b, c : d") == [("a", "b"), ("c", "d")]


def test_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2023-06-15 14:30:00' AS ts, '2024-01-01' AS updated, 1 AS y")
    out = DatetimeEncoder(components="year,month,day,weekday,hour,minute").fit(df).transform(df).first().asDict()
    assert out == {
        "y": 1, "ts_year": 2023, "ts_month": 6, "ts_day": 15, "ts_weekday": 4, "ts_hour": 14, "ts_minute": 30,
        "updated_year": 2024, "updated_month": 1, "updated_day": 1, "updated_weekday": 1, "updated_hour": 0, "updated_minute": 0,
    }
    kept = DatetimeEncoder("ts", "year", drop_original=False).fit(df).transform(df)
    assert kept.columns == ["ts", "updated", "y", "ts_year"]


def test_date_errors(spark):
    df = spark.createDataFrame([("soon", 1), (None, 2)], "created string, n int")
    for kw, message in ((dict(), "no timestamps"), (dict(column="n"), "not a date"), (dict(components="week"), "unknown components"), (dict(column="x"), "do not exist")):
        with pytest.raises(ValueError, match=message):
            DatetimeEncoder(**kw).fit(df)
    with pytest.raises(ValueError, match="no date or time"):
        DatetimeEncoder().fit(df.select("n"))


# --- selection ---


def candidates(spark):
    rows = [(float(i), 10.0 * i, 5.0, 1.001 if i == 3 else 1.0, "x", i % 2) for i in range(100)]
    return spark.createDataFrame(rows, "a double, b double, constant double, near double, s string, y int")


def test_selection_by_variance(spark):
    df = candidates(spark)
    assert FeatureSelector("variance_threshold", 0.01, "y").fit(df).transform(df).columns == ["a", "b", "s", "y"]
    with pytest.raises(ValueError, match="fall below"):
        FeatureSelector("variance_threshold", 1e9, "y").fit(df)


def test_selection_by_target(spark):
    df = candidates(spark).withColumn("y", F.col("a") * 2)
    assert FeatureSelector("correlation_with_target", 0.9, "y").fit(df).transform(df).columns == ["a", "b", "s", "y"]
    for method in ("correlation_with_target", "mutual_information"):
        with pytest.raises(ValueError, match="target column is required"):
            FeatureSelector(method).fit(df)


def test_mutual_information_brute_force(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=350), r.normal(size=350)
    y[:200] = x[:200] + 0.1 * y[:200]
    x[::9] = np.nan
    ok = np.isfinite(x)
    bins = min(20, max(2, int(np.sqrt(ok.sum()))))
    edges = lambda v: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    xb, yb = np.digitize(x[ok], edges(x[ok])), np.digitize(y[ok], edges(y[ok]))
    joint = pd.crosstab(xb, yb).to_numpy() / ok.sum()
    outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    expected = np.sum(joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0]))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    found = mutual_information(df, {"x": F.col("x")}, F.col("y")).first()["score"]
    assert found == pytest.approx(expected, rel=1e-9)


def test_nulls_are_spread_before_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr("tablewright.functions.keep.BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, None if i % 3 else f"v{i % 5}") for i in range(300)], "i int, s string")
    step = Encoder("label", literal_categories=0).fit(df)
    joined = step._joined_code(df, "s", "s")
    found = {(r["s"] is None, r["code"]) for r in df.join(joined.withColumnRenamed("s", "code"), "i").collect()}
    assert found == {(True, -1), *[(False, k) for k in range(5)]}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "(_key#" in plan
