import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tablewright.operators import training
from tablewright.operators.comparison import compare_models
from tablewright.operators.importance import feature_importance
from tablewright.operators.training import (
    TrainedModel,
    _first_trees,
    best_round,
    decision_tree,
    gradient_boosting,
    linear_regression,
    logistic_regression,
    random_forest,
    sample_counts,
    target_distribution,
    xgboost_style,
)
from tablewright.splits import Splits


@pytest.fixture(scope="module")
def line(spark):
    r = np.random.default_rng(42)
    frame = pd.DataFrame({"feature_a": r.normal(size=120), "feature_b": r.normal(size=120)})
    frame["target"] = 3 * frame.feature_a + 2 * frame.feature_b + 0.1 * r.normal(size=120)
    df = spark.createDataFrame(frame).withColumn("k", F.monotonically_increasing_id() % 3)
    return Splits(df.where("k > 0").drop("k").persist(), df.where("k = 0").drop("k").persist())


@pytest.fixture(scope="module")
def classes(spark):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({"feature_a": r.normal(size=240), "feature_b": r.normal(size=240)})
    frame["target"] = (frame.feature_a + frame.feature_b > 0).astype("int32")
    frame["name"] = np.select([frame.feature_a < -0.5, frame.feature_a < 0.5], ["low", "mid"], "top")
    return spark.createDataFrame(frame).persist()


def accuracy(model, df):
    return model.predict(df).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]


def test_linear_regression_recovers_weights(spark, line):
    model = linear_regression(line.train, "target")
    weights = {r["feature"]: r["weight"] for r in model.weights(spark).collect()}
    assert weights["feature_a"] == pytest.approx(3, abs=0.2) and weights["feature_b"] == pytest.approx(2, abs=0.2)
    assert model.predictions(line).val.columns == ["y_true", "y_pred"]
    plain = linear_regression(line.train, "target", fit_intercept=False)
    assert plain.intercept() is None


def test_normalized_weights_are_per_standard_deviation(spark, line):
    frame = line.train.toPandas()
    x = frame[["feature_a", "feature_b"]]
    z = (x - x.mean()) / x.std(ddof=0)
    expected = np.linalg.lstsq(np.c_[z, np.ones(len(z))], frame.target, rcond=None)[0][:2]
    found = {r["feature"]: r["weight"] for r in linear_regression(line.train, "target", normalize=True).weights(spark).collect()}
    assert [found["feature_a"], found["feature_b"]] == pytest.approx(list(expected), abs=1e-5)


def test_logistic_regression_solves_the_summed_loss(spark, classes):
    df = classes.drop("name")
    model = logistic_regression(df, "target", C=0.5)
    frame = df.toPandas()
    x = np.c_[frame[["feature_a", "feature_b"]].to_numpy(), np.ones(len(frame))]
    w = np.zeros(3)
    for _ in range(50):  # Newton steps on C * loss + |w|^2 / 2, intercept free
        p = 1 / (1 + np.exp(-x @ w))
        penal = np.array([1.0, 1.0, 0.0])
        grad = 0.5 * x.T @ (p - frame.target) + penal * w
        hess = 0.5 * (x * (p * (1 - p))[:, None]).T @ x + np.diag(penal)
        w -= np.linalg.solve(hess, grad)
    last = model.pipeline.stages[-1]
    assert list(last.coefficients) == pytest.approx(list(w[:2]), abs=1e-3)
    assert last.intercept == pytest.approx(w[2], abs=1e-3)
    with pytest.raises(ValueError, match="penalty"):
        logistic_regression(df, "target", penalty="elastic")
    with pytest.raises(ValueError, match="at least 2 classes"):
        logistic_regression(df.where("target = 1"), "target")


@pytest.mark.parametrize("train", [decision_tree, lambda d, t: random_forest(d, t, 10, 5), lambda d, t: gradient_boosting(d, t, n_estimators=5, max_depth=3), logistic_regression])
def test_two_classes(classes, train):
    df = classes.drop("name")
    model = train(df, "target")
    assert model.task == "classification" and model.classes == [0, 1]
    out = model.predict(df)
    assert out.columns == ["y_true", "y_pred", "y_prob_0", "y_prob_1"] and dict(out.dtypes)["y_pred"] == "int"
    assert accuracy(model, df) > 0.85


@pytest.mark.parametrize("train", [decision_tree, lambda d, t: random_forest(d, t, 10, 5), lambda d, t: gradient_boosting(d, t, n_estimators=4, max_depth=3), logistic_regression])
def test_text_classes(classes, train):
    df = classes.drop("target")
    model = train(df, "name")
    out = model.predict(df)
    assert out.columns == ["y_true", "y_pred", "y_prob_low", "y_prob_mid", "y_prob_top"]
    row = out.agg(F.min(F.col("y_prob_low") + F.col("y_prob_mid") + F.col("y_prob_top"))).first()[0]
    assert row == pytest.approx(1.0) and accuracy(model, df) > 0.85


def test_early_stopping_keeps_the_best_round(spark, line):
    model = xgboost_style(line.train, "target", line.val, n_estimators=30, learning_rate=0.5, max_depth=3, early_stopping_rounds=3)
    losses = [r["value"] for r in model.history(spark).where("split = 'val'").orderBy("round").collect()]
    assert model.best_rounds == [losses.index(min(losses))]
    assert model.pipeline.stages[-1].getNumTrees == model.best_rounds[0] + 1
    rmse = model.predict(line.val).agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2))).first()[0]
    assert rmse == pytest.approx(min(losses), rel=1e-6)
    with pytest.raises(ValueError, match="no counterpart"):
        gradient_boosting(line.train, "target", reg_alpha=0.1)


def test_shortened_boosters_are_those_of_fewer_rounds(spark, line, classes):
    """The first trees of an ensemble against a fit of as many rounds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    features = [c for c in line.train.columns if c != "target"]
    df = VectorAssembler(inputCols=features, outputCol="f").transform(line.train)
    df = df.withColumn("yes", (F.col("target") > df.agg(F.avg("target")).first()[0]).cast("double")).cache()
    number = lambda k: GBTRegressor(featuresCol="f", labelCol="target", maxIter=k, subsamplingRate=0.8, seed=1).fit(df)
    yes_no = lambda k: GBTClassifier(featuresCol="f", labelCol="yes", maxIter=k, subsamplingRate=0.8, seed=1).setProbabilityCol("p").fit(df)
    for fit, column in ((number, "prediction"), (yes_no, "p")):
        short, want = _first_trees(fit(6), 3), fit(3)
        assert short.getNumTrees == 3 and short.getFeaturesCol() == "f"
        got = [str(r[0]) for r in short.transform(df).select(column).collect()]
        assert got == [str(r[0]) for r in want.transform(df).select(column).collect()]
        assert short.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray()[: len(short.featureImportances)])
    df.unpersist()


def test_patience():
    assert best_round([5, 4, 3, 3.5, 3.6, 2], 2) == (2, True)
    assert best_round([5, 4, 3], 2) == (2, False)


def test_bad_training_tables(spark, classes):
    with pytest.raises(ValueError, match="target column is required"):
        decision_tree(classes, "")
    with pytest.raises(ValueError, match="does not exist"):
        random_forest(classes, "nope")
    with pytest.raises(ValueError, match="not numeric"):
        decision_tree(classes, "target")
    holes = spark.createDataFrame([(1.0, 1), (None, 0)], "a double, y int")
    with pytest.raises(ValueError, match="missing values"):
        decision_tree(holes, "y")
    with pytest.raises(ValueError, match="empty"):
        linear_regression(holes.limit(0), "y")


def test_tree_settings(line, caplog):
    model = decision_tree(line.train, "target", criterion="gini")
    assert model.task == "regression" and model.params["criterion"] == "squared_error"
    assert "using squared_error" in caplog.text
    with pytest.raises(ValueError, match="at most 30 deep"):
        decision_tree(line.train, "target", max_depth=31)
    with pytest.raises(ValueError, match="absolute_error"):
        decision_tree(line.train, "target", criterion="absolute_error")


def test_bins_tell_many_values_apart(spark):
    df = spark.createDataFrame([(float(i), int(i in (50, 51))) for i in range(120)], "x double, y int")
    tree = decision_tree(df, "y", max_depth=10)
    hits = tree.predict(df).where("y_true = y_pred").count()
    assert hits == 120 and decision_tree(df, "y", max_depth=10, max_bins=32).predict(df).where("y_true = y_pred").count() < 120


def test_importance(spark, line, classes):
    report = feature_importance(linear_regression(line.train, "target"))
    rows = report.features(spark).collect()
    assert [r["feature"] for r in rows] == ["feature_a", "feature_b"]
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert {r["type"] for r in report.flags(spark).collect()} == {"dominant_feature", "scaling"}
    top = feature_importance(decision_tree(classes.drop("name"), "target")).top(spark, 1).collect()
    assert [r["feature"] for r in top][1] == "other"


def test_reports_and_storage(spark, classes, tmp_path):
    df = classes.drop("target")
    model = gradient_boosting(df, "name", n_estimators=2, max_depth=2)
    model.save(spark, str(tmp_path / "m"))
    again = TrainedModel.load(spark, str(tmp_path / "m"))
    assert again.predict(df).collect() == model.predict(df).collect()
    assert again.info(spark).collect() == model.info(spark).collect()
    assert target_distribution(df, "name").count() == 3
    assert sample_counts(Splits(df, df.limit(3))).where("split = 'val'").first()["rows"] == 3


def test_model_comparison(classes):
    df = classes.drop("name")
    models = {"tree": decision_tree(df, "target", max_depth=2), "line": logistic_regression(df, "target")}
    table = compare_models(models, df, "target").table()
    assert table.where("metric = 'accuracy' and is_best").first()["model"] == "line"


def few_valued(spark, rows=6000, **more):
    r = np.random.default_rng(5)
    frame = pd.DataFrame({"a": r.integers(0, 12, rows) / 4.0, "b": r.integers(0, 5, rows)})
    score = 4 * frame.a + 2 * frame.b + r.integers(0, 3, rows)
    frame["target"] = np.select([score < 8, score < 14], ["low", "mid"], "top")
    for name, make in more.items():
        frame[name] = make(r, rows)
    return spark.createDataFrame(frame)


def test_boosting_on_counted_cells_is_that_on_rows(spark, monkeypatch):
    df = few_valued(spark).persist()
    on_rows = gradient_boosting(df, "target", n_estimators=3, max_depth=3, min_child_weight=20)
    monkeypatch.setattr(training, "DIRECT_ROWS", 0)
    ready = training._prepare(df, "target")
    with training._counted_cells(ready, 256) as cells:
        assert cells.cells <= 12 * 5 * 3
        assert cells.counted.agg(F.sum("_weight")).first()[0] == 6000
    on_cells = gradient_boosting(df, "target", n_estimators=3, max_depth=3, min_child_weight=20)
    assert on_cells.pipeline.stages[-1].getWeightCol() == "_weight"
    probs = [f"y_prob_{c}" for c in ("low", "mid", "top")]
    single = df.select("a", "b").distinct().orderBy("a", "b").withColumn("target", F.lit("low"))
    one, other = (m.predict(single).select(*probs).toPandas().to_numpy() for m in (on_rows, on_cells))
    assert np.allclose(one, other, atol=1e-9)


def test_cells_of_a_feature_with_many_values(spark, monkeypatch, tmp_path):
    """Cut at quantiles of all rows; the stored model cuts new rows the same way."""
    monkeypatch.setattr(training, "DIRECT_ROWS", 0)
    df = few_valued(spark, wide=lambda r, n: r.normal(size=n)).withColumn("target", (F.col("wide") > 0.25).cast("int")).drop("a").persist()
    model = gradient_boosting(df, "target", n_estimators=2, max_depth=3, max_bins=16)
    assert model.pipeline.stages[0].getInputCols() == ["wide"]
    out = model.predict(df)
    assert out.where("y_true = y_pred").count() > 0.96 * 6000
    model.save(spark, str(tmp_path / "m"))
    again = TrainedModel.load(spark, str(tmp_path / "m")).predict(df)
    assert again.exceptAll(out).count() == 0
    monkeypatch.setattr(training, "ROWS_PER_CELL", 1000)
    assert training._feature_cuts(training._prepare(df, "target"), 16) is None


def test_forest_on_counted_cells(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(training, "DIRECT_ROWS", 0)
    df = few_valued(spark).persist()
    ready = training._prepare(df, "target")
    with training._counted_cells(ready, 256) as cells:
        drawn = training._draws(cells, 200)
        sums = drawn.select(F.posexplode("draws")).groupBy("pos").agg(F.sum("col").alias("n")).toPandas()["n"]
        # every tree's bootstrap is of about as many rows as there are, with the spread of a Poisson number
        assert len(sums) == 200 and abs(sums.mean() - 6000) < 5 * (6000 / 200) ** 0.5
        assert 0.8 * 6000**0.5 < sums.std() < 1.2 * 6000**0.5
        assert drawn.exceptAll(training._draws(cells, 200)).count() == 0
    model = random_forest(df, "target", n_estimators=12, min_samples_split=40)
    forest = model.pipeline.stages[-1]
    assert forest.getNumTrees == 12 and forest.numClasses == 3 and forest.getWeightCol() == "_weight"
    assert len({t.toDebugString for t in forest.trees}) > 1
    on_rows = RandomForestClassifier(numTrees=12, maxDepth=10, seed=42, featuresCol="_features", labelCol="_label", maxBins=256)
    plain = ready.fit(on_rows).transform(ready.assembled(df)).where("prediction = _label").count()
    mine = model.predict(df).where("y_true = y_pred").count()
    assert abs(mine - plain) < 0.02 * 6000
    assert sum(model.raw_importances()[1]) == pytest.approx(1.0)
    model.save(spark, str(tmp_path / "forest"))
    assert TrainedModel.load(spark, str(tmp_path / "forest")).predict(df).exceptAll(model.predict(df)).count() == 0


def test_early_stopping_does_not_fit_short_steps_twice(spark, line, monkeypatch):
    fits = []
    monkeypatch.setattr(training, "best_round", lambda losses, patience: fits.append(len(losses)) or best_round(losses, patience))
    xgboost_style(line.train, "target", line.val, n_estimators=8, early_stopping_rounds=2, max_depth=2)
    assert fits == [8]


def test_logistic_regression_keeps_no_second_copy(classes, monkeypatch):
    def twice(_):
        raise AssertionError("kept besides MLlib's own copy")

    monkeypatch.setattr(training, "persisted", twice)
    model = logistic_regression(classes.drop("name"), "target")
    assert model.predict(classes).where("y_true = y_pred").count() > 220
