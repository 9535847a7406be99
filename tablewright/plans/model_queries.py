"""Trainers, importance, model comparison and the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.keep import persisted
from tablewright.functions.stats import settled
from tablewright.operators.comparison import compare_models
from tablewright.operators.dates import DatetimeEncoder
from tablewright.operators.encode import Encoder
from tablewright.operators.importance import feature_importance
from tablewright.operators.impute import Imputer
from tablewright.operators.scale import Scaler
from tablewright.operators.training import (
    TrainedModel,
    decision_tree,
    gradient_boosting,
    linear_regression,
    logistic_regression,
    random_forest,
    sample_counts,
    target_distribution,
    xgboost_style,
)
from tablewright.plans.flow import run
from tablewright.plans.inputs import LINE_KEY, part_sql, split_sql, split_table
from tablewright.plans.registry import query
from tablewright.session import scratch_dir
from tablewright.splits import Splits

#: A learnable yes/no target over line items.
YES_NO = [
    "l_quantity AS qty", "l_extendedprice AS price", "l_discount AS disc", "l_tax AS tax",
    "CAST(l_quantity + 100 * l_discount > 30 AS INT) AS y",
]
#: Three learnable classes, as text.
THREE = [
    "l_quantity AS qty", "l_discount AS disc", "l_tax AS tax",
    "CASE WHEN l_quantity + 100 * l_discount < 25 THEN 'low' WHEN l_quantity + 100 * l_discount < 37 THEN 'mid' ELSE 'top' END AS y",
]
#: A number that is nearly linear in two features.
NUMBER = [
    "l_quantity AS qty", "l_discount AS disc", "l_quantity * 3 + l_discount * 40 + l_extendedprice / 50000 AS y",
]


#: A class that one cut decides, and a number that few cuts give exactly: every part is predicted without an error.
STEP = ["l_quantity AS qty", "l_discount AS disc", "CAST(l_quantity > 25 AS INT) AS y"]
#: A class that takes several cuts on both features, and two leaves of the same class apart.
CUTS = [
    "l_quantity AS qty", "l_discount AS disc",
    "CASE WHEN l_quantity <= 10 THEN 'a' WHEN l_discount > 0.05 THEN 'b' WHEN l_quantity <= 30 THEN 'c' ELSE 'a' END AS y",
]
TWICE = ["l_quantity AS qty", "l_discount AS disc", "l_quantity * 2 AS y"]


def no_error_sql(exprs: list[str], scores: str) -> str:
    return f"SELECT split, count(*)::BIGINT AS rows, {scores} FROM {split_sql('lineitem', LINE_KEY, exprs)} GROUP BY split"


ALL_CUTS = no_error_sql(CUTS, "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS prob_sum")
ALL_RIGHT = no_error_sql(STEP, "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS prob_sum")
ONLY_QTY = """SELECT 1::BIGINT AS rank, 'qty' AS feature, 1.0::DOUBLE AS importance, 1.0::DOUBLE AS raw_importance
    UNION ALL SELECT 2, 'disc', 0.0, 0.0 WHERE EXISTS (SELECT 1 FROM lineitem)"""


def splits(spark, sf, exprs):
    return split_table(spark, sf, "lineitem", LINE_KEY, exprs)


def fitted_and_scored(spark, sf, exprs, train):
    """Train on the training part, then size and quality of the predictions of every part."""
    with persisted(splits(spark, sf, exprs).tagged()) as tagged:
        parts = Splits.of(tagged)
        return settled(scored(train(parts.train), parts))


def scored(model, parts):
    tagged = model.predictions(parts).tagged()
    if model.task == "regression":
        return tagged.groupBy("split").agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 4).alias("mae")
        )
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    probs = sum((F.col(c) for c in tagged.columns if c.startswith("y_prob_")), F.lit(0.0))
    return tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.round(hit, 4).alias("accuracy"), F.round(F.avg(probs), 6).alias("prob_sum")
    )


@query("decision_tree", ALL_RIGHT)
def _(spark, sf):
    return fitted_and_scored(spark, sf, STEP, lambda train: decision_tree(train, "y"))


@query("decision_tree_regression", no_error_sql(TWICE, "0.0::DOUBLE AS mae"))
def _(spark, sf):
    return fitted_and_scored(spark, sf, TWICE, lambda train: decision_tree(train, "y", criterion="squared_error"))


@query("decision_tree_cuts", ALL_CUTS)
def _(spark, sf):
    return fitted_and_scored(spark, sf, CUTS, lambda train: decision_tree(train, "y"))


@query("decision_tree_entropy", ALL_CUTS)
def _(spark, sf):
    return fitted_and_scored(spark, sf, CUTS, lambda train: decision_tree(train, "y", criterion="entropy"))


@query("decision_tree_criterion", no_error_sql(TWICE, "0.0::DOUBLE AS mae"))
def _(spark, sf):
    """A criterion for classes on a number is replaced."""
    return fitted_and_scored(spark, sf, TWICE, lambda train: decision_tree(train, "y", criterion="gini"))


@query("random_forest_cuts", ALL_CUTS)
def _(spark, sf):
    return fitted_and_scored(spark, sf, CUTS, lambda train: random_forest(train, "y"))


@query("random_forest", ALL_RIGHT)
def _(spark, sf):
    return fitted_and_scored(spark, sf, STEP, lambda train: random_forest(train, "y"))


@query("random_forest_classes", no_error_sql(THREE, "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS prob_sum"))
def _(spark, sf):
    return fitted_and_scored(spark, sf, THREE, lambda train: random_forest(train, "y"))


@query("logistic_regression")
def _(spark, sf):
    return fitted_and_scored(spark, sf, YES_NO, lambda train: logistic_regression(train, "y"))


@query("logistic_regression_classes")
def _(spark, sf):
    return fitted_and_scored(spark, sf, THREE, lambda train: logistic_regression(train, "y"))


@query("gradient_boosting")
def _(spark, sf):
    return fitted_and_scored(spark, sf, YES_NO, lambda train: gradient_boosting(train, "y", n_estimators=10, max_depth=4))


@query("gradient_boosting_defaults", ALL_RIGHT)
def _(spark, sf):
    """All rounds of the default settings."""
    return fitted_and_scored(spark, sf, STEP, lambda train: gradient_boosting(train, "y"))


@query("gradient_boosting_classes")
def _(spark, sf):
    return fitted_and_scored(spark, sf, THREE, lambda train: gradient_boosting(train, "y", n_estimators=5, max_depth=4))


@query("xgboost_history")
def _(spark, sf):
    """Loss per round on both parts, up to the stop."""
    parts = splits(spark, sf, NUMBER)
    model = xgboost_style(
        parts.train, "y", parts.val, n_estimators=12, learning_rate=0.5, max_depth=4, early_stopping_rounds=3
    )
    return model.history(spark)


# --- least squares: exact --------------------------------------------------------------

TRAIN_NUMBER = f"(SELECT * FROM {split_sql('lineitem', LINE_KEY, NUMBER)} WHERE split = 'train')"
#: Two-feature least squares from centred sums.
OLS = f"""(SELECT (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2, mx, mz, my, dx, dz
    FROM (SELECT regr_sxx(y, qty) AS sxx, regr_sxx(y, disc) AS szz, regr_sxy(y, qty) AS sxy, regr_sxy(y, disc) AS szy,
        regr_sxy(disc, qty) AS sxz, avg(qty) AS mx, avg(disc) AS mz, avg(y) AS my, stddev_pop(qty) AS dx, stddev_pop(disc) AS dz FROM {TRAIN_NUMBER}))"""


@query(
    "linear_regression",
    f"""SELECT 'qty' AS feature, round(b1, 6) AS weight, round(my - b1 * mx - b2 * mz, 6) AS intercept FROM {OLS}
    UNION ALL SELECT 'disc', round(b2, 6), round(my - b1 * mx - b2 * mz, 6) FROM {OLS}""",
)
def _(spark, sf):
    model = linear_regression(splits(spark, sf, NUMBER).train, "y")
    return model.weights(spark).select("feature", "weight", F.lit(round(model.intercept(), 6)).alias("intercept"))


@query(
    "linear_regression_normalized",
    f"SELECT 'qty' AS feature, round(b1 * dx, 6) AS weight FROM {OLS} UNION ALL SELECT 'disc', round(b2 * dz, 6) FROM {OLS}",
)
def _(spark, sf):
    return linear_regression(splits(spark, sf, NUMBER).train, "y", normalize=True).weights(spark).select("feature", "weight")


@query(
    "linear_regression_predictions",
    f"""SELECT split, count(*)::BIGINT AS rows, round(avg(abs(y - (my + b1 * (qty - mx) + b2 * (disc - mz)))), 6) AS mae
    FROM {split_sql('lineitem', LINE_KEY, NUMBER)}, {OLS} GROUP BY split""",
)
def _(spark, sf):
    parts = splits(spark, sf, NUMBER)
    tagged = linear_regression(parts.train, "y").predictions(parts).tagged()
    return tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 6).alias("mae")
    )


# --- reports on models -----------------------------------------------------------------


@query("training_sample_counts", f"SELECT split, count(*)::BIGINT AS rows FROM (SELECT {part_sql(LINE_KEY)} AS split FROM lineitem) GROUP BY split")
def _(spark, sf):
    return sample_counts(splits(spark, sf, YES_NO))


@query(
    "training_target_distribution",
    f"SELECT y AS label, count(*)::BIGINT AS count FROM {split_sql('lineitem', LINE_KEY, THREE)} WHERE split = 'train' GROUP BY y",
)
def _(spark, sf):
    return target_distribution(splits(spark, sf, THREE).train, "y")


@query(
    "training_info",
    f"""SELECT * FROM (VALUES ('model_type', 'linear_regression'), ('task', 'regression'), ('target', 'y'), ('features', 'qty,disc'),
    ('param.fit_intercept', 'True'), ('param.normalize', 'False')) AS t(name, value)
    UNION ALL SELECT 'intercept', CAST(round(my - b1 * mx - b2 * mz, 6) + 0.0 AS VARCHAR) FROM {OLS}""",
)
def _(spark, sf):
    return linear_regression(splits(spark, sf, NUMBER).train, "y").info(spark)


@query("feature_importance_tree", ONLY_QTY)
def _(spark, sf):
    return feature_importance(decision_tree(splits(spark, sf, STEP).train, "y")).features(spark)


@query(
    "feature_importance_coefficients",
    f"""SELECT 1::BIGINT AS rank, CASE WHEN abs(b1) >= abs(b2) THEN 'qty' ELSE 'disc' END AS feature,
        round(greatest(abs(b1), abs(b2)) / (abs(b1) + abs(b2)), 6) AS importance, round(greatest(abs(b1), abs(b2)), 6) AS raw_importance FROM {OLS}
    UNION ALL SELECT 2, CASE WHEN abs(b1) >= abs(b2) THEN 'disc' ELSE 'qty' END,
        round(least(abs(b1), abs(b2)) / (abs(b1) + abs(b2)), 6), round(least(abs(b1), abs(b2)), 6) FROM {OLS}""",
)
def _(spark, sf):
    return feature_importance(linear_regression(splits(spark, sf, NUMBER).train, "y")).features(spark)


LARGER = "round(greatest(abs(b1), abs(b2)) / (abs(b1) + abs(b2)), 6)"
LARGER_NAME = "CASE WHEN abs(b1) >= abs(b2) THEN 'qty' ELSE 'disc' END"


@query(
    "feature_importance_top",
    f"""SELECT {LARGER_NAME} AS feature, 1::BIGINT AS rank, {LARGER} AS importance FROM {OLS}
    UNION ALL SELECT 'other', 2, round(least(abs(b1), abs(b2)) / (abs(b1) + abs(b2)), 6) FROM {OLS}""",
)
def _(spark, sf):
    return feature_importance(linear_regression(splits(spark, sf, NUMBER).train, "y")).top(spark, 1)


@query(
    "feature_importance_flags",
    f"""SELECT 'dominant_feature' AS type, {LARGER_NAME} AS feature, {LARGER} AS value FROM {OLS} WHERE {LARGER} > 0.5
    UNION ALL SELECT 'scaling', NULL, NULL""",
)
def _(spark, sf):
    return feature_importance(linear_regression(splits(spark, sf, NUMBER).train, "y")).flags(spark)


@query("feature_importance_forest", ONLY_QTY)
def _(spark, sf):
    return feature_importance(random_forest(splits(spark, sf, STEP).train, "y")).features(spark)


@query("model_comparison")
def _(spark, sf):
    with persisted(splits(spark, sf, YES_NO).tagged()) as tagged:
        parts = Splits.of(tagged)
        models = {
            "tree": decision_tree(parts.train, "y"),
            "logistic": logistic_regression(parts.train, "y"),
        }
        return settled(compare_models(models, parts.test).table())


@query("model_save_load", f"SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS same FROM {split_sql('lineitem', LINE_KEY, NUMBER)} WHERE split = 'test'")
def _(spark, sf):
    """A stored model predicts what the trained one does."""
    parts = splits(spark, sf, NUMBER)
    model = linear_regression(parts.train, "y")
    path = scratch_dir(spark, "model")
    model.save(spark, path)
    again = TrainedModel.load(spark, path)
    row_id = ["qty", "disc", "y"]
    both = again.pipeline.transform(parts.test).withColumnRenamed("prediction", "again").drop("_features")
    both = model.pipeline.transform(both).select(*row_id, "again", "prediction")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("again") - F.col("prediction")) < 1e-9).alias("same")
    )


# --- the whole job ---------------------------------------------------------------------

JOB = [
    "nullif(l_quantity, 7) AS qty", "l_extendedprice AS price", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS disc",
    "l_returnflag AS flag", "l_shipdate AS shipped", "CAST(l_quantity + 100 * l_discount > 30 AS INT) AS y",
]


def whole_job(spark, sf):
    parts = splits(spark, sf, JOB)
    steps = [
        Imputer("mean", target="y"),
        Encoder("one_hot", target="y"),
        DatetimeEncoder("shipped", "year,month,weekday"),
        Scaler("StandardScaler", "qty,price,disc", target="y"),
    ]
    outcome = run(parts, steps, logistic_regression, "y")
    metrics = settled(outcome.metrics())
    outcome.release()
    return metrics


@query("whole_job")
def _(spark, sf):
    """Impute, encode, take dates apart, scale, train, and judge on every part."""
    return whole_job(spark, sf)
