"""Curves, confusion matrices, metrics and comparisons of prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.comparison import compare_predictions
from tablewright.operators.confusion import confusion
from tablewright.operators.curves import curves
from tablewright.operators.metrics import classification_metrics, regression_metrics
from tablewright.operators.tasks import detect_task
from tablewright.plans.inputs import (
    BINARY,
    LINE_KEY,
    MULTI,
    REGRESSION,
    TIED,
    project,
    split_sql,
    split_table,
    subquery,
    table,
    union_sql,
)
from tablewright.plans.registry import query
from tablewright.splits import Splits

BINARY_SQL, TIED_SQL, MULTI_SQL = (subquery("lineitem", e) for e in (BINARY, TIED, MULTI))

#: Document labels scored by text length: an imbalanced target and a poor score.
DOCUMENTS = """(SELECT l.toxic AS y_true, d.n_chars / (SELECT max(n_chars) FROM documents)::DOUBLE AS y_prob_1,
    1 - d.n_chars / (SELECT max(n_chars) FROM documents)::DOUBLE AS y_prob_0 FROM labels l JOIN documents d USING (doc_id))"""


def document_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    longest = docs.agg(F.max("n_chars").alias("most"))
    share = F.col("n_chars") / F.col("most")
    # One-row side.
    joined = table(spark, sf, "labels").join(docs, "doc_id").join(F.broadcast(longest))
    return joined.select(F.col("toxic").alias("y_true"), share.alias("y_prob_1"), (1 - share).alias("y_prob_0"))


# --- curves ----------------------------------------------------------------------------


def steps_sql(source: str, label: str, hit: str, score: str) -> str:
    """Running counts per distinct score, best first."""
    return f"""(SELECT '{label}' AS class, s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        row_number() OVER w - 1 AS k, count(*) OVER () AS m, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
        lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
        FROM (SELECT {score} AS s, count(*) FILTER ({hit}) AS pos, count(*) FILTER (NOT ({hit})) AS neg FROM {source} GROUP BY 1)
        WINDOW w AS (ORDER BY s DESC))"""


def areas_sql(steps: str) -> str:
    return f"""SELECT class, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(p) / max(n) AS roc_auc,
        sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p) AS average_precision, max(p) / (max(p) + max(n))::DOUBLE AS prevalence,
        (max(p) + max(n))::BIGINT AS n FROM {steps} GROUP BY class"""


def summary_sql(steps: str) -> str:
    return f"""SELECT class, round(roc_auc, 4) AS roc_auc, round(average_precision, 4) AS average_precision,
        round(prevalence, 4) AS prevalence, n FROM ({areas_sql(steps)})"""


def thinned_sql(points: str, x: str, y: str) -> str:
    return f"""SELECT class, i::BIGINT AS i, round({x}, 6) AS {x}, round({y}, 6) AS {y}
        FROM (SELECT *, count(*) OVER (PARTITION BY class) AS total FROM ({points}))
        WHERE total <= 200 OR i = total - 1
        OR i IN (SELECT floor(j * ((total - 1) / 199.0::DOUBLE)) FROM range(199) r(j))"""


def roc_sql(steps: str, label: str) -> str:
    corners = f"""SELECT class, row_number() OVER (ORDER BY k) AS i, fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM {steps}
        WHERE k = 0 OR k = m - 1 OR pos <> next_pos OR neg <> next_neg"""
    return thinned_sql(f"{corners} UNION ALL SELECT '{label}', 0, 0.0::DOUBLE, 0.0::DOUBLE", "fpr", "tpr")


def pr_sql(steps: str) -> str:
    points = f"SELECT class, m - 1 - k AS i, tp / p::DOUBLE AS recall, tp / (tp + fp)::DOUBLE AS precision FROM {steps}"
    last = f"SELECT DISTINCT class, m, 0.0::DOUBLE, 1.0::DOUBLE FROM {steps}"
    return thinned_sql(f"{points} UNION ALL {last}", "recall", "precision")


BINARY_STEPS = steps_sql(BINARY_SQL, "1", "y_true = 1", "y_prob_1")
TIED_STEPS = steps_sql(TIED_SQL, "1", "y_true = 1", "y_prob_1")
DOC_STEPS = steps_sql(DOCUMENTS, "1", "y_true = 1", "y_prob_1")
MULTI_STEPS = "(" + union_sql(
    [f"SELECT * FROM {steps_sql(MULTI_SQL, c, f'y_true = {chr(39)}{c}{chr(39)}', f'y_prob_{c}')}" for c in "ANR"]
) + ")"


@query("curves_summary", summary_sql(BINARY_STEPS))
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", BINARY)).summary()


@query("curves_summary_ties", summary_sql(TIED_STEPS))
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", TIED)).summary()


@query("curves_roc", roc_sql(BINARY_STEPS, "1"))
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", BINARY)).roc()


@query("curves_roc_ties", roc_sql(TIED_STEPS, "1"))
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", TIED)).roc()


@query("curves_pr", pr_sql(BINARY_STEPS))
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", BINARY)).pr()


@query("curves_summary_classes", summary_sql(MULTI_STEPS))
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", MULTI)).summary()


@query(
    "curves_macro",
    f"""SELECT round(avg(roc_auc), 4) AS macro_roc_auc, round(avg(average_precision), 4) AS macro_average_precision,
    3::BIGINT AS n_classes, max(n)::BIGINT AS n FROM ({summary_sql(MULTI_STEPS)})""",
)
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", MULTI)).macro()


@query(
    "curves_roc_classes",
    "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(
        roc_sql(steps_sql(MULTI_SQL, c, f"y_true = '{c}'", f"y_prob_{c}"), c) for c in "ANR"
    ) + ")",
)
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", MULTI)).roc()


FLAG_SQL = """SELECT class, unnest([CASE WHEN roc_auc < 0.6 THEN 'low_roc_auc' WHEN roc_auc < 0.7 THEN 'medium_roc_auc' END,
    CASE WHEN prevalence < 0.1 THEN 'high_imbalance' END,
    CASE WHEN average_precision < prevalence * 1.5 AND prevalence < 0.5 THEN 'low_average_precision' END]) AS type"""


@query("curves_flags", f"SELECT * FROM ({FLAG_SQL} FROM ({areas_sql(DOC_STEPS)})) WHERE type IS NOT NULL")
def _(spark, sf):
    return curves(document_scores(spark, sf)).flags()


@query("curves_flags_classes", "SELECT 'R' AS class, 'missing_prob_column' AS type FROM region LIMIT 1")
def _(spark, sf):
    return curves(project(spark, sf, "lineitem", MULTI).drop("y_prob_R")).flags()


# --- confusion matrix ------------------------------------------------------------------


def cells_sql(source: str) -> str:
    return f"""(WITH v AS (SELECT CAST(y_true AS VARCHAR) AS t, CAST(y_pred AS VARCHAR) AS q FROM {source}),
        l AS (SELECT t AS c FROM v UNION SELECT q FROM v)
        SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM v WHERE t = a.c AND q = b.c)::BIGINT AS count FROM l a, l b)"""


def scores_sql(source: str) -> str:
    return f"""(WITH m AS {cells_sql(source)},
        s AS (SELECT l.y_true AS label, sum(count) FILTER (m.y_true = l.y_true AND m.y_pred = l.y_true) AS tp,
            sum(count) FILTER (m.y_true = l.y_true) AS support, sum(count) FILTER (m.y_pred = l.y_true) AS predicted
            FROM m, (SELECT DISTINCT y_true FROM m) l GROUP BY ALL)
        SELECT label, tp, support::BIGINT AS support, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision,
            coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / (predicted + support)::DOUBLE, 0) AS f1 FROM s)"""


#: Predictions name a class that never occurs.
STRANGE = ["l_returnflag AS y_true", "CASE WHEN l_quantity < 14 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'X' END AS y_pred"]
STRANGE_SQL = subquery("lineitem", STRANGE)
LABELS = ["quality AS y_true", "1 - toxic AS y_pred"]
LABELS_SQL = subquery("labels", LABELS)


@query(
    "confusion_cells",
    f"""SELECT y_true, y_pred, count, coalesce(round(count / nullif(sum(count) OVER (PARTITION BY y_true), 0)::DOUBLE, 4), 0) AS row_share
    FROM {cells_sql(STRANGE_SQL)}""",
)
def _(spark, sf):
    return confusion(project(spark, sf, "lineitem", STRANGE)).cells()


@query(
    "confusion_per_class",
    f"SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM {scores_sql(STRANGE_SQL)}",
)
def _(spark, sf):
    return confusion(project(spark, sf, "lineitem", STRANGE)).per_class()


@query(
    "confusion_summary",
    f"""SELECT sum(support)::BIGINT AS total_samples, count(*)::BIGINT AS num_classes,
    round(sum(tp) / sum(support)::DOUBLE, 4) AS accuracy FROM {scores_sql(BINARY_SQL)}""",
)
def _(spark, sf):
    return confusion(project(spark, sf, "lineitem", BINARY)).summary()


@query(
    "confusion_flags",
    f"""WITH s AS {scores_sql(LABELS_SQL)}
    SELECT 'low_recall' AS type, label FROM s WHERE round(recall, 4) < 0.5 AND support > 0
    UNION ALL SELECT 'class_imbalance', NULL FROM s HAVING max(support) > 3 * min(support) AND min(support) > 0""",
)
def _(spark, sf):
    return confusion(project(spark, sf, "labels", LABELS)).flags()


@query(
    "confusion_missing_columns",
    "SELECT count(*)::BIGINT AS total_samples, 0::BIGINT AS num_classes, 0.0::DOUBLE AS accuracy FROM lineitem",
)
def _(spark, sf):
    return confusion(project(spark, sf, "lineitem", TIED)).summary()


# --- metrics per split -----------------------------------------------------------------

#: Predictions are made worse outside the training part.
CLASSES = [
    "l_linenumber % 3 AS y_true",
    "CASE WHEN l_quantity < 40 THEN l_linenumber % 3 ELSE 2 END AS y_pred",
    "1.0 - l_linenumber / 10 - l_quantity / 200 AS y_prob_0",
    "l_linenumber / 20 AS y_prob_1",
    "l_linenumber / 20 + l_quantity / 200 AS y_prob_2",
]
SPLIT_CLASSES = split_sql("lineitem", LINE_KEY, CLASSES)
PARTS = ("train", "val", "test")


def part(source: str, name: str) -> str:
    return f"(SELECT * FROM {source} WHERE split = '{name}')"


def auc_sql(source: str, labels: list[str]) -> str:
    steps = "(" + union_sql(
        [f"SELECT * FROM {steps_sql(source, c, f'y_true = {c}', f'y_prob_{c}')}" for c in labels]
    ) + ")"
    return f"(SELECT avg(roc_auc) FROM ({areas_sql(steps)}))"


def class_metrics_sql(source: str, labels: list[str]) -> str:
    return union_sql(
        [
            f"""SELECT '{p}' AS split, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
            round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, sum(support)::BIGINT AS support,
            round({auc_sql(part(source, p), labels)}, 6) AS auc FROM {scores_sql(part(source, p))}"""
            for p in PARTS
        ]
    )


def class_splits(spark, sf):
    return classification_metrics(split_table(spark, sf, "lineitem", LINE_KEY, CLASSES))


@query("classification_metrics", class_metrics_sql(SPLIT_CLASSES, ["0", "1", "2"]))
def _(spark, sf):
    return class_splits(spark, sf).metrics()


@query("classification_metrics_binary", class_metrics_sql(split_sql("lineitem", LINE_KEY, BINARY), ["1"]))
def _(spark, sf):
    return classification_metrics(split_table(spark, sf, "lineitem", LINE_KEY, BINARY)).metrics()


@query(
    "classification_per_label",
    union_sql(
        [
            f"SELECT '{p}' AS split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support "
            f"FROM {scores_sql(part(SPLIT_CLASSES, p))}"
            for p in PARTS
        ]
    ),
)
def _(spark, sf):
    return class_splits(spark, sf).per_label()


@query(
    "classification_class_info",
    f"""SELECT 'train' AS split, count(*)::BIGINT AS n_classes, min_by(label, -support) AS majority_label,
    round(max(support) / sum(support)::DOUBLE, 4) AS majority_pct, count(*) = 2 AS is_binary,
    round(max(support) / sum(support)::DOUBLE, 4) > 0.65 AS is_imbalanced FROM {scores_sql(part(SPLIT_CLASSES, 'train'))}""",
)
def _(spark, sf):
    return class_splits(spark, sf).class_info()


@query(
    "classification_split_shares",
    f"""SELECT split, count(*)::BIGINT AS support, (SELECT count(*) FROM lineitem)::BIGINT AS total_samples,
    round_even(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE * 100, 0)::BIGINT AS pct FROM {SPLIT_CLASSES} GROUP BY split""",
)
def _(spark, sf):
    return class_splits(spark, sf).split_shares()


#: Perfect on the training part, wrong on every third row elsewhere.
OVERFIT = ["l_linenumber", "l_quantity"]


def overfit_splits(spark, sf, good: str, bad: str):
    tagged = split_table(spark, sf, "lineitem", LINE_KEY, OVERFIT).tagged()
    guess = f"CASE WHEN split = 'train' THEN {good} ELSE {bad} END"
    return Splits.of(tagged.selectExpr("split", "l_linenumber AS y_true", f"{guess} AS y_pred"))


WRONG = "CASE WHEN l_quantity > 30 THEN 0 ELSE l_linenumber END"


@query(
    "classification_flags",
    f"""SELECT 'overfitting' AS type, round(1.0 - val, 6) AS gap FROM (SELECT round(avg(CASE WHEN l_linenumber = {WRONG} THEN 1.0 ELSE 0.0 END), 6) AS val
    FROM {part(split_sql('lineitem', LINE_KEY, OVERFIT), 'val')}) WHERE 1.0 - val > 0.05""",
)
def _(spark, sf):
    return classification_metrics(overfit_splits(spark, sf, "l_linenumber", WRONG)).flags()


SPLIT_NUMBERS = split_sql("lineitem", LINE_KEY, REGRESSION)


@query(
    "regression_metrics",
    f"""SELECT split, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse,
    round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 6) AS r2, count(*)::BIGINT AS support
    FROM {SPLIT_NUMBERS} GROUP BY split""",
)
def _(spark, sf):
    return regression_metrics(split_table(spark, sf, "lineitem", LINE_KEY, REGRESSION)).metrics()


@query(
    "regression_flags",
    f"""SELECT 'overfitting' AS type, round(v / t, 6) AS ratio FROM
    (SELECT round(sqrt(avg(0.25)), 6) AS t FROM lineitem), (SELECT round(sqrt(avg(power(l_linenumber - {WRONG}, 2))), 6) AS v
    FROM {part(split_sql('lineitem', LINE_KEY, OVERFIT), 'val')}) WHERE v / t > 1.3""",
)
def _(spark, sf):
    return regression_metrics(overfit_splits(spark, sf, "l_linenumber + 0.5", WRONG)).flags()


# --- comparison ------------------------------------------------------------------------

MODELS = {
    "tree": "CASE WHEN l_quantity > 26 THEN 1 ELSE 0 END",
    "line": "CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END",
    "coin": "l_linenumber % 2",
}
BINARY_TRUE = "CASE WHEN l_quantity + 100 * l_discount > 30 THEN 1 ELSE 0 END AS y_true"


def compared(spark, sf, true: str, models: dict[str, str]):
    df = table(spark, sf, "lineitem")
    return compare_predictions({n: df.selectExpr(true, f"{p} AS y_pred") for n, p in models.items()})


def long_sql(wide: dict[str, str], metrics: list[str], lower: bool = False) -> str:
    """Metric rows of wide one-row-per-model queries, best ones marked."""
    rows = union_sql(
        [f"SELECT '{n}' AS model, '{m}' AS metric, {m} AS v FROM ({q})" for n, q in wide.items() for m in metrics]
    )
    pick = "CASE WHEN metric IN ('mse', 'rmse', 'mae') THEN v = min(v) OVER (PARTITION BY metric) ELSE v = max(v) OVER (PARTITION BY metric) END"
    return f"SELECT model, metric, round(v, 6) AS value, {pick} AS is_best FROM ({rows})"


def binary_wide(source: str) -> str:
    return f"""SELECT sum(tp) / sum(support)::DOUBLE AS accuracy, max(precision) FILTER (label = '1') AS precision,
        max(recall) FILTER (label = '1') AS recall, max(f1) FILTER (label = '1') AS f1_score FROM {scores_sql(source)}"""


SCORES = ["accuracy", "precision", "recall", "f1_score"]
BINARY_COMPARED = long_sql(
    {n: binary_wide(subquery("lineitem", [BINARY_TRUE, f"{p} AS y_pred"])) for n, p in MODELS.items()}, SCORES
)


@query("comparison_binary", BINARY_COMPARED)
def _(spark, sf):
    return compared(spark, sf, BINARY_TRUE, MODELS).table()


CLASS_MODELS = {"low": "CASE WHEN l_quantity < 30 THEN l_linenumber % 3 ELSE 1 END", "all": "l_linenumber % 3", "same": "l_linenumber % 3"}


def weighted_wide(source: str) -> str:
    return f"""SELECT sum(tp) / sum(support)::DOUBLE AS accuracy, sum(precision * support) / sum(support)::DOUBLE AS precision,
        sum(recall * support) / sum(support)::DOUBLE AS recall, sum(f1 * support) / sum(support)::DOUBLE AS f1_score FROM {scores_sql(source)}"""


@query(
    "comparison_weighted",
    long_sql(
        {n: weighted_wide(subquery("lineitem", ["l_linenumber % 3 AS y_true", f"{p} AS y_pred"])) for n, p in CLASS_MODELS.items()},
        SCORES,
    ),
)
def _(spark, sf):
    return compared(spark, sf, "l_linenumber % 3 AS y_true", CLASS_MODELS).table()


NUMBER_MODELS = {"scaled": "l_quantity * 2000", "shifted": "l_quantity * 2000 + 500", "flat": "50000.0"}


def regression_wide(p: str) -> str:
    return f"""SELECT avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae,
        1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM (SELECT l_extendedprice AS y, CAST({p} AS DOUBLE) AS p FROM lineitem)"""


@query(
    "comparison_regression",
    "SELECT model, metric, round(value, 2) AS value, is_best FROM ("
    + long_sql({n: regression_wide(p) for n, p in NUMBER_MODELS.items()}, ["mse", "rmse", "mae", "r2"])
    + ")",
)
def _(spark, sf):
    models = {n: f"CAST({p} AS DOUBLE)" for n, p in NUMBER_MODELS.items()}
    return compared(spark, sf, "l_extendedprice AS y_true", models).table().withColumn("value", F.round("value", 2))


@query(
    "comparison_flags",
    f"""SELECT 'close_results' AS type, metric, round(max(value) - min(value), 6) AS value FROM ({BINARY_COMPARED})
    WHERE model <> 'coin' GROUP BY metric HAVING max(value) - min(value) < 0.02""",
)
def _(spark, sf):
    return compared(spark, sf, BINARY_TRUE, {n: p for n, p in MODELS.items() if n != "coin"}).flags()


# --- task detection --------------------------------------------------------------------

TARGETS = {
    "l_linenumber": ("lineitem", "l_linenumber"),
    "l_quantity": ("lineitem", "l_quantity"),
    "l_discount": ("lineitem", "l_discount"),
    "quality": ("labels", "CAST(quality AS DOUBLE)"),
    "l_returnflag": ("lineitem", "l_returnflag"),
    "l_partkey": ("lineitem", "l_partkey"),
}


def task_sql(rule: str) -> str:
    blocks = []
    for name, (source, expr) in TARGETS.items():
        if name == "l_returnflag":
            test = "true"
        else:
            test = f"count(DISTINCT {expr}) <= 20 AND bool_and({expr} = floor({expr}))"
            if rule == "tree":
                test += f" AND NOT starts_with(typeof(any_value({expr})), 'DOUBLE')"
        blocks.append(f"SELECT '{name}' AS target, CASE WHEN {test} THEN 'classification' ELSE 'regression' END AS task FROM {source}" + (" LIMIT 1" if test == "true" else ""))
    return "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(blocks) + ")"


for _rule in ("numeric", "tree"):

    @query(f"detect_task_{_rule}", task_sql(_rule))
    def _(spark, sf, rule=_rule):
        rows = [
            (name, detect_task(project(spark, sf, source, [f"{expr} AS v"]), "v", rule))
            for name, (source, expr) in TARGETS.items()
        ]
        return spark.createDataFrame(rows, "target string, task string")
