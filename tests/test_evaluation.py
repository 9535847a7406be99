import random

import numpy as np
import pytest

from tablewright.operators.comparison import compare_predictions, pick_target
from tablewright.operators.confusion import confusion
from tablewright.operators.curves import Curves, curves
from tablewright.operators.metrics import classification_metrics, prediction_summary, regression_metrics, split_areas
from tablewright.operators.tasks import detect_task
from tablewright.splits import Splits


def scored(spark, true, score):
    rows = [(t, 1 - s, s) for t, s in zip(true, score)]
    return spark.createDataFrame(rows, "y_true int, y_prob_0 double, y_prob_1 double")


def pairs(spark, true, pred, kind="int"):
    return spark.createDataFrame(list(zip(true, pred)), f"y_true {kind}, y_pred {kind}")


def brute_force(true, score):
    """Area by comparing every pair, average precision by walking down the scores."""
    pos, neg = ([s for t, s in zip(true, score) if t == k] for k in (1, 0))
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap, last = 0.0, 0.0
    for cut in sorted(set(score), reverse=True):
        got = [t for t, s in zip(true, score) if s >= cut]
        recall = sum(got) / len(pos)
        ap += (recall - last) * sum(got) / len(got)
        last = recall
    return area, ap


@pytest.mark.parametrize("levels", [5, 1000])
def test_areas_by_brute_force(spark, levels):
    r = random.Random(levels)
    true = [int(r.random() < 0.3) for _ in range(400)]
    score = [min(1.0, max(0.0, round((r.random() + 0.4 * t) / 1.4 * levels) / levels)) for t in true]
    found = curves(scored(spark, true, score)).areas().first()
    assert (found["roc_auc"], found["average_precision"]) == tuple(pytest.approx(v, abs=1e-12) for v in brute_force(true, score))


def test_curves_do_not_depend_on_buckets(spark):
    r = random.Random(9)
    true = [int(r.random() < 0.5) for _ in range(1500)]
    df = scored(spark, true, [r.choice([0.5, r.random()]) for _ in true])
    whole, split = Curves(df), Curves(df.repartition(6), per_bucket=40)
    assert len(split._cuts["1"]) > 5
    for table in ("summary", "roc", "pr"):
        assert getattr(whole, table)().collect() == getattr(split, table)().collect()
    assert whole.roc().count() == 200


def test_separable_scores(spark):
    report = curves(scored(spark, [0, 0, 1, 1, 0, 1], [0.1, 0.2, 0.8, 0.9, 0.3, 0.7]))
    row = report.summary().first()
    assert (row["roc_auc"], row["average_precision"], row["n"]) == (1.0, 1.0, 6)
    points = [(r["fpr"], r["tpr"]) for r in report.roc().collect()]
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and (0.0, 1.0) in points
    ends = report.pr().collect()
    assert (ends[0]["recall"], ends[-1]["recall"], ends[-1]["precision"]) == (1.0, 0.0, 1.0)
    rare = curves(scored(spark, [0, 0, 0, 0, 1], [0.1, 0.2, 0.3, 0.4, 0.9])).summary().first()
    assert rare["prevalence"] == 0.2


def test_labels_other_than_0_and_1(spark):
    df = spark.createDataFrame([(9, 0.9), (10, 0.8), (9, 0.1), (10, 0.95)], "y_true int, y_prob_10 double")
    assert curves(df).labels == ["9", "10"]
    assert curves(df).areas().first()["roc_auc"] == 0.75


def test_curve_input_checks(spark):
    good = scored(spark, [0, 1], [0.1, 0.9])
    for df, message in (
        (good.drop("y_true"), "no y_true"),
        (good.select("y_true"), "need probabilities"),
        (good.where("y_true = 1"), "at least 2 classes"),
    ):
        with pytest.raises(ValueError, match=message):
            curves(df).summary()


def test_confusion_fixture(spark):
    report = confusion(pairs(spark, [0, 0, 1, 1, 1], [0, 0, 1, 1, 1]))
    assert {(r["y_true"], r["y_pred"]): r["count"] for r in report.cells().collect()} == {
        ("0", "0"): 2, ("0", "1"): 0, ("1", "0"): 0, ("1", "1"): 3,
    }
    assert report.summary().first()["accuracy"] == 1.0 and report.flags().count() == 0


def test_confusion_without_columns(spark):
    report = confusion(spark.range(3))
    assert report.cells().count() == 0 and report.summary().first()["total_samples"] == 3
    assert sorted(r["label"] for r in report.flags().collect()) == ["y_pred", "y_true"]


def test_classification_per_split(spark):
    good = pairs(spark, [0, 0, 1, 1, 1], [0, 0, 1, 1, 1])
    poor = pairs(spark, [0, 0, 1, 1, 1], [1, 0, 1, 0, 1])
    report = classification_metrics(Splits(good, poor, good.limit(0)))
    found = {r["split"]: r for r in report.metrics().collect()}
    assert set(found) == {"train", "val"}
    assert found["train"]["f1_macro"] == 1.0 and found["val"]["accuracy"] == 0.6 and found["val"]["auc"] is None
    assert report.flags().first()["gap"] == 0.4
    info = report.class_info().first()
    assert (info["split"], info["majority_label"], info["is_binary"], info["is_imbalanced"]) == ("train", "1", True, False)
    assert {r["pct"] for r in report.split_shares().collect()} == {50}


def test_metrics_need_predictions(spark):
    for call in (classification_metrics, regression_metrics):
        with pytest.raises(ValueError, match="no part holds"):
            call(Splits(spark.range(3)))
        with pytest.raises(ValueError, match="no part holds"):
            call(Splits(pairs(spark, [1], [1]).limit(0)))


def test_metrics_of_a_single_part(spark):
    report = regression_metrics(Splits(None, test=pairs(spark, [1.0, 2.0], [1.0, 3.0], "double")))
    assert [(r["split"], r["mae"]) for r in report.metrics().collect()] == [("test", 0.5)]


def test_regression_fixture(spark):
    df = pairs(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0], "double")
    row = regression_metrics(Splits(df)).metrics().first()
    assert (row["mae"], row["rmse"], row["r2"]) == (0.0, 0.0, 1.0)
    flat = pairs(spark, [2.0, 2.0], [1.0, 2.0], "double")
    assert regression_metrics(Splits(flat)).metrics().first()["r2"] == 0.0
    assert regression_metrics(Splits(df, flat)).flags().count() == 1


def test_prediction_summary_divides_by_all_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.4), (1.0, None), (float("nan"), 1.0)], "y_true double, y_pred double")
    row = prediction_summary(df).summary().first()
    assert (row["n_samples"], row["correct"], row["accuracy"]) == (4, 2, 0.5)


def test_task_detection(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 3), i / 7, str(i)) for i in range(50)], "a int, b int, c double, d double, s string")
    found = {c: (detect_task(df, c), detect_task(df, c, "tree")) for c in df.columns}
    c, r = "classification", "regression"
    assert found == {"a": (r, r), "b": (c, c), "c": (c, r), "d": (r, r), "s": (c, r)}


def test_comparison_rules(spark):
    true = [0, 1] * 10
    tables = {"a": pairs(spark, true, true), "b": pairs(spark, true, true), "c": pairs(spark, true, [0] * 20)}
    report = compare_predictions(tables)
    best = {r["model"] for r in report.table().collect() if r["is_best"] and r["metric"] == "recall"}
    assert best == {"a", "b"}
    assert "small_test_set" in {r["type"] for r in report.flags().collect()}
    with pytest.raises(ValueError, match="two to four"):
        compare_predictions({"a": tables["a"]})
    assert pick_target(spark.createDataFrame([(1, 2)], "label int, z int")) == "label"
    assert pick_target(spark.createDataFrame([(1, 2)], "p int, z int")) == "z"
    noise = np.random.default_rng(0).normal(size=60)
    numbers = {n: pairs(spark, noise.tolist(), (noise * k).tolist(), "double") for n, k in (("x", 0.9), ("y", 0.5))}
    top = {r["metric"]: r["model"] for r in compare_predictions(numbers).table().where("is_best").collect()}
    assert set(top.values()) == {"x"} and set(top) == {"mse", "rmse", "mae", "r2"}


def test_a_missing_label_is_written_out(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (1, None), (None, None)], "y_true int, y_pred int")
    report = confusion(df)
    cells = {(r["y_true"], r["y_pred"]): r["count"] for r in report.cells().collect()}
    assert cells == {("1", "1"): 1, ("None", "1"): 1, ("1", "None"): 1, ("None", "None"): 1}
    assert {r["label"]: r["support"] for r in report.per_class().collect()} == {"1": 2, "None": 2}


def test_dense_and_sparse_cells(spark):
    df = pairs(spark, range(40), [0] * 40)
    assert confusion(df).cells().count() == 1600
    sparse = confusion(df).cells(dense=False)
    assert sparse.count() == 40
    assert sorted(map(tuple, confusion(df).cells().where("count > 0").collect())) == sorted(map(tuple, sparse.collect()))


def many_classes(spark, n, rows):
    cells = [(f"c{i % n:03d}" if i % 7 else None, *[((i * 31 + j * 17) % 97) / 97 for j in range(n)]) for i in range(rows)]
    names = ", ".join(["y_true string", *[f"y_prob_c{j:03d} double" for j in range(n)]])
    return spark.createDataFrame(cells, names)


def test_many_classes_in_small_buckets(spark):
    """Missing labels do not cost a class, and cut points change nothing."""
    df = many_classes(spark, 40, 600)
    whole, cut = Curves(df), Curves(df, per_bucket=10)
    assert len(whole.labels) == 40
    areas = [{r["class"]: (r["roc_auc"], r["average_precision"]) for r in x.areas().collect()} for x in (whole, cut)]
    assert len(areas[0]) == 40 and all(areas[0][c] == pytest.approx(areas[1][c]) for c in areas[0])


def test_labels_without_a_column_are_not_collected(spark, monkeypatch):
    """A continuous y_true by mistake: only labels with a probability column are read, all rows still count."""
    monkeypatch.setattr("tablewright.operators.curves.OTHER_LABELS", 10)
    rows = [(f"{i}.5" if i % 2 else "ab"[i // 2 % 2], (i % 10) / 10, 1 - (i % 10) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "y_true string, y_prob_a double, y_prob_b double")
    found = curves(df)
    assert found.labels == ["a", "b"] and found.task == "multiclass" and set(found.scored) == {"a", "b"}
    assert found._facts["total"] == 400
    tagged = Splits(df, None, df.where("length(y_true) = 1"))
    areas = split_areas(tagged)
    assert [r["split"] for r in areas.collect()] == ["test"]
    exact = curves(df.where("length(y_true) = 1"))
    assert exact.task == "binary"


def test_two_labels_without_their_columns(spark):
    df = spark.createDataFrame([(i % 2, i / 50) for i in range(50)], "y_true int, y_prob_yes double")
    found = curves(df)
    assert found.task == "binary" and found.labels == ["0", "1"] and list(found.scored.values()) == ["y_prob_yes"]
    assert split_areas(Splits(df, None, None)).count() == 1


def test_dense_confusion_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "y_true int, y_pred int")
    assert confusion(df).cells().count() == 900 and confusion(df).cells(dense=False).count() == 30
    monkeypatch.setattr("tablewright.operators.confusion.DENSE_LABELS", 29)
    with pytest.raises(ValueError, match="dense=False"):
        confusion(df).cells()
    assert confusion(df).cells(dense=False).count() == 30
