import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import selection
from tablewright.operators.split import (
    check_stratified,
    exact_sizes,
    random_split,
    stratified_split,
)
from tablewright.splits import Splits


def basic(spark, n=100):
    return spark.createDataFrame([(i, 2.0 * i, i % 2) for i in range(n)], "feature1 int, feature2 double, target int")


def sizes(parts):
    return tuple(frame.count() for _, frame in parts.items())


@pytest.mark.parametrize("test, val, expected", [(0.2, 0.1, (70, 10, 20)), (0.3, 0.1, (59, 11, 30)), (0.25, 0.0, (75, 0, 25))])
def test_exact_sizes(spark, test, val, expected):
    parts = random_split(basic(spark), test, val, key="feature1", exact=True).splits()
    assert sizes(parts) == expected
    assert parts.val.columns == parts.train.columns == basic(spark).columns


def test_parts_are_disjoint_and_complete(spark):
    df = basic(spark, 1000)
    for assignment in (random_split(df), random_split(df, exact=True), stratified_split(df, "target")):
        keys = [r["feature1"] for _, f in assignment.splits().items() for r in f.collect()]
        assert sorted(keys) == list(range(1000))


def test_parts_do_not_depend_on_partitioning(spark):
    df = basic(spark, 500)
    for kw in ({}, {"exact": True}, {"stratify": "target"}):
        seen = {
            tuple(sorted(map(tuple, random_split(df.repartition(n), **kw).tagged.collect()))) for n in (1, 7, 64)
        }
        assert len(seen) == 1


def test_seed_changes_parts(spark):
    df = basic(spark, 200)
    a, b = (random_split(df, seed=s).tagged.where("split = 'test'").select("feature1").collect() for s in (1, 2))
    assert a != b


def test_sequential_order(spark):
    parts = random_split(basic(spark), order_by="feature1").splits()
    assert max(r[0] for r in parts.train.collect()) == 69
    assert min(r[0] for r in parts.test.collect()) == 80
    with pytest.raises(ValueError, match="order_by"):
        random_split(basic(spark), order_by="feature2")


def test_stratified_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 190 else "b") for i in range(200)], "i int, y string")
    found = {
        (r["split"], r["y"]): r["count"]
        for r in stratified_split(df, "y", 0.6, 0.2, 0.2).tagged.groupBy("split", "y").count().collect()
    }
    assert found == {
        ("train", "a"): 114, ("val", "a"): 38, ("test", "a"): 38, ("train", "b"): 6, ("val", "b"): 2, ("test", "b"): 2,
    }


def test_null_class_is_kept(spark):
    df = spark.createDataFrame([(i, None if i < 50 else "x") for i in range(100)], "i int, y string")
    assert sum(sizes(stratified_split(df, "y", key="i").splits())) == 100


@pytest.mark.parametrize("per_ranking", [1, 30, 10**6])
@pytest.mark.parametrize("bits", [2, 5, 16])
def test_positions_of_codes(spark, monkeypatch, per_ranking, bits):
    """Classes of any size, codes many rows share, ends of the range; refined level by level or ranked."""
    monkeypatch.setattr(selection, "CELL_BITS", bits)
    r = random.Random(bits)
    rows = [("hot", r.choice([7, 7, r.randrange(4000)])) for _ in range(900)] + [(f"c{i % 5}", r.randrange(-50, 4000)) for i in range(300)]
    rows += [("one", 3999)] * 40 + [(None, -50)]
    df = spark.createDataFrame(rows, "_class string, _code long").repartition(3)
    wanted = [(c, f"w{k}", k) for c, n in (("hot", 900), ("c0", 60), ("one", 40)) for k in (1, n // 3, n // 2, n)]
    cells = selection.count_cells(df, -50, 3999)
    asked = spark.createDataFrame(wanted, "_class string, which string, rank long")
    found = {tuple(x[:3]): tuple(x[3:]) for x in selection.positions(df, cells, asked, -50, 3999, per_ranking).collect()}
    for c, which, rank in wanted:
        mine = sorted(code for name, code in rows if name == c)
        code = mine[rank - 1]
        assert found[c, which, rank] == (code, sum(x < code for x in mine), mine.count(code))
    totals = {x["_class"]: x["count"] for x in selection.class_totals(cells).collect()}
    assert totals == {"hot": 900, "one": 40, None: 1, **{f"c{i}": 60 for i in range(5)}}


def test_exact_split_of_a_constant_key(spark):
    """One key for all rows: still exact sizes, every row once, the same parts for any partitioning, no task with all rows."""
    df = spark.range(2000).selectExpr("'same' AS k", "id % 700 AS v")
    first = random_split(df.repartition(7), 0.2, 0.1, key="k", exact=True).tagged
    assert {r["split"]: r["count"] for r in first.groupBy("split").count().collect()} == {"train": 1400, "val": 200, "test": 400}
    assert first.drop("split").exceptAll(df).count() == 0 and df.exceptAll(first.drop("split")).count() == 0
    second = random_split(df.repartition(3), 0.2, 0.1, key="k", exact=True).tagged
    assert first.exceptAll(second).count() == 0


def test_exact_split_numbers_equal_rows_per_task(spark, monkeypatch):
    monkeypatch.setattr("tablewright.operators.split.COPIES", 9)
    df = spark.range(1003).selectExpr("CAST(NULL AS STRING) AS k", "1.5D AS v").repartition(6)
    tagged = random_split(df, 0.2, 0.1, exact=True).tagged
    assert {r["split"]: r["count"] for r in tagged.groupBy("split").count().collect()} == {"train": 701, "val": 101, "test": 201}
    assert tagged.drop("split").distinct().count() == 1
    for n in (1, 2, 3):
        small = random_split(df.limit(n), 0.2, 0.1, exact=True).tagged
        assert small.count() == n and small.where("split = 'test'").count() == 1
    assert random_split(df.limit(0), exact=True).tagged.count() == 0


def test_splits_take_few_jobs(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS y")
    tracker = spark.sparkContext.statusTracker()
    for name, build in (("exact", lambda: random_split(df, exact=True, key="id")), ("by class", lambda: stratified_split(df, "y", key="id"))):
        spark.sparkContext.setJobGroup(name, name)
        tagged = build().tagged
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(tracker.getJobIdsForGroup(name)) <= 20
        assert tagged.count() == 5000


def test_stratified_checks(spark):
    df = spark.createDataFrame([(i, float(i % 2), i / 10, "ab"[i > 97]) for i in range(100)], "i int, y double, z double, w string")
    assert sum(sizes(stratified_split(df, "y").splits())) == 100
    for kw, message in (
        (dict(target="y", train_ratio=0.5), "sum to 1"),
        (dict(target=None), "target column is required"),
        (dict(target="nope"), "does not exist"),
        (dict(target="z"), "continuous"),
        (dict(target="w"), "at least 3 rows"),
    ):
        with pytest.raises(ValueError, match=message):
            stratified_split(df, **kw)
    with pytest.raises(ValueError, match="shares"):
        random_split(df, 0.7, 0.4)


def test_size_arithmetic():
    assert exact_sizes(100, 0.3, 0.1) == (30, 11)
    assert exact_sizes(10, 0.2, 0.0) == (2, 0)


def test_splits_holder(spark):
    df = basic(spark)
    loose = Splits(df, None, df.limit(5))
    assert loose.tagged().groupBy("split").count().count() == 2
    doubled = loose.each(lambda f: f.union(f))
    assert sizes(doubled) == (200, 10)
    tagged = random_split(df).tagged
    assert Splits.of(tagged).project(lambda f: f.drop("feature2")).train.columns == ["feature1", "target"]


@pytest.mark.parametrize("per_ranking", [10, 1_000_000])
def test_rows_without_a_value_are_last(spark, monkeypatch, per_ranking):
    monkeypatch.setattr("tablewright.operators.split.ROWS_PER_RANKING", per_ranking)
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i) for i in range(1000)], "id int, at int")
    tagged = random_split(df, 0.2, 0.1, order_by="at").tagged
    assert {r["split"]: r["count"] for r in tagged.groupBy("split").count().collect()} == {"train": 700, "val": 100, "test": 200}
    assert tagged.where("at is null and split <> 'test'").count() == 0


@pytest.mark.parametrize("per_ranking", [10, 1_000_000])
def test_exact_sizes_with_equal_rows(spark, monkeypatch, per_ranking):
    monkeypatch.setattr("tablewright.operators.split.ROWS_PER_RANKING", per_ranking)
    df = spark.createDataFrame([(i % 3,) for i in range(1000)], "x int")
    tagged = random_split(df, 0.2, 0.1, exact=True).tagged
    assert {r["split"]: r["count"] for r in tagged.groupBy("split").count().collect()} == {"train": 700, "val": 100, "test": 200}


def test_all_small_classes_are_counted(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(30)], "y string")
    with pytest.raises(ValueError, match="and 10 more"):
        check_stratified(df, "y")
