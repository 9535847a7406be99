"""Fitted steps written and read again do what they did before."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright.operators.dates import DatetimeEncoder
from tablewright.operators.drop import ColumnDropper
from tablewright.operators.encode import Encoder
from tablewright.operators.fitted import Projection
from tablewright.operators.impute import Imputer
from tablewright.operators.interact import Interactions
from tablewright.operators.logs import LogTransform
from tablewright.operators.scale import Scaler
from tablewright.operators.select import FeatureSelector
from tablewright.operators.stored_steps import load_steps, save_steps
from tablewright.streaming.apply import apply_to_stream, file_stream, write_available

SCHEMA = "id int, age double, years int, city string, `na``me, x` string, at timestamp, paid decimal(9,2), made date, y int"


@pytest.fixture
def people(spark):
    rows = [
        (
            i, None if i % 5 == 0 else i / 3, None if i % 7 == 0 else i % 4, None if i % 6 == 0 else f"c{i % 3}", f"n{i}",
            dt.datetime(2024, 1, 1 + i % 28, i % 24), None if i % 9 == 0 else Decimal(i % 5) / 4, None if i % 8 == 0 else dt.date(2020, 1 + i % 3, 1), i % 2,
        )
        for i in range(120)
    ]
    return spark.createDataFrame(rows, SCHEMA)


STEPS = {
    "mean": [Imputer("mean")], "median": [Imputer("median")], "mode": [Imputer("mode")], "constant": [Imputer("constant", "7", columns="age,years,city")],
    "label": [Encoder("label", "city")], "label_large": [Encoder("label", ["city", "na`me, x"], literal_categories=2)],
    "one_hot": [Encoder("one_hot", "city")], "one_hot_vector": [Encoder("one_hot", ["na`me, x"], output="vector", literal_categories=2)],
    "standard": [Scaler("StandardScaler")], "min_max": [Scaler("MinMaxScaler")], "robust": [Scaler("RobustScaler")],
    "signed_log": [LogTransform("signed_log", "age,years")], "log1p": [LogTransform("log1p", "age")], "power": [LogTransform("yeo_johnson", "age")],
    "pairs": [Interactions("age:years", "ratio"), Interactions([("age", "id")], "subtract")],
    "dates": [DatetimeEncoder("at", "year,hour")], "date": [DatetimeEncoder("made", "month", drop_original=False)],
    "drop": [ColumnDropper("years")], "select": [FeatureSelector(threshold=0.5)],
    "all": [Imputer("mean", target="y"), Encoder("label", "city"), Interactions("age:id"), DatetimeEncoder("at"), Scaler(target="y", columns="age,id")],
}


def fitted_on(df, steps):
    found = []
    for step in steps:
        found.append(step.fit(df))
        df = found[-1].transform(df)
    return found, df


def lines(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(STEPS))
def test_same_rows_in_another_session(spark, people, tmp_path, name):
    steps, want = fitted_on(people, STEPS[name])
    save_steps(spark, steps, str(tmp_path / "steps"))
    people.write.parquet(str(tmp_path / "people"))
    other = spark.newSession()
    df = other.read.parquet(str(tmp_path / "people"))
    for step in load_steps(other, str(tmp_path / "steps")):
        df = step.transform(df)
    assert df.schema.simpleString() == want.schema.simpleString()
    assert lines(df) == lines(want)


def test_reports_and_checks_stay(spark, people, tmp_path):
    texts = people.withColumn("at", F.col("at").cast("string"))
    steps = [Imputer("mean").fit(people), Encoder("label", "city", handle_unknown="error", literal_categories=2).fit(people), DatetimeEncoder("at").fit(texts)]
    save_steps(spark, steps, str(tmp_path / "steps"))
    mean, encoder, dates = load_steps(spark, str(tmp_path / "steps"))
    assert lines(mean.info(spark)) == lines(steps[0].info(spark))
    assert lines(encoder.dictionary(spark)) == lines(steps[1].dictionary(spark))
    assert [r["value"] for r in encoder.unseen(people.withColumn("city", F.lit("zz"))).collect()] == ["zz"]
    with pytest.raises(ValueError, match="no timestamps"):
        dates.check(texts.withColumn("at", F.lit("soon")))


def test_stream(spark, people, tmp_path):
    """A stored large dictionary joins a stream as it does a table."""
    steps, want = fitted_on(people, [Imputer("mean"), Encoder("label", ["city", "na`me, x"], literal_categories=2), Scaler(columns="age")])
    save_steps(spark, steps, str(tmp_path / "steps"))
    people.write.parquet(str(tmp_path / "in"))
    stream = apply_to_stream(file_stream(spark, str(tmp_path / "in"), people.schema), load_steps(spark, str(tmp_path / "steps")))
    write_available(stream, str(tmp_path / "out")).awaitTermination()
    assert lines(spark.read.parquet(str(tmp_path / "out"))) == lines(want)


def test_empty_train_and_odd_values(spark, tmp_path):
    schema = "a double, s string"
    empty = spark.createDataFrame([], schema)
    steps = [Imputer("mean").fit(empty), Encoder("label").fit(empty), Scaler().fit(empty)]
    save_steps(spark, steps, str(tmp_path / "empty"))
    df = spark.createDataFrame([(None, None), (float("nan"), "\n\u2028\"")], schema)
    for step in load_steps(spark, str(tmp_path / "empty")):
        df = step.transform(df)
    assert df.count() == 2
    odd = spark.createDataFrame([(float("inf"), "\n\u2028\""), (float("inf"), ""), (None, None)], schema)
    steps, want = fitted_on(odd, [Imputer("mode", columns="a"), Encoder("label")])
    save_steps(spark, steps, str(tmp_path / "odd"))
    got = odd
    for step in load_steps(spark, str(tmp_path / "odd")):
        got = step.transform(got)
    assert lines(got) == lines(want)


def test_what_is_refused(spark, people, tmp_path):
    own = Projection(added={"z": F.lit(1)})
    with pytest.raises(ValueError, match="of its own"):
        save_steps(spark, [Encoder("label", "city", literal_categories=1).fit(people), own], str(tmp_path / "own"))
    assert not (tmp_path / "own").exists()
    save_steps(spark, [Scaler().fit(people)], str(tmp_path / "one"))
    with pytest.raises(Exception, match="exist"):
        save_steps(spark, [Scaler().fit(people)], str(tmp_path / "one"))
    (tmp_path / "new" / "head").mkdir(parents=True)
    (tmp_path / "new" / "head" / "part-0.txt").write_text('{"format": "tablewright-steps", "version": 99, "steps": []}')
    with pytest.raises(ValueError, match="version 99"):
        load_steps(spark, str(tmp_path / "new"))
