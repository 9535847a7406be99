"""Column profile, semantic type and role, and the casts that follow from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    DATETIME_TYPES,
    FLOAT_TYPES,
    INTEGER_TYPES,
    NUMERIC_TYPES,
    OPAQUE_TYPES,
    STRING_TYPES,
    as_text,
    col,
    measured,
    missing,
)
from tablewright.functions.keep import spread
from tablewright.functions.sketches import distinct_counts, distinct_sketches
from tablewright.functions.stats import collect_aggregates, local_frame
from tablewright.session import importable

# The words a column name is searched for.
TARGET_WORDS = ("target", "label", "y", "default", "survived", "churn", "class", "outcome", "response")
ID_WORDS = ("id", "index", "row_id", "row_number", "record_id")
DATE_WORDS = ("date", "time", "timestamp")

DROPPED_ROLES = ("ignore", "identifier")
LISTED_VALUES = 20
SAMPLES = 5
CAST_THRESHOLD = 0.9
#: Text accepted as a number; Java's own "1d" and "0x1p3" forms are not.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Ii]nf(inity)?|[Nn]a[Nn])\s*$"

CATALOG_SCHEMA = (
    "position int, column_name string, dtype string, kind string, rows long, present long, "
    "min_value double, max_value double"
)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, NUMERIC_TYPES):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, DATETIME_TYPES):
        return "datetime"
    if isinstance(data_type, STRING_TYPES):
        return "string"
    return "opaque" if isinstance(data_type, OPAQUE_TYPES) else "other"


def has_word(name: Column, words: tuple[str, ...]) -> Column:
    """A keyword as a whole token (``_``, blank or ``-`` separated) or at word boundaries."""
    single = "|".join(re.escape(w) for w in words if "_" not in w)
    every = "|".join(re.escape(w) for w in words)
    return (
        name.isin(*words)
        | name.rlike(rf"(^|[_\s\-])({single})($|[_\s\-])")
        | name.rlike(rf"\b({every})\b")
    )


def _classified(profile: DataFrame) -> DataFrame:
    """Ordered rules, first hit wins; each gives (semantic_type, role, confidence)."""
    name = F.lower(F.trim("column_name"))
    unique, ratio, kind = F.col("unique_count"), F.col("raw_ratio"), F.col("kind")
    two_valued = (kind == "boolean") | (unique == 2)
    named_target = has_word(name, TARGET_WORDS)
    named_date = name.rlike("|".join(DATE_WORDS))
    rules = [
        (kind == "opaque", "unknown", "ignore", 0.0),
        (has_word(name, ID_WORDS) & (ratio > 0.9), "identifier", "identifier", 0.85),
        (named_target & two_valued, "binary", "target", 0.7),
        (named_target, "target", "target", 0.85),
        ((kind == "datetime") | named_date, "datetime", "metadata", 0.9),
        (two_valued, "binary", "feature", 0.85),
        ((kind == "string") & (ratio > 0.9), "identifier", "identifier", 0.75),
        (kind == "string", "categorical", "feature", 0.8),
        ((kind == "numeric") & (unique <= 15), "categorical", "feature", 0.7),
        (kind == "numeric", "continuous", "feature", 0.8),
    ]
    outcome = F.struct(
        F.lit("continuous").alias("semantic_type"), F.lit("feature").alias("role"), F.lit(0.5).alias("confidence")
    )
    for test, semantic, role, confidence in reversed(rules):
        hit = F.struct(
            F.lit(semantic).alias("semantic_type"), F.lit(role).alias("role"), F.lit(confidence).alias("confidence")
        )
        outcome = F.when(test, hit).otherwise(outcome)
    return profile.withColumn("guess", outcome).select("*", "guess.*").drop("guess")


def _reasoning() -> Column:
    head = F.concat(F.col("column_name"), F.lit(" ("), F.col("dtype"), F.lit("): "))
    unique = F.concat(F.col("unique_count").cast("string"), F.lit(" distinct"))
    listing = F.concat(F.lit("["), F.concat_ws(", ", F.coalesce("all_values", "samples")), F.lit("]"))
    semantic = F.col("semantic_type")
    detail = (
        F.when((semantic == "binary") & (F.col("role") == "target"), F.concat(F.lit("two values "), listing, F.lit(", named like a target; confirm")))
        .when(semantic == "binary", F.concat(F.lit("two values "), listing))
        .when((semantic == "categorical") & (F.col("unique_count") <= LISTED_VALUES), F.concat(unique, F.lit(" "), listing))
        .when(
            semantic == "continuous",
            F.concat(
                unique, F.lit(", range "),
                F.coalesce(F.col("min_value").cast("string"), F.lit("?")), F.lit(" to "),
                F.coalesce(F.col("max_value").cast("string"), F.lit("?")),
            ),
        )
        .when(semantic == "identifier", F.concat(unique, F.lit(", ratio "), F.col("unique_ratio").cast("string")))
        .when(semantic == "unknown", F.lit("type not supported"))
        .otherwise(unique)
    )
    return F.concat(head, detail, F.lit(" -> "), semantic, F.lit(" "), F.col("role"))


def _cells(df: DataFrame) -> DataFrame:
    """Every column as what its values sort and print by: whole numbers, reals, or text."""
    cells = []
    for i, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, INTEGER_TYPES):
            cell = col(field.name).cast("long")
        elif isinstance(field.dataType, FLOAT_TYPES):
            cell = measured(df, field.name) + F.lit(0.0)
        else:
            cell = as_text(df, field.name)
        cells.append(cell.alias(f"c{i}"))
    return df.select(*cells)


def unique_counts(df: DataFrame) -> DataFrame:
    """``(column_name, unique_count)``: exact for numbers; exact but for collisions of 128-bit hashes for all else.

    A cell is sent as its column and one or two 64-bit hashes, combined before the shuffle; the length of texts does not matter.
    Spark's hash of eight bytes is one to one, so a number needs no second hash to be told from all others.
    """
    cells = _cells(df)
    names = F.array(*[F.lit(c) for c in df.columns])
    numbers = [isinstance(f.dataType, (T.LongType, T.DoubleType)) for f in cells.schema.fields]
    counts = []
    for number in (True, False):
        hashes = []
        for i, c in enumerate(cells.columns):
            if numbers[i] == number:
                second = [] if number else [F.xxhash64(F.lit(i + 1), c).alias("g")]
                hashes.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("id"), F.xxhash64(c).alias("h"), *second)))
        if hashes:
            single = cells.select(F.explode(F.array(*hashes)).alias("cell")).where("cell is not null").select("cell.*").distinct()
            counts.append(single.groupBy("id").agg(F.count(F.lit(1)).alias("unique_count")))
    return reduce(DataFrame.unionByName, counts).select(names[F.col("id")].alias("column_name"), "unique_count")


def smallest_values(df: DataFrame, limit: int) -> DataFrame:
    """``(column_name, value, rank)``: the ``limit`` smallest distinct values of each column.

    A mergeable aggregate: each task keeps its own ``limit`` smallest per column, and only those are sent on.
    """
    importable(df.sparkSession)
    cells = _cells(df)
    decimals = [isinstance(f.dataType, T.DecimalType) for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array | None] = [None] * len(decimals)
        for batch in batches:
            for i, decimal in enumerate(decimals):
                values = pc.drop_null(batch.column(i))
                if len(values):
                    held[i] = smallest(values, held[i], limit, decimal)
        ids, whole, real, text = [], [], [], []
        for i, values in enumerate(held):
            for value in [] if values is None else values.to_pylist():
                ids.append(i)
                whole.append(value if isinstance(value, int) else None)
                real.append(value if isinstance(value, float) else None)
                text.append(value if isinstance(value, str) else None)
        columns = [pa.array(ids, pa.int32()), pa.array(whole, pa.int64()), pa.array(real, pa.float64()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "whole", "real", "text"])

    firsts = cells.mapInArrow(run, "id int, whole long, real double, text string").distinct()
    names = F.array(*[F.lit(c) for c in df.columns])
    is_decimal = F.array(*[F.lit(d) for d in decimals])
    told = firsts.select(
        names[F.col("id")].alias("column_name"),
        F.coalesce(F.col("whole").cast("string"), F.col("real").cast("string"), F.col("text")).alias("value"),
        "whole",
        F.coalesce("real", F.when(is_decimal[F.col("id")], F.col("text").try_cast("double"))).alias("number"),
    )
    order = Window.partitionBy("column_name").orderBy("whole", "number", "value")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("column_name", "value", "rank")


def smallest(values: pa.Array, before: pa.Array | None, limit: int, decimal: bool = False) -> pa.Array:
    """The ``limit`` smallest distinct values of an Arrow array and those found before; decimals come as text."""
    if before is not None and len(before) == limit and not decimal:
        values = values.filter(pc.less(values, before[-1]))
        if not len(values):
            return before
    single = pc.unique(values if before is None else pa.concat_arrays([before, values]))
    if decimal:
        keyed = pa.table({"n": pc.cast(single, pa.float64()), "v": single})
        order = pc.sort_indices(keyed, sort_keys=[("n", "ascending"), ("v", "ascending")])
    else:
        order = pc.sort_indices(single)
    return single.take(order[:limit])


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: counts, samples, semantic type, role and the reason for them.

    Samples are the smallest values. Three passes: one wide aggregate for counts and ranges, one grouped count of hashes for
    distinct values, one of bounded lists for samples. With ``approx`` distinct values are estimated by mergeable sketches
    (``functions/sketches.py``, standard error 0.8 %), so nothing of the size of the data is shuffled; counts up to
    ``LISTED_VALUES`` are exact all the same.
    """
    aggregates: dict = {"rows": F.count(F.lit(1))}
    for field in df.schema.fields:
        aggregates["present", field.name] = F.count_if(~missing(df, field.name))
        if isinstance(field.dataType, NUMERIC_TYPES):
            aggregates["min", field.name] = F.min(measured(df, field.name))
            aggregates["max", field.name] = F.max(measured(df, field.name))
    found = collect_aggregates(df, aggregates)
    catalog = local_frame(
        df.sparkSession,
        [
            (
                i, f.name, f.dataType.simpleString(), _kind(f.dataType), found["rows"],
                found["present", f.name], found.get(("min", f.name)), found.get(("max", f.name)),
            )
            for i, f in enumerate(df.schema.fields)
        ],
        CATALOG_SCHEMA,
    )
    df = spread(df)
    # At most LISTED_VALUES values per column, and one more to know whether that is all.
    listed = smallest_values(df, LISTED_VALUES + 1)
    first = listed.groupBy("column_name").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "value"))), 1, LISTED_VALUES)["value"].alias("firsts"),
        F.count(F.lit(1)).alias("listed"),
    )
    uniques = distinct_counts(distinct_sketches(df)) if approx else unique_counts(df)
    if approx:
        few = F.when(F.col("listed") <= LISTED_VALUES, F.col("listed"))
        uniques = uniques.join(first, "column_name", "left").select("column_name", F.coalesce(few, "unique_count").alias("unique_count"))
    first = first.drop("listed")
    joined = catalog.join(uniques, "column_name", "left").join(first, "column_name", "left")
    unique = F.coalesce("unique_count", F.lit(0))
    base = joined.withColumns(
        {
            "unique_count": unique,
            "raw_ratio": F.coalesce(F.try_divide(unique, F.col("rows")), F.lit(0.0)),
            "raw_null": F.coalesce(F.try_divide(F.col("rows") - F.col("present"), F.col("rows")), F.lit(0.0)),
            "samples": F.slice(F.coalesce("firsts", F.array().cast("array<string>")), 1, SAMPLES),
            "all_values": F.when(unique <= LISTED_VALUES, F.coalesce("firsts", F.array().cast("array<string>"))),
        }
    ).withColumns(
        {
            "unique_ratio": F.round("raw_ratio", 4),
            "null_pct": F.round("raw_null", 4),
            "nullable": F.col("raw_null") > 0,
        }
    )
    return (
        _classified(base)
        .withColumn("reasoning", _reasoning())
        .select(
            "position", "column_name", "dtype", "semantic_type", "role", "confidence", "nullable", "unique_count",
            "unique_ratio", "null_pct", "min_value", "max_value", "samples", "all_values", "reasoning",
        )
    )


def profile_rows(profile_df: DataFrame) -> list:
    """A profile has one row per column of the table, so it is read whole."""
    return sorted(profile_df.select("position", "column_name", "dtype", "semantic_type", "role").collect())


def drop_by_role(df: DataFrame, profile_df: DataFrame) -> DataFrame:
    """Remove columns whose role is ignore or identifier."""
    out = [r["column_name"] for r in profile_rows(profile_df) if r["role"] in DROPPED_ROLES]
    return df.select(*[col(c) for c in df.columns if c not in out])


def as_number(df: DataFrame, name: str) -> Column:
    """A text column read as a number, null where it is none."""
    text = col(name)
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def cast_by_profile(df: DataFrame, profile_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop by role, cast numeric-looking text; returns the new table and a status per column.

    The input is never rewritten: after editing a profile, apply it to the source again.
    """
    rows = [r for r in profile_rows(profile_df) if r["column_name"] in df.columns]
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, STRING_TYPES)}
    dropped = [r["column_name"] for r in rows if r["role"] in DROPPED_ROLES]
    tried = [
        r["column_name"] for r in rows
        if r["column_name"] not in dropped and r["column_name"] in texts and r["semantic_type"] in ("continuous", "binary")
    ]
    aggregates: dict = {}
    for name in tried:
        number = as_number(df, name)
        aggregates["present", name] = F.count(col(name))
        aggregates["parsed", name] = F.count_if(number.isNotNull() & ~F.isnan(number))
    found = collect_aggregates(df, aggregates) if aggregates else {}

    status, casts = [], []
    for r in rows:
        name = r["column_name"]
        if name in dropped:
            status.append((name, "dropped", None, None, f"role is {r['role']}"))
        elif name not in texts:
            status.append((name, "skipped", None, None, "already typed"))
        elif name not in tried:
            status.append((name, "skipped", None, None, f"{r['semantic_type']} stays text"))
        else:
            rate = found["parsed", name] / max(found["present", name], 1)
            if rate >= CAST_THRESHOLD:
                casts.append(name)
                status.append((name, "cast", "double", rate, "numeric text"))
            else:
                status.append((name, "failed", None, rate, "too few values are numeric"))
    kept = [
        as_number(df, c).alias(c) if c in casts else col(c) for c in df.columns if c not in dropped
    ]
    table = local_frame(
        df.sparkSession, status, "column_name string, status string, to string, success_rate double, reason string"
    ).withColumn("success_rate", F.round("success_rate", 4))
    return df.select(*kept), table
