"""Label, ordinal and one-hot encoding by the categories of the training part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_distinct_names, resolve_columns, string_columns
from tablewright.functions.keep import lookup, persisted, stored
from tablewright.functions.ranking import cut_points, running_totals
from tablewright.functions.stats import column_stats
from tablewright.operators.fitted import Fitted
from tablewright.splits import Splits

METHODS = ("label", "ordinal", "one_hot")
UNKNOWN = ("encode_as_unknown", "error")
#: Categories of a column that are read by the driver; larger dictionaries stay a table.
LITERAL_CATEGORIES = 1_000
#: Dictionaries up to this size become a literal in the projection, which is searched from the front; larger ones a join.
LITERAL_CODES = 48
OUTPUTS = ("columns", "vector")
#: Nulls are spread over this many join keys.
NULL_SALTS = 256


@dataclass(frozen=True)
class Encoder:
    """``label`` and ``ordinal`` number the sorted categories from 0 and give unseen ones -1.

    ``one_hot`` adds a 0/1 column per category, or with ``output="vector"`` one sparse vector column
    ``<column>_onehot`` per column. As columns, more than ``LITERAL_CATEGORIES`` categories of one
    column are refused. Large dictionaries are written once by ``fit`` and joined.
    """

    method: str = "label"
    columns: str | Sequence[str] | None = None
    target: str | None = None
    handle_unknown: str = "encode_as_unknown"
    literal_categories: int = LITERAL_CATEGORIES
    output: str = "columns"

    def fit(self, train: DataFrame) -> FittedEncoder:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; choose one of {METHODS}")
        if self.handle_unknown not in UNKNOWN:
            raise ValueError(f"unknown handle_unknown {self.handle_unknown!r}; choose one of {UNKNOWN}")
        if self.output not in OUTPUTS:
            raise ValueError(f"unknown output {self.output!r}; choose one of {OUTPUTS}")
        require_distinct_names(train)
        names = resolve_columns(train, self.columns) or string_columns(train)
        names = [name for name in names if name != self.target]
        facts = (
            column_stats(
                train,
                {n: col(n).cast("string") for n in names},
                {"present": F.count, "distinct": F.approx_count_distinct, "longest": lambda c: F.max(F.octet_length(c))},
            )
            if names
            else {}
        )
        names = [n for n in names if facts[n]["present"]]
        small = {}
        likely = [n for n in names if facts[n]["distinct"] <= 2 * self.literal_categories]
        hot_vector = self.method == "one_hot" and self.output == "vector"
        if not hot_vector:
            small = _read_categories(train, likely, self.literal_categories)
        if self.method == "one_hot" and not hot_vector and (many := [n for n in names if n not in small]):
            raise ValueError(f"columns {many} have more than {self.literal_categories} categories; use output='vector'")
        # Sized as if every category were as long as the longest, in units of 32 bytes.
        large = {
            n: Dictionary(
                stored(_dictionary(train, n, facts[n]["distinct"]), "dictionary"),
                facts[n]["distinct"] * (1 + facts[n]["longest"] // 32),
            )
            for n in names
            if n not in small
        }
        hot = {}
        if self.method == "one_hot":
            for name, table in large.items():
                hot[name] = OneHotEncoder(
                    inputCol="_code", outputCol=f"{name}_onehot", dropLast=True, handleInvalid="keep"
                ).fit(table.table.select(F.col("code").cast("double").alias("_code")))
        return FittedEncoder(self.method, self.handle_unknown, tuple(names), small, large, hot)


def _read_categories(train: DataFrame, names: list[str], limit: int) -> dict[str, list[str]]:
    """Sorted categories of those columns that have at most ``limit``, by exact count."""
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(n).alias("column_name"), col(n).cast("string").alias("value")) for n in names])
    values = train.select(F.explode(cells).alias("cell")).select("cell.*").where("value is not null").distinct()
    with persisted(values) as held:
        few = [r["column_name"] for r in held.groupBy("column_name").count().where(F.col("count") <= limit).collect()]
        rows = held.where(F.col("column_name").isin(few)).collect() if few else []
    found: dict[str, list[str]] = {n: [] for n in few}
    for row in rows:
        found[row["column_name"]].append(row["value"])
    return {n: sorted(values) for n, values in found.items()}


def _dictionary(train: DataFrame, name: str, n_distinct: int, per_bucket: int | None = None) -> DataFrame:
    """``(value, code)`` of a column with many categories, numbered without a single-task sort."""
    values = train.select(col(name).cast("string").alias("value"))
    keyed = values.where("value is not null").distinct().withColumn("one", F.lit(1).cast("long"))
    cuts = cut_points(values, "value", n_distinct, per_bucket)
    return running_totals(keyed, "value", {"code": "one"}, cuts).select("value", F.col("code").cast("long").alias("code"))


@dataclass(frozen=True)
class Dictionary:
    """``(value, code)`` of one column and an upper estimate of its size."""

    table: DataFrame
    size: int


@dataclass(frozen=True)
class FittedEncoder(Fitted):
    method: str
    handle_unknown: str
    names: tuple[str, ...]
    small: dict[str, list[str]]
    large: dict[str, Dictionary]
    hot: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        names = [n for n in self.names if n in df.columns]
        if self.method == "one_hot":
            return self._one_hot(df, names)
        codes = {n: self._literal_code(n) for n in names if len(self.small.get(n, ())) <= LITERAL_CODES and n in self.small}
        out = df.select(*[codes[c].alias(c) if c in codes else col(c) for c in df.columns])
        for name in names:
            if name not in codes:
                out = self._joined_code(out, name, name)
        return out.select(*[col(c) for c in df.columns])

    def apply(self, splits: Splits) -> Splits:
        if self.handle_unknown == "error":
            self.check(splits)
        return super().apply(splits)

    def check(self, splits: Splits) -> None:
        """Raise on a category that the training part does not have."""
        for part, frame in splits.items():
            if part == "train":
                continue
            found = self.unseen(frame).limit(1).collect()
            if found:
                raise ValueError(f"category {found[0]['value']!r} of column {found[0]['column_name']!r} in {part} is not in train")

    def unseen(self, df: DataFrame) -> DataFrame:
        """``(column_name, value)`` of every category of ``df`` that train does not have."""
        out = df.sparkSession.createDataFrame([], "column_name string, value string")
        small = [n for n in self.names if n in self.small and n in df.columns]
        if small:
            cells = F.array(
                *[
                    F.when(
                        ~col(n).cast("string").isin(*self.small[n]),
                        F.struct(F.lit(n).alias("column_name"), col(n).cast("string").alias("value")),
                    )
                    for n in small
                ]
            )
            strange = df.select(F.explode(cells).alias("cell")).where("cell is not null")
            out = out.unionByName(strange.select("cell.*").distinct())
        for name in self.names:
            if name in self.large and name in df.columns:
                values = df.select(col(name).cast("string").alias("value")).where("value is not null").distinct()
                fresh = values.join(lookup(self.large[name].table, self.large[name].size), "value", "left_anti")
                out = out.unionByName(fresh.select(F.lit(name).alias("column_name"), "value"))
        return out

    def dictionary(self, spark) -> DataFrame:
        """``(column_name, value, code)`` of every encoded column."""
        rows = [(n, v, i) for n, values in self.small.items() for i, v in enumerate(values)]
        out = spark.createDataFrame(rows, "column_name string, value string, code long")
        for name, table in self.large.items():
            out = out.unionByName(table.table.select(F.lit(name).alias("column_name"), "value", "code"))
        return out

    def _table(self, spark: SparkSession, name: str) -> Dictionary:
        if name in self.large:
            return self.large[name]
        rows = [(v, i) for i, v in enumerate(self.small[name])]
        return Dictionary(spark.createDataFrame(rows, "value string, code long"), len(rows))

    def _literal_code(self, name: str) -> Column:
        pairs = [F.lit(x) for i, v in enumerate(self.small[name]) for x in (v, i)]
        code = F.try_element_at(F.create_map(*pairs), F.coalesce(col(name).cast("string"), F.lit("")))
        known = F.when(col(name).isNotNull(), code)
        return F.coalesce(known, F.lit(-1)).cast("long")

    def _joined_code(self, df: DataFrame, name: str, out: str) -> DataFrame:
        """Left join on the value; nulls get one of many stand-in keys so that they do not
        meet in one task, and -1 whatever the join finds."""
        text = col(name).cast("string")
        spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(NULL_SALTS))
        key = F.coalesce(text, F.concat(F.lit("\0null "), spread.cast("string")))
        held = self._table(df.sparkSession, name)
        table = held.table.select(F.col("value").alias("_value"), F.col("code").alias("_found"))
        joined = df.withColumns({"_key": key, "_null": text.isNull()}).join(
            lookup(table, held.size), F.col("_key") == F.col("_value"), "left"
        )
        code = F.when(~F.col("_null"), F.col("_found"))
        return joined.withColumn(out, F.coalesce(code, F.lit(-1)).cast("long")).drop("_key", "_null", "_value", "_found")

    def _one_hot(self, df: DataFrame, names: list[str]) -> DataFrame:
        added = {
            f"{n}_{value}": (col(n).cast("string") == F.lit(value)).cast("long")
            for n in names
            if n in self.small
            for value in self.small[n]
        }
        large = [n for n in names if n in self.large]
        plain = [c for c in df.columns if c not in names or c in large]
        out = df.select(*[col(c) for c in plain], *[e.alias(a) for a, e in added.items()])
        for name in large:
            coded = self._joined_code(out, name, "_raw")
            coded = coded.withColumn("_code", F.col("_raw").cast("double"))
            # A code outside the dictionary becomes the all-zero vector.
            known = coded.withColumn("_code", F.when(F.col("_code") < 0, F.lit(float(2**30))).otherwise(F.col("_code")))
            out = self.hot[name].transform(known).drop("_raw", "_code", name)
        return out
