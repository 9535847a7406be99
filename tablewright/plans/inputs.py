"""Input tables of the queries. Projections are given as text that Spark and SQL both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.split import random_split
from tablewright.splits import Splits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, sf_dir: str, name: str, exprs: list[str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*exprs)


def subquery(name: str, exprs: list[str]) -> str:
    return f"(SELECT {', '.join(exprs)} FROM {name})"


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

#: Line items with gaps in numbers and text.
GAPS = [
    "nullif(l_quantity, 7) AS qty",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price",
    "CASE WHEN l_discount > 0.05 THEN NULL ELSE l_discount END AS disc",
    "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag",
    "l_tax AS tax",
]
GAP_COLUMNS = ["qty", "price", "disc", "flag", "tax"]
GAP_NUMBERS = ["qty", "price", "disc", "tax"]

#: Two strongly related columns, a weak one and a constant.
RELATED = [
    "l_quantity AS qty",
    "l_quantity * 3 + l_tax * 10 AS cost",
    "l_extendedprice AS price",
    "l_discount - l_quantity / 25 AS net",
    "CAST(1 AS DOUBLE) AS flat",
]
RELATED_COLUMNS = ["qty", "cost", "price", "net", "flat"]

#: Binary predictions with nearly unique scores.
BINARY = [
    "CAST(l_quantity + 100 * l_discount > 30 AS INT) AS y_true",
    "CAST(l_quantity > 26 AS INT) AS y_pred",
    "1 - (0.7 * (l_quantity / 50) + 0.3 * (l_extendedprice / 105000)) AS y_prob_0",
    "0.7 * (l_quantity / 50) + 0.3 * (l_extendedprice / 105000) AS y_prob_1",
]
#: Binary predictions whose scores are full of ties.
TIED = [
    "CAST(l_quantity + 100 * l_discount > 30 AS INT) AS y_true",
    "1 - l_discount * 9 AS y_prob_0",
    "l_discount * 9 AS y_prob_1",
]
MULTI = [
    "l_returnflag AS y_true",
    "CASE WHEN l_quantity < 14 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'R' END AS y_pred",
    "l_discount * 9 AS y_prob_A",
    "l_quantity / 51 AS y_prob_N",
    "l_extendedprice / 110000 AS y_prob_R",
]
REGRESSION = ["l_extendedprice AS y_true", "l_quantity * 2000 + 100 AS y_pred"]

SEED = 42
TEST_SIZE, VAL_SIZE = 0.2, 0.1


def hash_sql(key: list[str], seed: int = SEED) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts}) || ':{seed}'), 1, 15) AS BIGINT)"


def part_sql(key: list[str]) -> str:
    """The part a row falls into, as SQL."""
    u = f"({hash_sql(key)} / 1152921504606846976.0::DOUBLE)"
    return (
        f"CASE WHEN {u} < {TEST_SIZE} THEN 'test' WHEN {u} < {TEST_SIZE + VAL_SIZE!r} THEN 'val' ELSE 'train' END"
    )


def split_table(spark: SparkSession, sf_dir: str, name: str, key: list[str], exprs: list[str]) -> Splits:
    """Hold-out parts of a table, then a projection of each."""
    tagged = random_split(table(spark, sf_dir, name), TEST_SIZE, VAL_SIZE, SEED, key).tagged
    return Splits.of(tagged.selectExpr("split", *exprs))


def split_sql(name: str, key: list[str], exprs: list[str]) -> str:
    return f"(SELECT {part_sql(key)} AS split, {', '.join(exprs)} FROM {name})"


def union_sql(blocks: list[str]) -> str:
    return " UNION ALL ".join(blocks)
