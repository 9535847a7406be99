"""Hold-out splits; every query returns the part of each row or the size of each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators.split import random_split, small_classes, stratified_split
from tablewright.plans.inputs import LINE_KEY, hash_sql, part_sql, table
from tablewright.plans.registry import query

ORDER_KEY = ["o_orderkey"]


@query("split_random", f"SELECT o_orderkey, {part_sql(ORDER_KEY)} AS split FROM orders")
def _(spark, sf):
    return random_split(table(spark, sf, "orders"), key="o_orderkey").tagged.select("o_orderkey", "split")


@query(
    "split_random_sizes",
    f"SELECT split, count(*)::BIGINT AS rows, round(avg(l_extendedprice), 4) AS mean_price "
    f"FROM (SELECT {part_sql(LINE_KEY)} AS split, l_extendedprice FROM lineitem) GROUP BY split",
)
def _(spark, sf):
    parts = random_split(table(spark, sf, "lineitem"), key=LINE_KEY).splits()
    return parts.tagged().groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price")
    )


@query(
    "split_random_whole_row",
    "SELECT c_custkey, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.5 THEN 'val' ELSE 'train' END AS split FROM "
    f"(SELECT c_custkey, {hash_sql(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'], 7)} / 1152921504606846976.0::DOUBLE AS u FROM customer)",
)
def _(spark, sf):
    """Without a key the whole row is the key."""
    df = table(spark, sf, "customer")
    return random_split(df, 0.2, 0.3, seed=7).tagged.select("c_custkey", "split")


RANKED = f"SELECT *, row_number() OVER (ORDER BY {hash_sql(ORDER_KEY)}) AS pos, count(*) OVER () AS n FROM orders"


@query(
    "split_random_exact",
    f"""SELECT o_orderkey, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + nv THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, ceil((n - nt) * (0.1::DOUBLE / 0.7::DOUBLE)) AS nv FROM (SELECT *, ceil(n * 0.3::DOUBLE) AS nt FROM ({RANKED})))""",
)
def _(spark, sf):
    df = table(spark, sf, "orders")
    return random_split(df, 0.3, 0.1, key="o_orderkey", exact=True).tagged.select("o_orderkey", "split")


@query(
    "split_sequential",
    """SELECT o_orderkey, CASE WHEN pos <= n - nt - nv THEN 'train' WHEN pos <= n - nt THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, ceil((n - nt) * (0.1::DOUBLE / 0.8::DOUBLE)) AS nv FROM (SELECT *, ceil(n * 0.2::DOUBLE) AS nt
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos, count(*) OVER () AS n FROM orders)))""",
)
def _(spark, sf):
    df = table(spark, sf, "orders")
    return random_split(df, 0.2, 0.1, order_by="o_orderkey").tagged.select("o_orderkey", "split")


@query(
    "split_sequential_nulls",
    """SELECT o_orderkey, CASE WHEN pos <= n - nt - nv THEN 'train' WHEN pos <= n - nt THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, ceil((n - nt) * (0.1::DOUBLE / 0.8::DOUBLE)) AS nv FROM (SELECT *, ceil(n * 0.2::DOUBLE) AS nt
    FROM (SELECT *, row_number() OVER (ORDER BY placed NULLS LAST) AS pos, count(*) OVER () AS n
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS placed FROM orders))))""",
)
def _(spark, sf):
    """Rows without a value come last."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS placed")
    return random_split(df, 0.2, 0.1, order_by="placed").tagged.select("o_orderkey", "split")


@query(
    "split_exact_duplicates",
    """SELECT 'test' AS split, nt::BIGINT AS rows FROM (SELECT ceil(count(*) * 0.2::DOUBLE) AS nt FROM lineitem)
    UNION ALL SELECT 'val', ceil((n - nt) * (0.1::DOUBLE / 0.8::DOUBLE))::BIGINT FROM (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE) AS nt FROM lineitem)
    UNION ALL SELECT 'train', (n - nt - ceil((n - nt) * (0.1::DOUBLE / 0.8::DOUBLE)))::BIGINT FROM (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE) AS nt FROM lineitem)""",
)
def _(spark, sf):
    """Exact sizes although only a few rows differ."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber")
    return random_split(df, 0.2, 0.1, exact=True).tagged.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def by_class_sql(name: str, key: list[str], label: str, test: float, val: float) -> str:
    ranked = (
        f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(key)}) AS pos, "
        f"count(*) OVER (PARTITION BY {label}) AS n FROM {name}"
    )
    nt, nv = f"floor(n * {test}::DOUBLE + 0.5)", f"floor(n * {val}::DOUBLE + 0.5)"
    return (
        f"SELECT {', '.join(key)}, {label}, CASE WHEN pos <= {nt} THEN 'test' WHEN pos <= {nt} + {nv} THEN 'val' "
        f"ELSE 'train' END AS split FROM ({ranked})"
    )


@query("split_stratified", by_class_sql("labels", ["doc_id"], "quality", 0.15, 0.15))
def _(spark, sf):
    df = table(spark, sf, "labels")
    return stratified_split(df, "quality", key="doc_id").tagged.select("doc_id", "quality", "split")


@query(
    "split_stratified_shares",
    f"SELECT l_returnflag, split, count(*)::BIGINT AS rows FROM ({by_class_sql('lineitem', LINE_KEY, 'l_returnflag', 0.15, 0.15)}) GROUP BY ALL",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return (
        stratified_split(df, "l_returnflag", key=LINE_KEY)
        .tagged.groupBy("l_returnflag", "split")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query("split_random_stratified", by_class_sql("orders", ORDER_KEY, "o_orderstatus", 0.2, 0.1))
def _(spark, sf):
    df = table(spark, sf, "orders")
    return random_split(df, key="o_orderkey", stratify="o_orderstatus").tagged.select(
        "o_orderkey", "o_orderstatus", "split"
    )


@query(
    "split_small_classes",
    "SELECT CAST(l_orderkey AS VARCHAR) AS label, count(*)::BIGINT AS count FROM lineitem GROUP BY l_orderkey HAVING count(*) < 3",
)
def _(spark, sf):
    """The check that refuses a stratified split: classes with fewer than three rows."""
    return small_classes(table(spark, sf, "lineitem"), "l_orderkey")
