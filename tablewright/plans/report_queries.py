"""Correlation, distribution, missing-value, outlier, profile and suggestion queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablewright.functions.keep import persisted
from tablewright.operators.correlation import correlation
from tablewright.operators.distribution import distribution
from tablewright.operators.missing import missing_values
from tablewright.operators.outliers import outliers
from tablewright.operators.schema import cast_by_profile, drop_by_role, profile
from tablewright.operators.suggest import (
    Suggestions,
    correlation_section,
    distribution_section,
    missing_section,
    outlier_section,
)
from tablewright.plans.inputs import (
    GAP_COLUMNS,
    GAP_NUMBERS,
    GAPS,
    MEASURES,
    RELATED,
    RELATED_COLUMNS,
    project,
    subquery,
    table,
    union_sql,
)
from tablewright.plans.registry import query

GAP_SQL = subquery("lineitem", GAPS)
RELATED_SQL = subquery("lineitem", RELATED)


# --- correlation -----------------------------------------------------------------------


def _r(x: str, y: str) -> str:
    """Pearson r, null where a side is constant."""
    return (
        f"CASE WHEN regr_sxx({y}, {x}) > 0 AND regr_syy({y}, {x}) > 0 "
        f"THEN regr_sxy({y}, {x}) / sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})) END"
    )


def pearson_sql(source: str, names: list[str]) -> str:
    return union_sql(
        [
            f"SELECT 'pearson' AS method, '{a}' AS a, '{b}' AS b, round({_r(a, b)}, 6) + 0.0 AS r FROM {source}"
            for a, b in combinations(names, 2)
        ]
    )


def spearman_sql(source: str, names: list[str]) -> str:
    def pair(a: str, b: str) -> str:
        ranks = ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r{i}"
            for i, c in enumerate((a, b))
        )
        return (
            f"SELECT 'spearman' AS method, '{a}' AS a, '{b}' AS b, round({_r('r0', 'r1')}, 6) + 0.0 AS r "
            f"FROM (SELECT {ranks} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        )

    return union_sql([pair(a, b) for a, b in combinations(names, 2)])


def pairs_sql(body: str) -> str:
    return f"SELECT method, a, b, r, abs(r) AS abs_r, abs(r) > 0.8 AS high FROM ({body})"


@query("correlation_pearson", pairs_sql(pearson_sql(RELATED_SQL, RELATED_COLUMNS)))
def _(spark, sf):
    return correlation(project(spark, sf, "lineitem", RELATED)).ordered()


@query("correlation_pearson_gaps", pairs_sql(pearson_sql(GAP_SQL, GAP_NUMBERS)))
def _(spark, sf):
    return correlation(project(spark, sf, "lineitem", GAPS)).pairs


@query("correlation_spearman", pairs_sql(spearman_sql("lineitem", MEASURES)))
def _(spark, sf):
    return correlation(table(spark, sf, "lineitem"), "spearman", columns=MEASURES).pairs


@query("correlation_spearman_gaps", pairs_sql(spearman_sql(GAP_SQL, GAP_NUMBERS)))
def _(spark, sf):
    return correlation(project(spark, sf, "lineitem", GAPS), "spearman").pairs


@query(
    "correlation_both",
    pairs_sql(
        pearson_sql("part", ["p_partkey", "p_size", "p_retailprice"])
        + " UNION ALL "
        + spearman_sql("part", ["p_partkey", "p_size", "p_retailprice"])
    ),
)
def _(spark, sf):
    return correlation(table(spark, sf, "part"), "both").pairs


@query(
    "correlation_matrix",
    f"WITH up AS ({pearson_sql('lineitem', MEASURES)}) "
    "SELECT method, a AS row, b AS col, r FROM up UNION ALL SELECT method, b AS row, a AS col, r FROM up UNION ALL "
    + union_sql([f"SELECT 'pearson' AS method, '{c}' AS row, '{c}' AS col, 1.0::DOUBLE AS r" for c in MEASURES]),
)
def _(spark, sf):
    return correlation(table(spark, sf, "lineitem"), columns=",".join(MEASURES)).matrix()


@query(
    "correlation_high_pairs",
    f"SELECT 'high_correlation' AS type, a, b, r FROM ({pearson_sql(RELATED_SQL, RELATED_COLUMNS)}) WHERE abs(r) > 0.8",
)
def _(spark, sf):
    return correlation(project(spark, sf, "lineitem", RELATED)).flags()


@query(
    "correlation_target",
    "SELECT method, CASE WHEN a = 'price' THEN b ELSE a END AS feature, r "
    f"FROM ({pearson_sql(RELATED_SQL, RELATED_COLUMNS)}) WHERE a = 'price' OR b = 'price'",
)
def _(spark, sf):
    return correlation(project(spark, sf, "lineitem", RELATED), target="price").target_ranking()


@query(
    "correlation_summary",
    f"SELECT 5::BIGINT AS numeric_columns, count(*)::BIGINT AS total_pairs, "
    f"count(*) FILTER (abs(r) > 0.8)::BIGINT AS high_correlation_pairs FROM ({pearson_sql(RELATED_SQL, RELATED_COLUMNS)})",
)
def _(spark, sf):
    return correlation(project(spark, sf, "lineitem", RELATED)).summary()


# --- distribution ----------------------------------------------------------------------


def numeric_sql(source: str, names: list[str]) -> str:
    def one(c: str) -> str:
        v = f"CAST({c} AS DOUBLE)"
        shape = {
            "mean": f"avg({v})", "median": f"quantile_cont({v}, 0.5)", "std": f"stddev_samp({v})",
            "min": f"min({v})", "max": f"max({v})",
            "skewness": f"CASE WHEN stddev_samp({v}) = 0 THEN 0 ELSE skewness({v}) END",
            "kurtosis": f"CASE WHEN stddev_samp({v}) = 0 THEN 0 ELSE kurtosis({v}) END",
            "q25": f"quantile_cont({v}, 0.25)", "q50": f"quantile_cont({v}, 0.5)", "q75": f"quantile_cont({v}, 0.75)",
        }
        cols = ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in shape.items())
        return f"SELECT '{c}' AS column_name, count({c})::BIGINT AS count, {cols} FROM {source}"

    return union_sql([one(c) for c in names])


SKEW_FLAG = (
    "CASE WHEN abs(skewness) >= 1 THEN 'strong_' WHEN abs(skewness) >= 0.5 THEN 'moderate_' END "
    "|| CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END"
)


def profiled_sql(source: str, names: list[str]) -> str:
    return f"SELECT *, {SKEW_FLAG} AS skew_flag FROM ({numeric_sql(source, names)})"


@query("distribution_numeric", profiled_sql("lineitem", MEASURES))
def _(spark, sf):
    return distribution(table(spark, sf, "lineitem"), columns=MEASURES).numeric()


@query("distribution_numeric_gaps", profiled_sql(GAP_SQL, GAP_NUMBERS))
def _(spark, sf):
    return distribution(project(spark, sf, "lineitem", GAPS)).numeric()


def histogram_sql(source: str, names: list[str]) -> str:
    def one(c: str) -> str:
        v = f"CAST({c} AS DOUBLE)"
        return f"""
        (WITH ends AS (
            SELECT CASE WHEN min({v}) = max({v}) THEN min({v}) - 0.5 ELSE min({v}) END AS mn,
                   CASE WHEN min({v}) = max({v}) THEN max({v}) + 0.5 ELSE max({v}) END AS mx FROM {source}),
        bins AS (SELECT i AS bin, i * ((mx - mn) / 10.0::DOUBLE) + mn AS lo,
                        CASE WHEN i = 9 THEN mx ELSE (i + 1) * ((mx - mn) / 10.0::DOUBLE) + mn END AS hi
                 FROM ends, range(10) AS r(i))
        SELECT '{c}' AS column_name, bin::BIGINT AS bin, round(lo, 4) + 0.0 AS lo, round(hi, 4) + 0.0 AS hi,
               (SELECT count(*) FROM {source} WHERE {v} >= lo AND ({v} < hi OR (bin = 9 AND {v} <= hi)))::BIGINT AS count
        FROM bins)"""

    return union_sql([one(c) for c in names])


@query("distribution_histogram", histogram_sql("lineitem", MEASURES))
def _(spark, sf):
    return distribution(table(spark, sf, "lineitem"), columns=MEASURES).histogram()


@query("distribution_histogram_constant", histogram_sql(RELATED_SQL, ["flat", "net"]))
def _(spark, sf):
    return distribution(project(spark, sf, "lineitem", RELATED), columns="flat,net").histogram()


def counts_sql(source: str, names: list[str]) -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*)::BIGINT AS count FROM {source} "
            f"WHERE {c} IS NOT NULL GROUP BY ALL"
            for c in names
        ]
    )


ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
PART_TEXTS = ["p_name", "p_brand", "p_type"]


@query(
    "distribution_categorical",
    f"SELECT column_name, sum(count)::BIGINT AS count, count(*)::BIGINT AS cardinality, count(*) > 20 AS high_cardinality "
    f"FROM ({counts_sql('part', PART_TEXTS)}) GROUP BY column_name",
)
def _(spark, sf):
    return distribution(table(spark, sf, "part")).categorical()


PART_SIZES = "(SELECT 'size' AS column_name, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'price', p_retailprice FROM part)"


@query(
    "distribution_approx",
    f"""SELECT column_name, count(v) AS count, round(avg(v), 4) AS mean, {", ".join(f"round(4 * avg((v <= q{i})::INT))::BIGINT AS quarter{i}" for i in (1, 2, 3))}
        FROM {PART_SIZES} JOIN (SELECT column_name, {", ".join(f"quantile_cont(v, {i / 4}) AS q{i}" for i in (1, 2, 3))}
        FROM {PART_SIZES} GROUP BY column_name) USING (column_name) GROUP BY column_name""",
)
def _(spark, sf):
    """Quartiles from sketches, compared by the quarters of the rows that lie at or below them."""
    df = project(spark, sf, "part", ["CAST(p_size AS DOUBLE) AS size", "p_retailprice AS price"])
    found = distribution(df, approx=True).numeric().select("column_name", "count", "mean", "q25", "q50", "q75")
    cells = df.selectExpr("stack(2, 'size', size, 'price', price) AS (column_name, v)").join(found, "column_name")
    quarters = [f"round(4 * avg(CAST(v <= q{q} AS INT))) AS quarter{i}" for i, q in ((1, 25), (2, 50), (3, 75))]
    shares = cells.groupBy("column_name", "count", "mean").agg(*[F.expr(q) for q in quarters])
    return shares.selectExpr("column_name", "count", "mean", *[f"CAST(quarter{i} AS BIGINT) AS quarter{i}" for i in (1, 2, 3)])


def top_sql(source: str, names: list[str]) -> str:
    return (
        f"SELECT column_name, rank, value, count, round(count / (SELECT count(*) FROM {source})::DOUBLE, 4) AS pct FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value)::BIGINT AS rank "
        f"FROM ({counts_sql(source, names)})) WHERE rank <= 10"
    )


@query("distribution_top_values", top_sql("part", PART_TEXTS))
def _(spark, sf):
    return distribution(table(spark, sf, "part")).top_values()


@query(
    "distribution_top_values_approx",
    f"SELECT column_name, rank, value, count, pct FROM ({top_sql('part', ['p_brand', 'p_type'])})",
)
def _(spark, sf):
    """Frequent values from a sketch that follows more values than the columns have, so their counts are exact."""
    return distribution(table(spark, sf, "part"), columns="p_brand,p_type", approx=True).top_values()


@query(
    "distribution_categorical_approx",
    f"SELECT column_name, sum(count)::BIGINT AS count, round(count(*) / sum(count), 1)::DOUBLE AS share, count(*) > 20 AS high_cardinality "
    f"FROM ({counts_sql('customer', ['c_name', 'c_mktsegment'])}) GROUP BY column_name",
)
def _(spark, sf):
    found = distribution(table(spark, sf, "customer"), approx=True).categorical()
    return found.selectExpr("column_name", "count", "round(cardinality / count, 1) AS share", "high_cardinality")


@query("distribution_top_values_unique", top_sql("customer", ["c_name", "c_mktsegment"]))
def _(spark, sf):
    return distribution(table(spark, sf, "customer")).top_values()


@query(
    "distribution_target_balance",
    "SELECT CAST(quality AS VARCHAR) AS value, count(*)::BIGINT AS count, "
    "round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 4) AS pct FROM labels GROUP BY quality",
)
def _(spark, sf):
    return distribution(table(spark, sf, "labels"), target="quality").target_balance()


@query(
    "distribution_target_imbalance",
    "SELECT count(*)::BIGINT AS classes, round(max(pct) / min(pct), 4) AS ratio, "
    "count(*) >= 2 AND max(pct) / min(pct) > 3 AS imbalanced "
    "FROM (SELECT round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 4) AS pct FROM labels GROUP BY toxic)",
)
def _(spark, sf):
    return distribution(table(spark, sf, "labels"), target="toxic").target_imbalance()


@query(
    "distribution_target_regression",
    f"SELECT column_name AS target, mean, median, std, min, max FROM ({numeric_sql('orders', ['o_totalprice'])})",
)
def _(spark, sf):
    report = distribution(table(spark, sf, "orders"), target="o_totalprice")
    if report.target_is_classes():
        raise ValueError("o_totalprice should be reported as a distribution")
    return report.target_distribution()


@query(
    "distribution_summary",
    "SELECT count(*)::BIGINT AS total_rows, 6::BIGINT AS total_columns, 3::BIGINT AS numeric_count, "
    "3::BIGINT AS categorical_count FROM orders",
)
def _(spark, sf):
    return distribution(table(spark, sf, "orders")).summary()


@query(
    "distribution_flags",
    f"""SELECT column_name, 'skewed' AS type, skewness AS value
    FROM ({profiled_sql('events', ['event_id', 'user_id', 'value'])}) WHERE skew_flag IS NOT NULL
    UNION ALL SELECT column_name, 'high_cardinality' AS type, count(*)::DOUBLE AS value
    FROM ({counts_sql('events', ['ts', 'event_type', 'props'])}) GROUP BY column_name HAVING count(*) > 20""",
)
def _(spark, sf):
    return distribution(table(spark, sf, "events")).flags()


# --- missing ---------------------------------------------------------------------------


def gaps_per_column(source: str, names: list[str]) -> str:
    counted = union_sql(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, count(*) AS total FROM {source}"
            for c in names
        ]
    )
    return f"""SELECT column_name, missing_count::BIGINT AS missing_count, missing_pct,
        CASE WHEN missing_pct > 0.3 THEN 'high' WHEN missing_pct >= 0.05 THEN 'medium' ELSE 'low' END AS severity,
        (total - missing_count)::BIGINT AS present_count,
        CASE WHEN missing_pct > 0.3 THEN 'critical_missing' WHEN missing_pct >= 0.05 THEN 'high_missing' END AS flag
        FROM (SELECT *, round(missing_count / total::DOUBLE, 4) AS missing_pct FROM ({counted})) WHERE missing_count > 0"""


@query("missing_columns", gaps_per_column(GAP_SQL, GAP_COLUMNS))
def _(spark, sf):
    return missing_values(project(spark, sf, "lineitem", GAPS)).columns()


@query(
    "missing_flags",
    f"SELECT column_name, flag AS type, missing_pct FROM ({gaps_per_column(GAP_SQL, GAP_COLUMNS)}) WHERE flag IS NOT NULL",
)
def _(spark, sf):
    return missing_values(project(spark, sf, "lineitem", GAPS)).flags()


@query(
    "missing_summary",
    f"""SELECT n::BIGINT AS total_rows, 5::BIGINT AS total_columns, gaps::BIGINT AS total_missing_cells,
        (n * 5)::BIGINT AS total_cells, whole::BIGINT AS complete_rows, 1::BIGINT AS no_missing_count,
        round(gaps / (n * 5)::DOUBLE, 4) AS overall_missing_pct, round(whole / n::DOUBLE, 4) AS complete_rows_pct
    FROM (SELECT count(*) AS n, {' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in GAP_COLUMNS)} AS gaps,
        count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in GAP_COLUMNS)}) AS whole FROM {GAP_SQL})""",
)
def _(spark, sf):
    return missing_values(project(spark, sf, "lineitem", GAPS)).summary()


# --- outliers --------------------------------------------------------------------------

EVENT_VALUES = ["value AS v", "CAST(user_id AS DOUBLE) AS u", "CASE WHEN value > 100 THEN value * 50 ELSE value END AS w"]
EVENT_SQL = subquery("events", EVENT_VALUES)
OUTLIER_NAMES = ["v", "u", "w"]


def outlier_facts(source: str, c: str) -> str:
    return f"""(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3,
        avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS mn, max({c}) AS mx, count(*) AS n FROM {source})"""


def mask_sql(c: str, method: str) -> str:
    fence = f"({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
    z = f"(std > 0 AND abs(({c} - mean) / std) > 3)"
    return {"iqr": fence, "zscore": z, "both": f"({fence} OR {z})"}[method]


def outlier_sql(source: str, names: list[str], method: str) -> str:
    quart, zed = method in ("iqr", "both"), method in ("zscore", "both")

    def shown(expr: str, on: bool) -> str:
        return f"round({expr}, 4) + 0.0" if on else "NULL::DOUBLE"

    def one(c: str) -> str:
        far = "greatest(0, (mx - q3) / (q3 - q1), (q1 - mn) / (q3 - q1))"
        iqrs = f"CASE WHEN q3 > q1 THEN {far} END" if quart else "NULL::DOUBLE"
        return f"""SELECT '{c}' AS column_name, {shown('q1', quart)} AS q1, {shown('q3', quart)} AS q3,
            {shown('q3 - q1', quart)} AS iqr, {shown('q1 - 1.5 * (q3 - q1)', quart)} AS lower_fence,
            {shown('q3 + 1.5 * (q3 - q1)', quart)} AS upper_fence, {shown('mean', zed)} AS mean, {shown('std', zed)} AS std,
            {shown('greatest(mx - mean, mean - mn) / std', zed)} AS z_max, k::BIGINT AS outlier_count,
            round(k / n::DOUBLE, 4) AS outlier_pct, mn AS min_value, mx AS max_value,
            round(k / n::DOUBLE, 4) >= 0.01 AS high_outlier_rate,
            coalesce(k > 0 AND {iqrs} > 5, false) AS extreme_outlier, round({iqrs}, 1) AS max_iqrs
            FROM {outlier_facts(source, c)} f,
            (SELECT count(*) AS k FROM {source}, {outlier_facts(source, c)} WHERE {mask_sql(c, method)})"""

    return union_sql([one(c) for c in names])


for _method in ("iqr", "zscore", "both"):

    @query(f"outliers_{_method}", outlier_sql(EVENT_SQL, OUTLIER_NAMES, _method))
    def _(spark, sf, method=_method):
        return outliers(project(spark, sf, "events", EVENT_VALUES), method).columns()


@query(
    "outliers_extremes",
    union_sql(
        [
            f"""SELECT '{c}' AS column_name, rank, value FROM (
            SELECT row_number() OVER (ORDER BY abs({c} - med) DESC, {c})::BIGINT AS rank, {c} AS value
            FROM {EVENT_SQL}, {outlier_facts(EVENT_SQL, c)} WHERE {mask_sql(c, 'both')}) WHERE rank <= 5"""
            for c in OUTLIER_NAMES
        ]
    ),
)
def _(spark, sf):
    return outliers(project(spark, sf, "events", EVENT_VALUES)).extremes()


@query(
    "outliers_summary",
    f"""SELECT (SELECT count(*) FROM events)::BIGINT AS total_rows, 3::BIGINT AS numeric_columns,
    count(*) FILTER (outlier_count > 0)::BIGINT AS columns_with_outliers, sum(outlier_count)::BIGINT AS total_outlier_cells
    FROM ({outlier_sql(EVENT_SQL, OUTLIER_NAMES, 'both')})""",
)
def _(spark, sf):
    return outliers(project(spark, sf, "events", EVENT_VALUES)).summary()


@query(
    "outliers_flags",
    f"""WITH t AS ({outlier_sql(EVENT_SQL, OUTLIER_NAMES, 'iqr')})
    SELECT column_name, 'high_outlier_rate' AS type, outlier_pct AS value FROM t WHERE high_outlier_rate
    UNION ALL SELECT column_name, 'extreme_outlier' AS type, max_iqrs AS value FROM t WHERE extreme_outlier""",
)
def _(spark, sf):
    return outliers(project(spark, sf, "events", EVENT_VALUES), "iqr").flags()


# --- profile and cast ------------------------------------------------------------------

#: A table that meets every classification rule.
MIXED = [
    "l_orderkey * 10 + l_linenumber AS line_id",
    "l_partkey * 100000 + l_suppkey AS pair_index",
    "CAST(l_quantity > 25 AS INT) AS label",
    "l_extendedprice AS response",
    "l_shipdate AS shipped",
    "CAST(l_quantity AS VARCHAR(20)) AS lifetime",
    "l_linestatus AS status",
    "l_returnflag AS flag",
    "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS code",
    "CAST(l_extendedprice AS VARCHAR(20)) AS price_text",
    "l_linenumber AS line_no",
    "nullif(l_discount, 0.05) AS disc",
    "l_extendedprice AS price",
    "l_tax > 0.04 AS taxed",
]
MIXED_TYPES = {
    "line_id": ("bigint", "numeric"), "pair_index": ("bigint", "numeric"), "label": ("int", "numeric"),
    "response": ("double", "numeric"), "shipped": ("timestamp_ntz", "datetime"), "lifetime": ("varchar(20)", "string"),
    "status": ("string", "string"), "flag": ("string", "string"), "code": ("string", "string"),
    "price_text": ("varchar(20)", "string"), "line_no": ("int", "numeric"), "disc": ("double", "numeric"),
    "price": ("double", "numeric"), "taxed": ("boolean", "boolean"),
}
MIXED_SQL = subquery("lineitem", MIXED)


def profile_sql(source: str, types: dict[str, tuple[str, str]]) -> str:
    def one(i: int, c: str) -> str:
        kind = types[c][1]
        ends = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if kind == "numeric" else ("NULL::DOUBLE",) * 2
        return f"""SELECT {i} AS position, '{c}' AS column_name, '{types[c][0].replace("varchar(20)", "string")}' AS dtype, '{kind}' AS kind,
            count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS u, {ends[0]} AS min_value, {ends[1]} AS max_value FROM {source}"""

    facts = union_sql([one(i, c) for i, c in enumerate(types)])
    target = r"regexp_matches(column_name, '(^|[_\s\-])(target|label|y|default|survived|churn|class|outcome|response)($|[_\s\-])')"
    ident = r"regexp_matches(column_name, '(^|[_\s\-])(id|index)($|[_\s\-])')"
    ratio = "u / n::DOUBLE"
    rules = [
        (f"{ident} AND {ratio} > 0.9", "identifier", "identifier", 0.85),
        (f"{target} AND (kind = 'boolean' OR u = 2)", "binary", "target", 0.7),
        (target, "target", "target", 0.85),
        ("kind = 'datetime' OR column_name LIKE '%date%' OR column_name LIKE '%time%'", "datetime", "metadata", 0.9),
        ("kind = 'boolean' OR u = 2", "binary", "feature", 0.85),
        (f"kind = 'string' AND {ratio} > 0.9", "identifier", "identifier", 0.75),
        ("kind = 'string'", "categorical", "feature", 0.8),
        ("u <= 15", "categorical", "feature", 0.7),
    ]

    def case(at: int, last: str) -> str:
        return "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[at]}'" for r in rules) + f" ELSE '{last}' END"

    return f"""SELECT position, column_name, dtype, {case(1, 'continuous')} AS semantic_type, {case(2, 'feature')} AS role,
        CAST({case(3, '0.8')} AS DOUBLE) AS confidence, present < n AS nullable, u::BIGINT AS unique_count,
        round({ratio}, 4) AS unique_ratio, round((n - present) / n::DOUBLE, 4) AS null_pct, min_value, max_value
        FROM ({facts})"""


PROFILE_COLUMNS = [
    "position", "column_name", "dtype", "semantic_type", "role", "confidence", "nullable", "unique_count",
    "unique_ratio", "null_pct", "min_value", "max_value",
]
MIXED_PROFILE = profile_sql(MIXED_SQL, MIXED_TYPES)


@query("profile_columns", MIXED_PROFILE)
def _(spark, sf):
    return profile(project(spark, sf, "lineitem", MIXED)).select(*PROFILE_COLUMNS)


ORDER_TYPES = {
    "o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"), "o_orderstatus": ("string", "string"),
    "o_totalprice": ("double", "numeric"), "o_orderdate": ("timestamp_ntz", "datetime"), "o_orderpriority": ("string", "string"),
}


@query(
    "profile_approx",
    f"""SELECT column_name, semantic_type, role, null_pct, round(unique_ratio, 1) AS unique_ratio,
        CASE WHEN unique_count <= 20 THEN unique_count END AS few FROM ({profile_sql("orders", ORDER_TYPES)})""",
)
def _(spark, sf):
    """Distinct counts from sketches: shares agree to a decimal, counts up to 20 are exact."""
    found = profile(table(spark, sf, "orders"), approx=True)
    return found.selectExpr(
        "column_name", "semantic_type", "role", "null_pct", "round(unique_ratio, 1) AS unique_ratio",
        "CASE WHEN unique_count <= 20 THEN unique_count END AS few",
    )


def samples_sql(source: str, columns: dict[str, str]) -> str:
    blocks = []
    for c, sort in columns.items():
        values = f"SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL ORDER BY {sort.format('v')} LIMIT 20"
        blocks.append(
            f"SELECT '{c}' AS column_name, array_to_string(list(CAST(v AS VARCHAR) ORDER BY {sort.format('v')})[1:5], ',') AS samples, "
            f"CASE WHEN (SELECT count(DISTINCT {c}) FROM {source}) <= 20 "
            f"THEN array_to_string(list(CAST(v AS VARCHAR) ORDER BY {sort.format('v')}), ',') END AS all_values FROM ({values})"
        )
    return union_sql(blocks)


@query(
    "profile_samples",
    samples_sql("orders", {"o_orderkey": "{}", "o_custkey": "{}", "o_orderstatus": "{}", "o_orderpriority": "{}"}),
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return profile(df).selectExpr("column_name", "array_join(samples, ',') AS samples", "array_join(all_values, ',') AS all_values")


@query(
    "profile_reasoning",
    """SELECT 'l_returnflag' AS column_name, 'l_returnflag (string): ' || count(DISTINCT l_returnflag) || ' distinct ['
        || string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) || '] -> categorical feature' AS reasoning FROM lineitem
    UNION ALL SELECT 'l_quantity' AS column_name, 'l_quantity (double): ' || count(DISTINCT l_quantity) || ' distinct, range '
        || CAST(min(l_quantity) AS VARCHAR) || ' to ' || CAST(max(l_quantity) AS VARCHAR) || ' -> continuous feature' AS reasoning FROM lineitem
    UNION ALL SELECT 'l_linestatus' AS column_name, 'l_linestatus (string): two values ['
        || string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) || '] -> binary feature' AS reasoning FROM lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_linestatus")
    return profile(df).select("column_name", "reasoning")


CAST_INPUT = [
    "o_orderkey AS order_id",
    "CAST(o_totalprice AS VARCHAR(20)) AS response_text",
    "CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END AS customer",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END AS broken",
    "o_orderstatus AS status",
    "o_totalprice AS total",
]
CAST_SQL = subquery("orders", CAST_INPUT)


def edited_profile(spark, df):
    """A profile whose two text columns were marked continuous by hand."""
    edited = "CASE WHEN column_name IN ('customer', 'broken') THEN 'continuous' ELSE semantic_type END"
    return profile(df).selectExpr("position", "column_name", "dtype", f"{edited} AS semantic_type", "role")


@query(
    "cast_status",
    f"""SELECT 'order_id' AS column_name, 'dropped' AS status, NULL AS "to", NULL::DOUBLE AS success_rate
    UNION ALL SELECT 'response_text', 'skipped', NULL, NULL UNION ALL SELECT 'status', 'skipped', NULL, NULL
    UNION ALL SELECT 'total', 'skipped', NULL, NULL
    UNION ALL SELECT 'customer', CASE WHEN r >= 0.9 THEN 'cast' ELSE 'failed' END, CASE WHEN r >= 0.9 THEN 'double' END, round(r, 4)
        FROM (SELECT count(TRY_CAST(customer AS DOUBLE)) / count(customer)::DOUBLE AS r FROM {CAST_SQL})
    UNION ALL SELECT 'broken', CASE WHEN r >= 0.9 THEN 'cast' ELSE 'failed' END, CASE WHEN r >= 0.9 THEN 'double' END, round(r, 4)
        FROM (SELECT count(TRY_CAST(broken AS DOUBLE)) / count(broken)::DOUBLE AS r FROM {CAST_SQL})""",
)
def _(spark, sf):
    df = project(spark, sf, "orders", CAST_INPUT)
    return cast_by_profile(df, edited_profile(spark, df))[1].drop("reason")


@query(
    "cast_table",
    f"SELECT response_text, TRY_CAST(customer AS DOUBLE) AS customer, broken, status, total FROM {CAST_SQL}",
)
def _(spark, sf):
    df = project(spark, sf, "orders", CAST_INPUT)
    return cast_by_profile(df, edited_profile(spark, df))[0]


@query("role_drop", "SELECT event_type, value, user_id, ts, props FROM events")
def _(spark, sf):
    df = table(spark, sf, "events")
    return drop_by_role(df, profile(df))


# --- suggestions -----------------------------------------------------------------------

CONTINUOUS = "semantic_type = 'continuous' AND role NOT IN ('identifier', 'target')"
MIXED_NUMBERS = [c for c, t in MIXED_TYPES.items() if t[1] == "numeric"]


@query(
    "suggest_columns",
    f"""WITH p AS ({MIXED_PROFILE}),
    d AS ({numeric_sql(MIXED_SQL, MIXED_NUMBERS)}),
    o AS ({outlier_sql(MIXED_SQL, MIXED_NUMBERS, 'both')}),
    hit AS (SELECT column_name, string_agg(reason, '+' ORDER BY reason) AS reason FROM (
        SELECT column_name, 'skewed' AS reason FROM d WHERE abs(skewness) > 1
        UNION ALL SELECT column_name, 'outliers' FROM o WHERE outlier_pct > 0.05) GROUP BY column_name),
    lg AS (SELECT column_name, reason FROM p JOIN hit USING (column_name) WHERE {CONTINUOUS})
    SELECT 'target' AS rule, column_name, 'profile' AS reason FROM (SELECT * FROM p WHERE role = 'target' ORDER BY position LIMIT 1)
    UNION ALL SELECT 'outlier_detection', column_name, 'profile' FROM p WHERE {CONTINUOUS}
    UNION ALL SELECT 'scale', column_name, 'profile' FROM p WHERE {CONTINUOUS}
    UNION ALL SELECT 'log', column_name, reason FROM lg
    UNION ALL SELECT 'log', column_name, 'fallback' FROM p WHERE {CONTINUOUS} AND NOT EXISTS (SELECT 1 FROM lg)
    UNION ALL SELECT 'datetime', column_name, 'profile' FROM (SELECT * FROM p WHERE semantic_type = 'datetime' ORDER BY position LIMIT 1)
    UNION ALL SELECT 'drop', column_name, 'profile' FROM p WHERE role = 'identifier'
    UNION ALL SELECT 'encode', column_name, 'profile' FROM p
        WHERE semantic_type IN ('categorical', 'ordinal', 'binary') AND role NOT IN ('target', 'identifier')
    UNION ALL SELECT 'impute_constant', column_name, 'profile' FROM ({gaps_per_column(MIXED_SQL, ['disc'])}) WHERE missing_pct > 0.3""",
)
def _(spark, sf):
    with persisted(project(spark, sf, "lineitem", MIXED)) as df:
        shape = distribution(df)
        return Suggestions(
            profile(df),
            distribution=distribution_section(shape),
            missing=missing_section(missing_values(df)),
            outliers=outlier_section(outliers(df, known=shape)),
        ).table()


@query(
    "suggest_log_by_skew",
    f"""WITH d AS ({numeric_sql(EVENT_SQL, OUTLIER_NAMES)}), o AS ({outlier_sql(EVENT_SQL, OUTLIER_NAMES, 'both')}),
    hit AS (SELECT column_name, 'skewed' AS reason FROM d WHERE abs(skewness) > 1
        UNION ALL SELECT column_name, 'outliers' FROM o WHERE outlier_pct > 0.05)
    SELECT column_name, string_agg(reason, '+' ORDER BY reason) AS reason FROM hit GROUP BY column_name""",
)
def _(spark, sf):
    df = project(spark, sf, "events", EVENT_VALUES)
    return Suggestions(
        profile(df), distribution=distribution_section(distribution(df)), outliers=outlier_section(outliers(df))
    ).log_columns()


@query(
    "suggest_interaction_pairs",
    f"SELECT a, b, r FROM ({pearson_sql(RELATED_SQL, RELATED_COLUMNS)}) WHERE abs(r) > 0.8",
)
def _(spark, sf):
    df = project(spark, sf, "lineitem", RELATED)
    return Suggestions(profile(df), correlation_section(correlation(df, target="price"))).interaction_pairs()


@query(
    "suggest_impute_constant",
    f"SELECT column_name, 'constant' AS strategy, '0' AS constant_value FROM ({gaps_per_column(GAP_SQL, GAP_COLUMNS)}) WHERE missing_pct > 0.3",
)
def _(spark, sf):
    df = project(spark, sf, "lineitem", GAPS)
    return Suggestions(profile(df), missing=missing_section(missing_values(df))).impute_constant()


@query("suggest_selector", "SELECT 'correlation_with_target' AS method, 0.05::DOUBLE AS threshold FROM region LIMIT 1")
def _(spark, sf):
    df = project(spark, sf, "lineitem", RELATED)
    return Suggestions(profile(df), correlation_section(correlation(df, target="price"))).selector()


@query(
    "suggest_outlier_section",
    f"SELECT column_name, 'both' AS method, outlier_pct, z_max, upper_fence FROM ({outlier_sql(EVENT_SQL, OUTLIER_NAMES, 'both')}) WHERE outlier_count > 0",
)
def _(spark, sf):
    return outlier_section(outliers(project(spark, sf, "events", EVENT_VALUES)))


@query(
    "suggest_correlation_section",
    f"""WITH c AS ({pearson_sql(RELATED_SQL, RELATED_COLUMNS)})
    SELECT 'high_pair' AS kind, a, b, r FROM c WHERE abs(r) > 0.8
    UNION ALL SELECT 'target', CASE WHEN a = 'price' THEN b ELSE a END, 'price', r FROM c WHERE a = 'price' OR b = 'price'""",
)
def _(spark, sf):
    return correlation_section(correlation(project(spark, sf, "lineitem", RELATED), target="price"))
