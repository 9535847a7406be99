"""Feature steps, fitted on the training part and applied to all parts."""

from __future__ import annotations


from pyspark.sql import functions as F

from tablewright.operators.dates import DatetimeEncoder
from tablewright.operators.encode import Encoder
from tablewright.operators.impute import Imputer
from tablewright.operators.interact import Interactions
from tablewright.operators.logs import LogTransform, log1p, yeo_johnson
from tablewright.operators.scale import Scaler
from tablewright.operators.select import FeatureSelector
from tablewright.operators.stored_steps import load_steps, save_steps
from tablewright.plans.flow import prepare
from tablewright.plans.inputs import LINE_KEY, project, split_sql, split_table, subquery, table, union_sql
from tablewright.plans.registry import query
from tablewright.session import scratch_dir
from tablewright.splits import Splits

ORDER_KEY = ["o_orderkey"]


def rounded_frame(df, names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def rounded_sql(names, places=6):
    return ", ".join(f"round({expr}, {places}) + 0.0 AS {name}" for name, expr in names.items())


# --- imputing --------------------------------------------------------------------------

HOLES = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS label",
]
HOLES_SQL = split_sql("orders", ORDER_KEY, HOLES)
TRAIN_HOLES = f"(SELECT * FROM {HOLES_SQL} WHERE split = 'train')"


def imputed_sql(total: str, cust: str, priority: str = "priority") -> str:
    return f"SELECT split, o_orderkey, {total} AS total, {cust} AS cust, {priority} AS priority, label FROM {HOLES_SQL}"


def filled_sql(column: str, stat: str) -> str:
    return f"round(coalesce({column}, (SELECT {stat} FROM {TRAIN_HOLES})), 6)"


def imputed(spark, sf, **kw):
    parts = split_table(spark, sf, "orders", ORDER_KEY, HOLES)
    step = Imputer(target="label", **kw).fit(parts.train)
    return step.apply(parts).tagged()


@query("impute_mean", imputed_sql(filled_sql("total", "avg(total)"), filled_sql("cust", "avg(cust)")))
def _(spark, sf):
    return rounded_frame(imputed(spark, sf, strategy="mean"), ["total", "cust"])


@query(
    "impute_median",
    imputed_sql(filled_sql("total", "quantile_cont(total, 0.5)"), filled_sql("cust", "quantile_cont(cust, 0.5)")),
)
def _(spark, sf):
    return rounded_frame(imputed(spark, sf, strategy="median"), ["total", "cust"])


@query(
    "impute_median_approx",
    f"""SELECT column_name, round(10 * avg((v <= m)::INT))::BIGINT AS tenths FROM (SELECT 'total' AS column_name, total AS v,
        (SELECT quantile_cont(total, 0.5) FROM {TRAIN_HOLES}) AS m FROM {TRAIN_HOLES} UNION ALL SELECT 'cust', cust,
        (SELECT quantile_cont(cust, 0.5) FROM {TRAIN_HOLES}) FROM {TRAIN_HOLES}) WHERE v IS NOT NULL GROUP BY column_name""",
)
def _(spark, sf):
    """Medians from sketches, compared by the tenths of the rows that lie at or below the fill."""
    train = split_table(spark, sf, "orders", ORDER_KEY, HOLES).train
    fills = Imputer("median", target="label", columns="total,cust", approx=True).fit(train).info(spark)
    cells = train.selectExpr("stack(2, 'total', total, 'cust', CAST(cust AS DOUBLE)) AS (column_name, v)").where("v IS NOT NULL")
    shares = cells.join(fills, "column_name").groupBy("column_name").agg(F.expr("round(10 * avg(CAST(v <= CAST(fill AS DOUBLE) AS INT))) AS tenths"))
    return shares.selectExpr("column_name", "CAST(tenths AS BIGINT) AS tenths")


def mode_sql(column: str) -> str:
    return (
        f"coalesce({column}, (SELECT {column} FROM {TRAIN_HOLES} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1))"
    )


@query("impute_mode", imputed_sql(mode_sql("total"), mode_sql("cust"), mode_sql("priority")))
def _(spark, sf):
    return imputed(spark, sf, strategy="mode")


@query(
    "impute_constant",
    imputed_sql("coalesce(total, -1)", "coalesce(CAST(cust AS DOUBLE), -1)", "coalesce(priority, '-1')"),
)
def _(spark, sf):
    return imputed(spark, sf, strategy="constant", constant="-1")


@query("impute_columns", imputed_sql("total", filled_sql("cust", "avg(cust)")))
def _(spark, sf):
    """Listed columns only; unknown names are ignored."""
    return rounded_frame(imputed(spark, sf, strategy="mean", columns="cust, label, nowhere"), ["cust"])


# --- encoding --------------------------------------------------------------------------

#: The category of some validation and test rows does not occur in train.
CATEGORIES = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    "CASE WHEN o_orderkey % 1000 = 3 THEN concat('rare ', CAST(o_orderkey AS VARCHAR(20))) ELSE o_orderstatus END AS status",
    "concat('c', CAST(o_custkey AS VARCHAR(20))) AS cust",
]
CATEGORY_SQL = split_sql("orders", ORDER_KEY, CATEGORIES)


def code_sql(column: str) -> str:
    return (
        f"(SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS code FROM "
        f"(SELECT DISTINCT {column} FROM {CATEGORY_SQL} WHERE split = 'train' AND {column} IS NOT NULL))"
    )


def label_sql(names: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN {code_sql(c)} m{i} ON s.{c} = m{i}.v" for i, c in enumerate(names))
    coded = ", ".join(f"coalesce(m{i}.code, -1)::BIGINT AS {c}" for i, c in enumerate(names))
    kept = ", ".join(c for c in ("priority", "status", "cust") if c not in names)
    return f"SELECT split, o_orderkey, {coded}{', ' + kept if kept else ''} FROM {CATEGORY_SQL} s {joins}"


for _method in ("label", "ordinal"):

    @query(f"encode_{_method}", label_sql(["priority", "status"]))
    def _(spark, sf, method=_method):
        parts = split_table(spark, sf, "orders", ORDER_KEY, CATEGORIES)
        return Encoder(method, "priority, status").fit(parts.train).apply(parts).tagged()


@query("encode_label_many", label_sql(["priority", "status", "cust"]))
def _(spark, sf):
    """Dictionaries beyond the literal limit are joined instead."""
    parts = split_table(spark, sf, "orders", ORDER_KEY, CATEGORIES)
    return Encoder("label", literal_categories=4).fit(parts.train).apply(parts).tagged()


ONE_HOT_VALUES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "encode_one_hot",
    "SELECT split, o_orderkey, status, cust, "
    + ", ".join(f"CAST(priority = '{v}' AS BIGINT) AS \"priority_{v}\"" for v in ONE_HOT_VALUES)
    + f" FROM {CATEGORY_SQL}",
)
def _(spark, sf):
    parts = split_table(spark, sf, "orders", ORDER_KEY, CATEGORIES)
    return Encoder("one_hot", "priority").fit(parts.train).apply(parts).tagged()


@query(
    "encode_one_hot_sparse",
    f"""SELECT o_orderkey, '(' || (SELECT count(*) FROM {code_sql('cust')}) || ',' ||
    CASE WHEN code IS NULL THEN '[],[]' ELSE '[' || code || '],[1.0]' END || ')' AS cust_onehot
    FROM {CATEGORY_SQL} s LEFT JOIN {code_sql('cust')} m ON s.cust = m.v WHERE split = 'test'""",
)
def _(spark, sf):
    """One sparse vector column in place of a column per category."""
    parts = split_table(spark, sf, "orders", ORDER_KEY, CATEGORIES)
    out = Encoder("one_hot", "cust", output="vector").fit(parts.train).transform(parts.test)
    return out.select("o_orderkey", F.expr("cast(cust_onehot as string)").alias("cust_onehot"))


@query(
    "encode_unseen",
    union_sql(
        [
            f"SELECT '{c}' AS column_name, {c} AS value FROM (SELECT DISTINCT {c} FROM {CATEGORY_SQL} WHERE split = 'test' AND {c} IS NOT NULL "
            f"EXCEPT SELECT {c} FROM {CATEGORY_SQL} WHERE split = 'train')"
            for c in ("priority", "status", "cust")
        ]
    ),
)
def _(spark, sf):
    parts = split_table(spark, sf, "orders", ORDER_KEY, CATEGORIES)
    return Encoder("label", literal_categories=4).fit(parts.train).unseen(parts.test)


@query(
    "encode_dictionary",
    union_sql([f"SELECT '{c}' AS column_name, v AS value, code::BIGINT AS code FROM {code_sql(c)}" for c in ("priority", "status", "cust")]),
)
def _(spark, sf):
    parts = split_table(spark, sf, "orders", ORDER_KEY, CATEGORIES)
    return Encoder("label", literal_categories=200).fit(parts.train).dictionary(spark)


# --- scaling ---------------------------------------------------------------------------

SCALED = [*LINE_KEY, "l_extendedprice AS price", "l_quantity AS qty", "CAST(1 AS DOUBLE) AS flat", "l_returnflag AS flag"]
SCALED_SQL = split_sql("lineitem", LINE_KEY, SCALED)
TRAIN_SCALED = f"(SELECT * FROM {SCALED_SQL} WHERE split = 'train')"
SCALE_STATS = {
    "StandardScaler": ("avg({c})", "stddev_samp({c})"),
    "MinMaxScaler": ("min({c})", "max({c}) - min({c})"),
    "RobustScaler": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def scaled_sql(method: str) -> str:
    shift, spread = SCALE_STATS[method]
    stats = ", ".join(
        f"{shift.format(c=c)} AS {c}_shift, {spread.format(c=c)} AS {c}_spread" for c in ("price", "qty")
    )
    cols = rounded_sql({c: f"({c} - {c}_shift) / {c}_spread" for c in ("price", "qty")})
    return (
        f"SELECT split, {', '.join(LINE_KEY)}, {cols}, flat, flag FROM {SCALED_SQL}, (SELECT {stats} FROM {TRAIN_SCALED})"
    )


for _method, _name in (("StandardScaler", "standard"), ("MinMaxScaler", "min_max"), ("RobustScaler", "robust")):

    @query(f"scale_{_name}", scaled_sql(_method))
    def _(spark, sf, method=_method):
        parts = split_table(spark, sf, "lineitem", LINE_KEY, SCALED)
        step = Scaler(method, "price, qty, flat, flag").fit(parts.train)
        return rounded_frame(step.apply(parts).tagged(), ["price", "qty"])


# --- logs ------------------------------------------------------------------------------

BALANCES = ["c_custkey", "c_acctbal AS bal", "c_acctbal / 1000 AS small", "c_nationkey AS nation"]
BALANCE_SQL = subquery("customer", BALANCES)


@query(
    "log_signed",
    "SELECT c_custkey, "
    + rounded_sql({"bal": "sign(bal) * ln(1 + abs(bal))", "small": "sign(small) * ln(1 + abs(small))"})
    + f", nation FROM {BALANCE_SQL}",
)
def _(spark, sf):
    df = project(spark, sf, "customer", BALANCES)
    return rounded_frame(LogTransform("signed_log", "bal, small").fit(df).transform(df), ["bal", "small"])


@query(
    "log_log1p",
    "SELECT c_custkey, bal, CASE WHEN small > -1 THEN round(ln(1 + small), 6) + 0.0 WHEN small = -1 THEN '-inf'::DOUBLE "
    f"ELSE 'nan'::DOUBLE END AS small, round(ln(1 + nation), 6) AS nation FROM {BALANCE_SQL}",
)
def _(spark, sf):
    df = project(spark, sf, "customer", BALANCES)
    out = LogTransform("log1p", "small, nation").fit(df).transform(df)
    finite = ~F.isnan("small") & (F.abs("small") != float("inf"))
    return rounded_frame(out, ["nation"]).withColumn("small", F.when(finite, F.round("small", 6)).otherwise(F.col("small")))


@query(
    "log_log1p_domain",
    "SELECT count(*) FILTER (small < 0)::BIGINT AS negative, count(*) FILTER (small < -1)::BIGINT AS outside FROM "
    f"(SELECT (c_acctbal - 5000) / 1000 AS small FROM customer)",
)
def _(spark, sf):
    """Where log1p leaves its domain it gives NaN, as IEEE arithmetic does, not null."""
    df = table(spark, sf, "customer").select(((F.col("c_acctbal") - 5000) / 1000).alias("small"))
    return df.agg(
        F.count_if(F.col("small") < 0).alias("negative"), F.count_if(F.isnan(log1p(F.col("small")))).alias("outside")
    )


def yeo_sql(x: str, lam: float) -> str:
    up = f"ln(1 + {x})" if lam == 0 else f"((({x}) + 1) ** {lam}::DOUBLE - 1) / {lam}::DOUBLE"
    low = f"-ln(1 - {x})" if lam == 2 else f"-((1 - ({x})) ** {2 - lam}::DOUBLE - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {low} END"


EXPONENTS = {"below": -0.5, "zero": 0.0, "half": 0.5, "two": 2.0}


@query(
    "log_yeo_johnson_formula",
    "SELECT c_custkey, " + rounded_sql({n: yeo_sql("small", lam) for n, lam in EXPONENTS.items()}) + f" FROM {BALANCE_SQL}",
)
def _(spark, sf):
    df = project(spark, sf, "customer", BALANCES)
    return df.select(
        "c_custkey", *[F.round(yeo_johnson(F.col("small"), lam), 6).alias(n) for n, lam in EXPONENTS.items()]
    )


#: Log-likelihood of every exponent on a grid of hundredths.
LIKELIHOOD = f"""(SELECT lam, -count(*) / 2.0::DOUBLE * ln(var_pop(t)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS fit FROM (
    SELECT lam, x, CASE WHEN x >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + x) ELSE ((1 + x) ** lam - 1) / lam END
        ELSE CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -((1 - x) ** (2 - lam) - 1) / (2 - lam) END END AS t
    FROM (SELECT small AS x FROM {BALANCE_SQL}), (SELECT i / 100.0::DOUBLE AS lam FROM range(-100, 301) r(i))) GROUP BY lam)"""


@query("log_yeo_johnson_exponent", f"SELECT 'small' AS column_name, round(max_by(lam, fit), 2) AS exponent FROM {LIKELIHOOD}")
def _(spark, sf):
    df = project(spark, sf, "customer", BALANCES)
    fitted = LogTransform("yeo_johnson", "small").fit(df)
    return fitted.info(spark).where("status = 'transformed'").select("column_name", F.round("exponent", 2).alias("exponent"))


@query("log_yeo_johnson")
def _(spark, sf):
    df = project(spark, sf, "customer", BALANCES)
    return LogTransform("yeo_johnson", "bal, small").fit(df).transform(df)


LOG_NEGATIVES = "SELECT count(*) FILTER (c_acctbal < 0)::BIGINT AS n FROM customer"


@query(
    "log_summary",
    f"""SELECT 'c_acctbal' AS column_name, 'log1p' AS method, 'transformed' AS status, NULL::DOUBLE AS exponent,
        n AS negatives, false AS auto_selected FROM ({LOG_NEGATIVES})
    UNION ALL SELECT 'c_nationkey', 'log1p', 'skipped', NULL, NULL, false""",
)
def _(spark, sf):
    df = table(spark, sf, "customer")
    return LogTransform("log1p", "c_acctbal", target="c_custkey").fit(df).info(spark)


# --- interactions ----------------------------------------------------------------------

OPERATIONS = {
    "multiply": ("x", "a * b"),
    "add": ("plus", "a + b"),
    "subtract": ("minus", "a - b"),
    "ratio": ("div", "CASE WHEN b <> 0 THEN a / b END"),
}
PAIRS = [("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]
PAIR_COLUMNS = [*LINE_KEY, "l_quantity", "l_discount", "l_extendedprice", "l_tax"]


def interact_sql(op: str) -> str:
    label, expr = OPERATIONS[op]
    made = {f"{a}_{label}_{b}": f"(SELECT {expr} FROM (SELECT {a} AS a, {b} AS b))" for a, b in PAIRS}
    return f"SELECT {', '.join(PAIR_COLUMNS)}, {rounded_sql(made)} FROM lineitem"


for _op in OPERATIONS:

    @query(f"interact_{_op}", interact_sql(_op))
    def _(spark, sf, op=_op):
        df = table(spark, sf, "lineitem").select(*PAIR_COLUMNS)
        out = Interactions("l_quantity:l_discount, l_extendedprice:l_tax", op).fit(df).transform(df)
        return rounded_frame(out, [f"{a}_{OPERATIONS[op][0]}_{b}" for a, b in PAIRS])


# --- dates -----------------------------------------------------------------------------

PART_SQL = {
    "year": "year({c})", "month": "month({c})", "day": "day({c})", "weekday": "isodow({c})",
    "hour": "hour({c})", "minute": "minute({c})",
}


def parts_sql(column: str, parts: list[str], source: str | None = None) -> str:
    return ", ".join(f"{PART_SQL[p].format(c=source or column)}::INT AS {column}_{p}" for p in parts)


@query("dates_parts", f"SELECT event_id, event_type, {parts_sql('ts', list(PART_SQL))} FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return DatetimeEncoder("ts", "year,month,day,weekday,hour,minute").fit(df).transform(df)


DATE_TEXTS = ["o_orderkey", "o_orderdate", "CAST(o_orderdate AS VARCHAR(30)) AS created_text", "CAST(o_orderdate AS DATE) AS day_only"]


@query(
    "dates_detected",
    "SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS VARCHAR) AS created_text, CAST(o_orderdate AS DATE) AS day_only, "
    + ", ".join(parts_sql(c, ["year", "weekday"], "o_orderdate") for c in ("o_orderdate", "created_text", "day_only"))
    + " FROM orders",
)
def _(spark, sf):
    """Typed columns and text columns with a telling name are found without being named."""
    df = project(spark, sf, "orders", DATE_TEXTS)
    return DatetimeEncoder(components="year,weekday", drop_original=False).fit(df).transform(df)


# --- selection -------------------------------------------------------------------------

CANDIDATES = [
    "l_quantity AS qty",
    "l_extendedprice AS price",
    "nullif(l_discount, 0.03) AS disc",
    "CAST(5 AS DOUBLE) AS flat",
    "l_linenumber AS line_no",
    "l_returnflag AS flag",
    "CAST(l_quantity + 100 * l_discount > 30 AS INT) AS y",
]
CANDIDATE_SQL = split_sql("lineitem", LINE_KEY, CANDIDATES)
TRAIN_CANDIDATES = f"(SELECT * FROM {CANDIDATE_SQL} WHERE split = 'train')"
NUMBERS = ["qty", "price", "disc", "flat", "line_no"]


def selector_frame(spark, sf, method, threshold, places=6):
    parts = split_table(spark, sf, "lineitem", LINE_KEY, CANDIDATES)
    scores = FeatureSelector(method, threshold, "y").scores(parts.train)
    return scores.select("feature", F.round("score", places).alias("score"), "dropped")


@query(
    "select_variance",
    union_sql(
        [
            f"SELECT '{c}' AS feature, round(var_samp({c}), 2) + 0.0 AS score, var_samp({c}) <= 0.01 AS dropped FROM {TRAIN_CANDIDATES}"
            for c in NUMBERS
        ]
    ),
)
def _(spark, sf):
    return selector_frame(spark, sf, "variance_threshold", 0.01, places=2)


def target_r(c: str) -> str:
    return (
        f"coalesce(abs(regr_sxy(y, {c}) / nullif(sqrt(regr_sxx(y, {c}) * regr_syy(y, {c})), 0)), 0)"
    )


@query(
    "select_correlation",
    union_sql(
        [
            f"SELECT '{c}' AS feature, round({target_r(c)}, 6) AS score, {target_r(c)} < 0.05 AS dropped FROM {TRAIN_CANDIDATES}"
            for c in NUMBERS
        ]
    ),
)
def _(spark, sf):
    return selector_frame(spark, sf, "correlation_with_target", 0.05)


#: Inner edges of 20 bins: the table has more than 400 rows at every size.
INNER = [i / 20 for i in range(1, 20)]


def information_sql(c: str) -> str:
    """Edges, bins, joint and marginal shares of one feature against the target."""
    return f"""(WITH rows AS (SELECT CAST({c} AS DOUBLE) AS x, CAST(y AS DOUBLE) AS t FROM {TRAIN_CANDIDATES} WHERE {c} IS NOT NULL AND y IS NOT NULL),
    edges AS (SELECT DISTINCT unnest(quantile_cont(x, {INNER})) AS e FROM rows),
    edgest AS (SELECT DISTINCT unnest(quantile_cont(t, {INNER})) AS e FROM rows),
    xmap AS (SELECT x, (SELECT count(*) FROM edges WHERE e <= x) AS xb FROM (SELECT DISTINCT x FROM rows)),
    tmap AS (SELECT t, (SELECT count(*) FROM edgest WHERE e <= t) AS tb FROM (SELECT DISTINCT t FROM rows)),
    joint AS (SELECT xb, tb, count(*) AS c FROM rows JOIN xmap USING (x) JOIN tmap USING (t) GROUP BY ALL),
    mi AS (SELECT greatest(0, sum(c / n::DOUBLE * ln(c * n / (nx * nt)::DOUBLE))) AS s FROM
        (SELECT c, (SELECT count(*) FROM rows) AS n, sum(c) OVER (PARTITION BY xb) AS nx, sum(c) OVER (PARTITION BY tb) AS nt FROM joint))
    SELECT '{c}' AS feature, round(s, 6) AS score, s < 0.01 AS dropped FROM mi)"""


@query("select_mutual_information", union_sql([f"SELECT * FROM {information_sql(c)}" for c in NUMBERS]))
def _(spark, sf):
    return selector_frame(spark, sf, "mutual_information", 0.01)


@query("select_applied", f"SELECT split, qty, price, disc, line_no, flag, y FROM {CANDIDATE_SQL}")
def _(spark, sf):
    parts = split_table(spark, sf, "lineitem", LINE_KEY, CANDIDATES)
    return FeatureSelector("variance_threshold", 1e-6, "y").fit(parts.train).apply(parts).tagged()


# --- stored steps ----------------------------------------------------------------------

STORED = [
    "o_orderkey", "o_orderpriority AS priority", "CAST(o_custkey AS STRING) AS cust",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total", "o_orderdate AS ordered",
]


@query(
    "steps_save_load",
    f"""WITH f AS (SELECT o_orderkey, priority, cust, ordered, coalesce(total, avg(total) OVER ()) AS total FROM {subquery("orders", STORED)})
    SELECT o_orderkey, dense_rank() OVER (ORDER BY priority) - 1 AS priority, dense_rank() OVER (ORDER BY cust) - 1 AS cust,
        round((total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()), 6) + 0.0 AS total,
        CAST(year(ordered) AS INT) AS ordered_year, CAST(weekday(ordered) + CASE WHEN weekday(ordered) = 0 THEN 7 ELSE 0 END AS INT) AS ordered_weekday
    FROM f""",
)
def _(spark, sf):
    """Steps fitted on the orders, written, read again, and applied to them: few categories as literals, many as a stored table."""
    orders = project(spark, sf, "orders", STORED)
    steps = [Imputer("mean", columns="total"), Encoder("label", "priority,cust", literal_categories=10), DatetimeEncoder("ordered", "year,weekday"), Scaler("MinMaxScaler", "total")]
    path = scratch_dir(spark, "steps")
    save_steps(spark, prepare(Splits(orders), steps)[1], path)
    for step in load_steps(spark, path):
        orders = step.transform(orders)
    return rounded_frame(orders, ["total"])
