"""Readers, sinks, previews, column selection and user-written steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tablewright.operators.custom import Param, custom_step
from tablewright.operators.drop import ColumnDropper
from tablewright.operators.metrics import prediction_summary
from tablewright.operators.missing import missing_values
from tablewright.operators.scale import Scaler
from tablewright.plans.inputs import GAP_COLUMNS, GAPS, project, subquery, table
from tablewright.plans.registry import query
from tablewright.plans.report_queries import GAP_SQL, gaps_per_column
from tablewright.session import scratch_dir
from tablewright.sources.readers import read_csv, read_excel, read_excel_sheets, read_parquet
from tablewright.sources.sinks import preview, write_csv, write_excel, write_parquet, write_report
from tablewright.streaming.apply import apply_to_stream, file_stream, write_available


@query("csv_read", "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    """CSV written by Spark from a table and read back with inferred types."""
    path = scratch_dir(spark, "csv")
    write_csv(table(spark, sf, "customer"), path)
    return read_csv(spark, path)


@query("csv_read_quoted", "SELECT doc_id, text, source FROM documents")
def _(spark, sf):
    """Texts with separators, quotes and line breaks, written and read back."""
    path = scratch_dir(spark, "csv")
    write_csv(table(spark, sf, "documents").select("doc_id", "text", "source"), path)
    return read_csv(spark, path, schema="doc_id long, text string, source string", multiline=True)


@query(
    "csv_read_schema",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
)
def _(spark, sf):
    """A declared schema saves the inference pass over the files."""
    path = scratch_dir(spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    write_csv(table(spark, sf, "orders").select(*columns), path, separator="\t")
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    return read_csv(spark, path, separator="\t", schema=schema)


@query("excel_read", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    """Workbooks written from a table, one per task, and the folder read back by columns in another order."""
    path = scratch_dir(spark, "excel")
    write_excel(table(spark, sf, "customer").repartition(3), path)
    return read_excel(spark, path, "c_name string, c_acctbal double, c_custkey long, c_nationkey int, c_mktsegment string")


@query("excel_read_sheets", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, sf):
    """Every sheet of every workbook through the data source, with days and times."""
    path = scratch_dir(spark, "excel")
    write_excel(table(spark, sf, "orders").drop("o_custkey"), path)
    kinds = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    return read_excel_sheets(spark, path, kinds)


@query("csv_read_no_header", 'SELECT s_suppkey::INT AS "0", s_name AS "1", s_nationkey AS "2", s_acctbal AS "3" FROM supplier')
def _(spark, sf):
    path = scratch_dir(spark, "csv")
    write_csv(table(spark, sf, "supplier"), path, separator=";", header=False)
    return read_csv(spark, path, separator=";", header=False)


@query("parquet_read_columns", "SELECT l_orderkey, l_shipdate FROM lineitem")
def _(spark, sf):
    return read_parquet(spark, f"{sf}/lineitem.parquet", " l_orderkey , l_shipdate")


@query("parquet_sink", "SELECT * FROM part")
def _(spark, sf):
    path = scratch_dir(spark, "parquet")
    write_parquet(table(spark, sf, "part"), path)
    return read_parquet(spark, path)


@query(
    "report_sink_json",
    f"SELECT column_name, missing_count, severity FROM ({gaps_per_column(GAP_SQL, GAP_COLUMNS)})",
)
def _(spark, sf):
    path = scratch_dir(spark, "report")
    write_report(missing_values(project(spark, sf, "lineitem", GAPS)).columns(), path)
    return spark.read.schema("column_name string, missing_count long, severity string").json(path)


@query("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, sf):
    return preview(table(spark, sf, "orders"), "o_orderkey").rows()


@query(
    "preview_columns",
    "SELECT * FROM (VALUES (0::BIGINT, 'doc_id', 'bigint'), (1::BIGINT, 'quality', 'int'), (2::BIGINT, 'toxic', 'int')) "
    "AS t(position, column_name, dtype), (SELECT count(*)::BIGINT AS total_rows FROM labels)",
)
def _(spark, sf):
    return preview(table(spark, sf, "labels")).columns()


#: Labels with gaps and predictions between whole numbers.
MESSY = [
    "CAST(l_linenumber % 3 AS DOUBLE) AS y_true",
    "CASE WHEN l_discount = 0.1 THEN NULL ELSE l_quantity / 20 END AS y_pred",
]
MESSY_SQL = subquery("lineitem", MESSY)


@query(
    "prediction_summary_classes",
    f"""SELECT count(*)::BIGINT AS n_samples, count(*) FILTER (y_true = round_even(y_pred, 0))::BIGINT AS correct,
    round(count(*) FILTER (y_true = round_even(y_pred, 0)) / count(*)::DOUBLE, 4) AS accuracy FROM {MESSY_SQL}""",
)
def _(spark, sf):
    return prediction_summary(project(spark, sf, "lineitem", MESSY)).summary()


@query(
    "prediction_summary_cells",
    f"""SELECT CAST(CAST(y_true AS BIGINT) AS VARCHAR) AS y_true, CAST(CAST(round_even(y_pred, 0) AS BIGINT) AS VARCHAR) AS y_pred,
    count(*)::BIGINT AS count FROM {MESSY_SQL} WHERE y_pred IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return prediction_summary(project(spark, sf, "lineitem", MESSY)).cells()


NUMBERS = ["l_extendedprice AS y_true", "CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity * 2000 END AS y_pred"]


@query(
    "prediction_summary_numbers",
    f"""SELECT (SELECT count(*) FROM lineitem)::BIGINT AS n_samples, round(avg(abs(y_true - y_pred)), 4) AS mae,
    round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse,
    round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 4) AS r2
    FROM {subquery('lineitem', NUMBERS)} WHERE y_pred IS NOT NULL""",
)
def _(spark, sf):
    return prediction_summary(project(spark, sf, "lineitem", NUMBERS)).summary()


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer")
    return ColumnDropper("c_name, c_acctbal, c_mktsegment", target="c_mktsegment").fit(df).transform(df)


# --- user-written steps ----------------------------------------------------------------


@custom_step({"rate": Param(0.1, low=0.0, high=1.0)})
def with_tax(df, rate):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 + rate), 4).alias("gross"))


@query(
    "custom_step_table",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 + 0.25::DOUBLE), 4) AS gross FROM lineitem",
)
def _(spark, sf):
    return with_tax(table(spark, sf, "lineitem"), rate=0.25)


@custom_step({"scale": Param(2)}, mode="batches", schema="doc_id long, size long")
def scaled_size(frames, scale):
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"], "size": frame["n_chars"] * scale})


@query("custom_step_batches", "SELECT doc_id, n_chars * 3 AS size FROM documents")
def _(spark, sf):
    return scaled_size(table(spark, sf, "documents").select("doc_id", "n_chars"), scale=3)


@custom_step(mode="groups", schema="c_nationkey int, customers long, best double", by=["c_nationkey"])
def by_nation(frame):
    return pd.DataFrame(
        {"c_nationkey": frame["c_nationkey"].head(1), "customers": [len(frame)], "best": [frame["c_acctbal"].max()]}
    )


@query(
    "custom_step_groups",
    "SELECT c_nationkey, count(*)::BIGINT AS customers, max(c_acctbal) AS best FROM customer GROUP BY c_nationkey",
)
def _(spark, sf):
    return by_nation(table(spark, sf, "customer").select("c_nationkey", "c_acctbal"))


# --- streaming -------------------------------------------------------------------------


@query(
    "stream_scaled",
    "SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS value FROM events",
)
def _(spark, sf):
    """A scaler fitted on the table, applied to the same files as a stream."""
    df = table(spark, sf, "events").select("event_id", "value")
    step = Scaler("MinMaxScaler", "value").fit(df)
    stream = file_stream(spark, sf, df.schema, pathGlobFilter="events.parquet")
    path = scratch_dir(spark, "stream-out")
    write_available(apply_to_stream(stream, [step]), path).awaitTermination()
    return read_parquet(spark, path).select("event_id", F.round("value", 6).alias("value"))
