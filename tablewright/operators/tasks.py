"""Classification or regression, judged from the target column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import FLOAT_TYPES, INTEGER_TYPES, STRING_TYPES, col, dtype, measured
from pyspark.sql import types as T

MAX_CLASSES = 20
RULES = ("numeric", "tree")


def detect_task(df: DataFrame, target: str, rule: str = "numeric") -> str:
    """``numeric``: whole numbers with at most 20 values, or text, are classes.

    ``tree`` is the stricter variant in which every floating-point target is a regression.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; choose one of {RULES}")
    kind = dtype(df, target)
    if isinstance(kind, (*STRING_TYPES, T.BooleanType)):
        if rule == "tree" and _few_values(df, target) is None:
            return "regression"
        return "classification"
    if isinstance(kind, (*FLOAT_TYPES, T.DecimalType)) and rule == "tree":
        return "regression"
    if not isinstance(kind, (*INTEGER_TYPES, *FLOAT_TYPES, T.DecimalType)):
        raise ValueError(f"target {target!r} of type {kind.simpleString()} cannot be learned")
    values = _few_values(df, target)
    whole = values is not None and all(float(v).is_integer() for v in values)
    return "classification" if whole else "regression"


def _few_values(df: DataFrame, target: str) -> list | None:
    """The distinct values, or None when there are more than 20.

    A sketch settles targets with clearly more values without a shuffle; only the others
    are listed.
    """
    kind = dtype(df, target)
    value = measured(df, target) if isinstance(kind, (*INTEGER_TYPES, *FLOAT_TYPES, T.DecimalType)) else col(target)
    if df.agg(F.approx_count_distinct(value)).first()[0] > 3 * MAX_CLASSES:
        return None
    found = (
        df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    )
    return None if len(found) > MAX_CLASSES else [r["v"] for r in found]
