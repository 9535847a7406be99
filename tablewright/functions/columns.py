"""Column selection rules shared by every operator."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("tablewright")

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
STRING_TYPES = (T.StringType, T.CharType, T.VarcharType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
OPAQUE_TYPES = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col(quoted(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return next(field.dataType for field in df.schema.fields if field.name == name)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    skip = set(exclude)
    return [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, NUMERIC_TYPES) and field.name not in skip
    ]


def string_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    skip = set(exclude)
    return [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, STRING_TYPES) and field.name not in skip
    ]


def parse_columns(columns: str | Sequence[str] | None) -> list[str]:
    """Accept a comma list or a sequence; blanks are ignored."""
    if not columns:
        return []
    parts = columns.split(",") if isinstance(columns, str) else columns
    return [part.strip() for part in parts if part.strip()]


def resolve_columns(
    df: DataFrame, columns: str | Sequence[str] | None, on_missing: str = "ignore"
) -> list[str]:
    """Requested columns that exist; unknown names are ignored, logged or an error."""
    wanted = parse_columns(columns)
    unknown = [name for name in wanted if name not in df.columns]
    if unknown and on_missing == "error":
        raise ValueError(f"columns {unknown} do not exist; the table has {sorted(df.columns)}")
    if unknown and on_missing == "warn":
        log.warning("skipping unknown columns %s", unknown)
    return [name for name in wanted if name in df.columns]


def require_distinct_names(df: DataFrame) -> None:
    """Spark resolves names without regard to case, so ``A`` next to ``a`` cannot be addressed."""
    seen: dict[str, str] = {}
    for name in df.columns:
        other = seen.setdefault(name.lower(), name)
        if other is not name:
            raise ValueError(f"column names {other!r} and {name!r} differ only by case; rename one")


def require_target(df: DataFrame, target: str | None) -> str:
    if not target:
        raise ValueError("a target column is required")
    if target not in df.columns:
        raise ValueError(f"target column {target!r} does not exist; the table has {sorted(df.columns)}")
    return target


def as_double(df: DataFrame, name: str) -> Column:
    return col(name) if isinstance(dtype(df, name), T.DoubleType) else col(name).cast("double")


def measured(df: DataFrame, name: str) -> Column:
    """A numeric column as double in which NaN counts as missing (the report rule)."""
    value = as_double(df, name)
    if isinstance(dtype(df, name), FLOAT_TYPES):
        return F.when(~F.isnan(value), value)
    return value


def missing(df: DataFrame, name: str) -> Column:
    """True where a cell is null or NaN."""
    if isinstance(dtype(df, name), FLOAT_TYPES):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def as_text(df: DataFrame, name: str) -> Column:
    """A printable form of any column, nested and binary ones included."""
    kind = dtype(df, name)
    if isinstance(kind, T.BinaryType):
        return F.base64(col(name))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(col(name).isNotNull(), F.to_json(F.struct(col(name).alias("v"))))
    if isinstance(kind, FLOAT_TYPES):
        return F.when(~F.isnan(col(name)), (col(name) + F.lit(0.0)).cast("string"))
    return col(name).cast("string")
