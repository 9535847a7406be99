"""Numeric parts of date and time columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    DATETIME_TYPES,
    STRING_TYPES,
    col,
    dtype,
    parse_columns,
    require_distinct_names,
    resolve_columns,
)
from tablewright.functions.stats import collect_aggregates
from tablewright.operators.fitted import Fitted, Projection
from tablewright.splits import Splits

# Name parts that mark a text column as a date, and the parts on offer.
NAME_HINTS = ("date", "datetime", "timestamp", "time", "created", "updated")
COMPONENTS = ("year", "month", "day", "weekday", "hour", "minute")


def component(value: Column, part: str) -> Column:
    """Weekdays run from 1 (Monday) to 7 (Sunday)."""
    return {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "weekday": lambda v: F.weekday(v) + 1,
        "hour": F.hour,
        "minute": F.minute,
    }[part](value).cast("int")


@dataclass(frozen=True)
class DatetimeEncoder:
    column: str | None = None
    components: str | Sequence[str] = ("year", "month", "day", "weekday")
    drop_original: bool = True
    target: str | None = None

    def fit(self, train: DataFrame) -> FittedDates:
        parts = [p.lower() for p in parse_columns(self.components)]
        strange = [p for p in parts if p not in COMPONENTS]
        if strange:
            raise ValueError(f"unknown components {strange}; choose from {COMPONENTS}")
        require_distinct_names(train)
        if self.column:
            names = resolve_columns(train, [self.column], on_missing="error")
        else:
            names = self._detected(train)
            if not names:
                raise ValueError("no date or time column found; name one")
        kinds = {}
        for name in names:
            kind = dtype(train, name)
            if not isinstance(kind, (*STRING_TYPES, *DATETIME_TYPES)):
                raise ValueError(f"column {name!r} is {kind.simpleString()}, not a date or time")
            kinds[name] = "text" if isinstance(kind, STRING_TYPES) else "date" if kind.simpleString() == "date" else "time"
        fitted = date_parts(kinds, parts, self.drop_original)
        fitted.check(train)
        return fitted

    def _detected(self, df: DataFrame) -> list[str]:
        found = []
        for field in df.schema.fields:
            named = any(hint in field.name.lower() for hint in NAME_HINTS)
            if isinstance(field.dataType, DATETIME_TYPES) or (isinstance(field.dataType, STRING_TYPES) and named):
                found.append(field.name)
        return found


def date_parts(kinds: dict[str, str], parts: Sequence[str], drop_original: bool) -> FittedDates:
    """The step for columns of kind ``text``, ``date`` or ``time``."""
    read = {"text": F.try_to_timestamp, "date": lambda c: c.cast("timestamp_ntz"), "time": lambda c: c}
    values = {n: read[kind](col(n)) for n, kind in kinds.items()}
    step = Projection(
        added={f"{n}_{p}": component(value, p) for n, value in values.items() for p in parts},
        dropped=tuple(kinds) if drop_original else (),
        rows=tuple((n, ",".join(parts)) for n in kinds),
        schema="column_name string, components string",
    )
    parsed = {n: values[n] for n, kind in kinds.items() if kind == "text"}
    return FittedDates(step, parsed, {"kinds": kinds, "parts": list(parts), "drop_original": drop_original})


@dataclass(frozen=True)
class FittedDates(Fitted):
    step: Projection
    parsed: dict[str, Column]
    recipe: dict

    def check(self, df: DataFrame) -> None:
        """Raise when a text column holds something that is no timestamp."""
        if not self.parsed:
            return
        bad = collect_aggregates(
            df, {n: F.count_if(col(n).isNotNull() & value.isNull()) for n, value in self.parsed.items()}
        )
        wrong = {n: count for n, count in bad.items() if count}
        if wrong:
            raise ValueError(f"columns with values that are no timestamps (rows): {wrong}")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.step.transform(df)

    def apply(self, splits: Splits) -> Splits:
        for part, frame in splits.items():
            if part != "train":
                self.check(frame)
        return super().apply(splits)

    def info(self, spark) -> DataFrame:
        return self.step.info(spark)
