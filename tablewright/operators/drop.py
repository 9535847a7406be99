"""Drop listed columns from every part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablewright.functions.columns import log, parse_columns, resolve_columns
from tablewright.operators.fitted import Projection


@dataclass(frozen=True)
class ColumnDropper:
    columns: str | Sequence[str]
    target: str | None = None

    def fit(self, train: DataFrame) -> Projection:
        if not parse_columns(self.columns):
            raise ValueError("name at least one column to drop")
        names = resolve_columns(train, self.columns, on_missing="error")
        if self.target in names:
            log.warning("the target column %s is kept", self.target)
        names = [name for name in names if name != self.target]
        if not names:
            raise ValueError("nothing is left to drop once the target is kept")
        return Projection(dropped=tuple(names), rows=tuple((n, "dropped") for n in names))
