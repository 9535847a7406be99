"""Standard, min-max and robust scaling by the training part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    as_double,
    col,
    is_numeric,
    log,
    measured,
    numeric_columns,
    require_distinct_names,
    resolve_columns,
)
from tablewright.functions.stats import column_stats, quantiles
from tablewright.operators.fitted import Projection

METHODS = ("StandardScaler", "MinMaxScaler", "RobustScaler")


def rescale(method: str, found: Sequence[tuple[str, float, float]]) -> Projection:
    """The projection for ``(column, shift, spread)``."""
    return Projection(
        replaced={n: (col(n).cast("double") - F.lit(shift)) / F.lit(spread) for n, shift, spread in found},
        rows=tuple((n, method, shift, spread) for n, shift, spread in found),
        schema="column_name string, method string, shift double, spread double",
        recipe=("rescale", {"method": method, "found": found}),
    )


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / spread per column; columns without spread are left alone."""

    method: str = "StandardScaler"
    columns: str | Sequence[str] | None = None
    target: str | None = None

    def fit(self, train: DataFrame) -> Projection:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; choose one of {METHODS}")
        require_distinct_names(train)
        if self.columns:
            names = []
            for name in resolve_columns(train, self.columns, on_missing="warn"):
                if is_numeric(train, name):
                    names.append(name)
                else:
                    log.warning("column %s is not numeric and is not scaled", name)
        else:
            names = numeric_columns(train)
        names = [name for name in names if name != self.target]
        values = {name: as_double(train, name) for name in names}
        found = []
        for name, (shift, spread) in self._parameters(train, values).items():
            if not spread:
                log.warning("column %s has no spread and is not scaled", name)
                continue
            found.append((name, shift, spread))
        return rescale(self.method, found)

    def _parameters(self, train, values):
        if not values:
            return {}
        if self.method == "StandardScaler":
            found = column_stats(train, values, {"mean": F.avg, "std": F.stddev_samp})
            return {n: (f["mean"], f["std"]) for n, f in found.items()}
        if self.method == "MinMaxScaler":
            found = column_stats(train, values, {"min": F.min, "max": F.max})
            return {n: (f["min"], None if f["min"] is None else f["max"] - f["min"]) for n, f in found.items()}
        ranked = {n: measured(train, n) for n in values}  # NaN has no rank
        counts = {n: f["n"] for n, f in column_stats(train, ranked, {"n": F.count}).items()}
        cuts = quantiles(train, ranked, [0.25, 0.5, 0.75], counts)
        return {n: (q[1], None if q[1] is None else q[2] - q[0]) for n, q in cuts.items()}
