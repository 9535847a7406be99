"""Fill nulls with a statistic of the training part."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    INTEGER_TYPES,
    as_double,
    col,
    dtype,
    is_numeric,
    log,
    measured,
    require_distinct_names,
    resolve_columns,
)
from tablewright.functions.sketches import approx_quantiles
from tablewright.functions.stats import column_stats, quantiles
from tablewright.operators.fitted import Projection

STRATEGIES = ("mean", "median", "mode", "constant")
#: Columns with at most this many distinct values take their mode from one shared aggregate.
MODE_VALUES = 10_000


def fill_nulls(strategy: str, fills: Sequence[tuple[str, str | None, Any]]) -> Projection:
    """The projection for ``(column, type it is cast to if any, fill)``."""
    return Projection(
        replaced={n: F.coalesce(col(n).cast(cast) if cast else col(n), F.lit(fill)) for n, cast, fill in fills},
        rows=tuple((n, strategy, str(fill)) for n, _, fill in fills),
        schema="column_name string, strategy string, fill string",
        recipe=("fill", {"strategy": strategy, "fills": fills}),
    )


@dataclass(frozen=True)
class Imputer:
    """Fills null only; NaN is a value here.

    Without ``columns``, those with a null in train are filled. Means, medians and numeric
    constants turn an integer column into doubles, like the statistic itself. With ``approx``
    the median comes from one mergeable sketch per column, within 0.3 % of the middle rank.
    """

    strategy: str = "mean"
    constant: str | float | None = None
    columns: str | Sequence[str] | None = None
    target: str | None = None
    approx: bool = False

    def fit(self, train: DataFrame) -> Projection:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; choose one of {STRATEGIES}")
        if self.strategy == "constant" and self.constant in (None, ""):
            raise ValueError("the constant strategy needs a constant")
        require_distinct_names(train)
        listed = resolve_columns(train, self.columns)
        names = [c for c in (listed or train.columns) if c != self.target]
        measures = {"present": F.count, "rows": lambda _: F.count(F.lit(1))}
        if self.strategy == "mode":
            measures["distinct"] = F.approx_count_distinct
        facts = column_stats(train, {name: col(name) for name in names}, measures)
        if not listed:
            names = [n for n in names if facts[n]["present"] < facts[n]["rows"]]
        usable = []
        for name in names:
            if facts[name]["present"] == 0:
                log.warning("column %s has no value in train and is left alone", name)
            elif self.strategy in ("mean", "median") and not is_numeric(train, name):
                log.warning("column %s is not numeric and is left alone", name)
            else:
                usable.append(name)
        fills = getattr(self, f"_{self.strategy}")(train, usable, facts)
        casts = {}
        for name, fill in fills.items():
            if isinstance(fill, float) and isinstance(dtype(train, name), INTEGER_TYPES):
                casts[name] = "double"
            elif isinstance(fill, str) and is_numeric(train, name):
                casts[name] = "string"
        return fill_nulls(self.strategy, [(n, casts.get(n), v) for n, v in fills.items()])

    def _mean(self, train, names, facts):
        found = column_stats(train, {n: as_double(train, n) for n in names}, {"mean": F.avg}) if names else {}
        return {n: found[n]["mean"] for n in names}

    def _median(self, train, names, facts):
        """NaN has no rank: the median is that of the numbers."""
        values = {n: measured(train, n) for n in names}
        if self.approx:
            cuts = approx_quantiles(train, values, [0.5])
            return {n: cuts[n][0] for n in names if cuts[n][0] is not None}
        counts = {n: f["n"] for n, f in column_stats(train, values, {"n": F.count}).items()} if names else {}
        cuts = quantiles(train, values, [0.5], counts)
        return {n: cuts[n][0] for n in names if cuts[n][0] is not None}

    def _mode(self, train, names, facts):
        """Most frequent value, the smallest of equals.

        Columns with few values share one aggregate; for the others values are counted in a
        shuffle and only the top one is taken.
        """
        few = [n for n in names if facts[n]["distinct"] <= MODE_VALUES]
        found = column_stats(
            train, {n: col(n) for n in few}, {"mode": lambda c: F.mode(c, deterministic=True)}
        ) if few else {}
        fills = {}
        for name in names:
            if name in found:
                fills[name] = found[name]["mode"]
            else:
                counted = train.where(col(name).isNotNull()).groupBy(col(name).alias("v")).count()
                fills[name] = counted.orderBy(F.col("count").desc(), "v").first()["v"]
        return fills

    def _constant(self, train, names, facts):
        fills = {}
        for name in names:
            fills[name] = str(self.constant)
            if is_numeric(train, name):
                try:
                    fills[name] = float(self.constant)
                except ValueError:
                    pass
        return fills
