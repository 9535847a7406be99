"""Signed log, log1p and Yeo-Johnson power transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import as_double, col, log, numeric_columns, require_distinct_names, resolve_columns
from tablewright.functions.keep import persisted
from tablewright.functions.stats import collect_aggregates, column_stats
from tablewright.operators.fitted import Projection

METHODS = ("signed_log", "log1p", "yeo_johnson")
GRID = 21
ROUNDS = 4


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log1p(x: Column) -> Column:
    """ln(1 + x) with the IEEE results below its domain, where Spark's own gives null."""
    return (
        F.when(x > -1, F.log1p(x))
        .when(x == -1, F.lit(float("-inf")))
        .when(x.isNotNull(), F.lit(float("nan")))
    )


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson transform for a given exponent."""
    if abs(lam) < 1e-12:
        upper = F.log1p(x)
    else:
        upper = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) < 1e-12:
        lower = -F.log1p(-x)
    else:
        lower = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    return F.when(x >= 0, upper).otherwise(lower)


def fit_exponents(df: DataFrame, values: dict[str, Column]) -> dict[str, float]:
    """Maximum-likelihood exponent per column.

    The likelihood has a single peak, so every round evaluates a grid of exponents for all
    columns in one aggregate and narrows to the neighbours of the best; a parabola through
    the last three gives the peak. A handful of passes, whatever the number of rows.
    """
    names = list(values)
    narrow = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
    with persisted(narrow) as work:
        cols = {n: F.col(f"v{i}") for i, n in enumerate(names)}
        facts = column_stats(
            work,
            cols,
            {"n": F.count, "slope": lambda c: F.sum(signed_log(c)), "min": F.min, "max": F.max},
        )
        live = [n for n in names if facts[n]["n"] > 1 and facts[n]["min"] < facts[n]["max"]]
        span = {n: (-2.0, 2.0) for n in live}
        peak, settled = {}, dict.fromkeys(live, 0)
        while any(settled[n] < ROUNDS for n in live):
            aggregates, grids = {}, {}
            for n in live:
                lo, hi = span[n]
                grids[n] = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
                for i, lam in enumerate(grids[n]):
                    aggregates[n, i] = F.var_pop(yeo_johnson(cols[n], lam))
            found = collect_aggregates(work, aggregates) if aggregates else {}
            for n in live:
                scores = [
                    _likelihood(found[n, i], lam, facts[n]["n"], facts[n]["slope"]) for i, lam in enumerate(grids[n])
                ]
                best = max(range(GRID), key=scores.__getitem__)
                lo, hi = span[n]
                if best in (0, GRID - 1):
                    # Peak outside: move on and widen.
                    width = hi - lo
                    span[n] = (lo - 2 * width, lo + width / GRID) if best == 0 else (hi - width / GRID, hi + 2 * width)
                else:
                    span[n] = (grids[n][best - 1], grids[n][best + 1])
                    peak[n] = _vertex(grids[n], scores, best)
                    settled[n] += 1
        return {n: peak.get(n, 1.0) for n in names}


def _vertex(grid: list[float], scores: list[float], best: int) -> float:
    """Top of the parabola through the best grid point and its neighbours."""
    left, top, right = scores[best - 1 : best + 2]
    bend = left - 2 * top + right
    step = grid[1] - grid[0]
    if not math.isfinite(bend) or bend >= 0:
        return grid[best]
    return grid[best] + step * (left - right) / (2 * bend)


def _likelihood(variance: float | None, lam: float, n: int, slope: float) -> float:
    if variance is None or not math.isfinite(variance) or variance <= 0:
        return -math.inf
    return -n / 2 * math.log(variance) + (lam - 1) * slope


def take_logs(rows: Sequence[tuple]) -> Projection:
    """The projection for ``(column, method, status, exponent, negatives, auto_selected)``; skipped columns stay."""
    replaced = {}
    for name, method, status, exponent, _, _ in rows:
        value = col(name).cast("double")
        if status == "skipped":
            continue
        if method == "yeo_johnson":
            replaced[name] = yeo_johnson(value, exponent)
        else:
            replaced[name] = (signed_log if method == "signed_log" else log1p)(value)
    return Projection(
        replaced=replaced,
        rows=tuple(tuple(r) for r in rows),
        schema="column_name string, method string, status string, exponent double, negatives long, auto_selected boolean",
        recipe=("logs", {"rows": rows}),
    )


@dataclass(frozen=True)
class LogTransform:
    method: str = "signed_log"
    columns: str | Sequence[str] | None = None
    target: str | None = None

    def fit(self, train: DataFrame) -> Projection:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; choose one of {METHODS}")
        require_distinct_names(train)
        numeric = numeric_columns(train, exclude=[self.target])
        if self.columns:
            names = []
            for name in resolve_columns(train, self.columns, on_missing="error"):
                if name in numeric:
                    names.append(name)
                else:
                    log.warning("column %s is not numeric and is not transformed", name)
        else:
            names = numeric
        if not names:
            raise ValueError("there is no numeric column to transform")
        values = {name: as_double(train, name) for name in names}
        exponents = fit_exponents(train, values) if self.method == "yeo_johnson" else {}
        negatives = {}
        if self.method == "log1p":
            negatives = collect_aggregates(train, {n: F.count_if(values[n] < 0) for n in names})
            for name, count in negatives.items():
                if count:
                    log.warning("column %s has %d negative values; those below -1 become NaN", name, count)
        rows = [(n, self.method, "transformed", exponents.get(n), negatives.get(n), not self.columns) for n in names]
        rows += [(n, self.method, "skipped", None, None, not self.columns) for n in numeric if n not in names]
        return take_logs(rows)
