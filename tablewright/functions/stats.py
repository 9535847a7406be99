"""Aggregate passes over many columns and exact quantiles at any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.ranking import bucket_of

#: Aggregates per job: the methods generated for wider ones grow too long for the JIT
#: compiler. A job reads only its own columns, so narrow jobs read no more in total.
AGGREGATES_PER_JOB = 64
#: Moments and shapes take long expressions each: at 64 of them the methods already run uncompiled.
MEASURES_PER_JOB = 24
#: Columns whose cells are exploded and counted by one job, for the same reason.
COLUMNS_PER_JOB = 10
#: Up to this many values per column the built-in exact percentile is used. Its state is
#: one map of all distinct values in one task, so larger columns are narrowed first.
DIRECT_QUANTILE_ROWS = 50_000
#: A value range holding at most this many rows is read out and cumulated.
READABLE_ROWS = 5_000
SKETCH_ACCURACY = 10_000


def batched(items: Sequence, size: int) -> list[Sequence]:
    return [items[start : start + size] for start in range(0, len(items), max(1, size))]


def collect_aggregates(df: DataFrame, aggregates: dict[str, Column]) -> dict[str, Any]:
    """Run named whole-table aggregates, chunked over as few jobs as the width allows."""
    found: dict[str, Any] = {}
    for chunk in batched(list(aggregates), AGGREGATES_PER_JOB):
        row = df.agg(*[aggregates[name].alias(f"a{i}") for i, name in enumerate(chunk)]).first()
        found.update(zip(chunk, row))
    return found


def column_stats(
    df: DataFrame,
    values: dict[str, Column],
    measures: dict[str, Callable[[Column], Column]],
) -> dict[str, dict[str, Any]]:
    """``{column: {measure: value}}`` from one wide aggregate (chunked by column)."""
    per_job = max(1, MEASURES_PER_JOB // max(1, len(measures)))
    result: dict[str, dict[str, Any]] = {}
    for names in batched(list(values), per_job):
        exprs = [
            fn(values[name]).alias(f"c{i}_{label}")
            for i, name in enumerate(names)
            for label, fn in measures.items()
        ]
        row = df.agg(*exprs).first()
        for i, name in enumerate(names):
            result[name] = {label: row[f"c{i}_{label}"] for label in measures}
    return result


def local_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A report of driver-side size as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def settled(df: DataFrame) -> DataFrame:
    """A finished copy of a report with one line per column, pair, class or split."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def sample_skewness(n: int, g1: float | None, std: float | None) -> float | None:
    """Adjusted Fisher-Pearson skewness from the population form."""
    if n < 3 or std is None:
        return None
    if std == 0 or g1 is None or math.isnan(g1):
        return 0.0
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(n: int, g2: float | None, std: float | None) -> float | None:
    """Adjusted excess kurtosis from the population form."""
    if n < 4 or std is None:
        return None
    if std == 0 or g2 is None or math.isnan(g2):
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def moments() -> dict[str, Callable[[Column], Column]]:
    return {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }


def shape_moments() -> dict[str, Callable[[Column], Column]]:
    """Moments plus shape; a constant column yields null shape instead of an ANSI error."""
    return {**moments(), "g1": F.skewness, "g2": F.kurtosis}


# --- exact quantiles -------------------------------------------------------------------


@dataclass
class _Bracket:
    """Closed value range known to hold the order statistics ``first`` and ``second``.

    ``lo`` and ``hi`` are None while the range is the whole column.
    """

    column: str
    first: int
    second: int
    weight: float
    inside: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    slack: float = 4.0 / SKETCH_ACCURACY
    readable: bool = False
    answer: tuple[float, float] | None = None


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: Sequence[float] | dict[str, Sequence[float]],
    counts: dict[str, int],
    direct_rows: int | None = None,
    readable_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of non-null doubles.

    ``counts`` are the non-null counts per column, which every caller already has from its
    moments pass. Small columns take one ``percentile`` job. Larger ones are narrowed: a
    round takes one mergeable sketch per column, then counts exactly what lies between the
    sketched points, which shrinks the range around each rank by about a thousand times.
    Once few rows are left in a range they are counted by value and read. All counting is
    combined map-side: no round shuffles rows or holds a column in one task.
    """
    direct_rows = DIRECT_QUANTILE_ROWS if direct_rows is None else direct_rows
    readable_rows = READABLE_ROWS if readable_rows is None else readable_rows
    wanted = probs if isinstance(probs, dict) else {name: list(probs) for name in values}
    result = {name: [None] * len(wanted[name]) for name in values if counts[name] == 0}
    small = [name for name in values if 0 < counts[name] <= direct_rows]
    large = [name for name in values if counts[name] > direct_rows]
    for names in batched(small, 20):
        row = df.agg(
            *[
                F.percentile(values[name], F.array(*[F.lit(float(p)) for p in wanted[name]])).alias(f"q{i}")
                for i, name in enumerate(names)
            ]
        ).first()
        result.update({name: list(found) for name, found in zip(names, row)})
    for names in batched(large, COLUMNS_PER_JOB):
        # As plain columns: each value is compared many times but should be computed once.
        work = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
        plain = {n: F.col(f"v{i}") for i, n in enumerate(names)}
        result.update(_narrowed_quantiles(work, plain, wanted, counts, readable_rows))
    return result


def _narrowed_quantiles(df, values, wanted, counts, readable_rows):
    brackets: dict[str, list[_Bracket]] = {}
    for name in values:
        n, brackets[name] = counts[name], []
        for prob in wanted[name]:
            first = math.floor(prob * (n - 1))
            brackets[name].append(_Bracket(name, first, min(first + 1, n - 1), prob * (n - 1) - first, n))
    every = [b for held in brackets.values() for b in held]
    while pending := [b for b in every if b.answer is None and not b.readable]:
        _shrink(df, values, pending, readable_rows)
    if rest := [b for b in every if b.answer is None]:
        _read_out(df, values, rest)
    return {
        name: [b.answer[0] + (b.answer[1] - b.answer[0]) * b.weight for b in held]
        for name, held in brackets.items()
    }


def _shrink(df: DataFrame, values: dict[str, Column], brackets: list[_Bracket], readable_rows: int) -> None:
    """One round: sketch inside the brackets, then count between the sketched points."""
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.column, b.lo, b.hi), []).append(b)
    sketches = []
    for i, ((name, lo, hi), held) in enumerate(shared.items()):
        value = values[name] if lo is None else F.when(values[name].between(lo, hi), values[name])
        at = []
        for b in held:
            span = max(b.inside - 1, 1)
            at.append(max(0.0, min(1.0, (b.first - b.below) / span - b.slack)))
            at.append(max(0.0, min(1.0, (b.second - b.below) / span + b.slack)))
        sketches.append(F.percentile_approx(value, at, SKETCH_ACCURACY).alias(f"g{i}"))
    points = df.agg(*sketches).first()
    ends = {}
    for found, held in zip(points, shared.values()):
        for j, b in enumerate(held):
            ends[id(b)] = (found[2 * j], found[2 * j + 1])
    names = list({b.column for b in brackets})
    cuts = {name: sorted({e for b in brackets if b.column == name for e in ends[id(b)]}) for name in names}
    bands = _band_counts(df, {name: values[name] for name in names}, cuts)
    for b in brackets:
        _adopt(b, *ends[id(b)], cuts[b.column], bands[b.column], readable_rows)


def _band_counts(df: DataFrame, values: dict[str, Column], cuts: dict[str, list[float]]) -> dict[str, dict]:
    """``{column: {band: (count, min, max)}}``; band 2i is the values between two cuts,
    band 2i + 1 the rows equal to cut i."""
    placed, cells = {}, []
    for i, (name, value) in enumerate(values.items()):
        placed[f"at{i}"] = F.when(value.isNotNull(), bucket_of(value, cuts[name]))
        at = F.col(f"at{i}")
        band = F.when(value.isin(*cuts[name]), 2 * at - 1).otherwise(2 * at)
        cells.append(F.when(at.isNotNull(), F.struct(F.lit(i).alias("id"), band.alias("band"), value.alias("v"))))
    rows = (
        df.withColumns(placed)
        .select(F.explode(F.array(*cells)).alias("cell"))
        .where("cell is not null")
        .groupBy("cell.id", "cell.band")
        .agg(F.count(F.lit(1)), F.min("cell.v"), F.max("cell.v"))
        .collect()
    )
    found: dict[str, dict] = {name: {} for name in values}
    names = list(values)
    for i, band, n, least, most in rows:
        found[names[i]][band] = (n, least, most)
    return found


def _adopt(b: _Bracket, lo: float, hi: float, cuts: list[float], bands: dict, readable_rows: int) -> None:
    """Settle the two ranks, or move to the range strictly between ``lo`` and ``hi``.

    The end values themselves are always split off, so that a value held by very many rows
    cannot stall a bracket.
    """
    at_lo, at_hi = 2 * cuts.index(lo) + 1, 2 * cuts.index(hi) + 1
    below = sum(held[0] for band, held in bands.items() if band < at_lo)
    low_end = below + bands[at_lo][0]
    high_start = sum(held[0] for band, held in bands.items() if band < at_hi)
    high_end = high_start + bands[at_hi][0]
    if b.first < below or b.second >= high_end:
        b.slack *= 8
        return
    inner = [held for band, held in bands.items() if at_lo < band < at_hi]

    def settled(rank: int) -> float | None:
        if rank < low_end:
            return lo
        return hi if rank >= high_start else None

    first, second = settled(b.first), settled(b.second)
    if first is None and second is None:
        b.lo, b.hi = min(held[1] for held in inner), max(held[2] for held in inner)
        b.below, b.inside = low_end, high_start - low_end
        b.readable = b.inside <= readable_rows
        if b.lo == b.hi:
            b.answer = (b.lo, b.hi)
        return
    if first is None:
        first = max(held[2] for held in inner)
    if second is None:
        second = min(held[1] for held in inner)
    b.answer = (first, second)


def _merged(ranges: set[tuple[float, float]]) -> list[tuple[float, float]]:
    """Overlapping ranges joined, in order."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _read_out(df: DataFrame, values: dict[str, Column], brackets: list[_Bracket]) -> None:
    """Count the few rows left in every bracket by value and pick the wanted ranks."""
    names = list({b.column for b in brackets})
    held, cells = {}, []
    for i, name in enumerate(names):
        ranges = _merged({(b.lo, b.hi) for b in brackets if b.column == name})
        at = bucket_of(values[name], [lo for lo, _ in ranges])
        end = F.try_element_at(F.array(*[F.lit(hi) for _, hi in ranges]), F.greatest(at, F.lit(1)))
        held[f"in{i}"] = F.coalesce((values[name] >= ranges[0][0]) & (values[name] <= end), F.lit(False))
        cells.append(F.when(F.col(f"in{i}"), F.struct(F.lit(i).alias("id"), values[name].alias("v"))))
    rows = (
        df.withColumns(held)
        .where(F.greatest(F.lit(False), *[F.col(c) for c in held]))
        .select(F.explode(F.array(*cells)).alias("cell"))
        .where("cell is not null")
        .groupBy("cell.id", "cell.v")
        .count()
        .collect()
    )
    tables: dict[str, list[tuple[float, int]]] = {name: [] for name in names}
    for i, value, held in rows:
        tables[names[i]].append((value, held))
    for b in brackets:
        picks, seen = [], b.below
        for value, held in sorted(v for v in tables[b.column] if b.lo <= v[0] <= b.hi):
            seen += held
            picks += [value for rank in (b.first, b.second)[len(picks) :] if rank < seen]
        b.answer = (picks[0], picks[1])
