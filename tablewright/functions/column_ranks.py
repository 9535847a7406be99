"""Spearman correlation of many columns at once: ranks without a join per column or pair.

A column is cut at points of its own: all its values if they are few, else points of a quantile sketch. A value that equals a
point has a band of its own, so a value that fills much of a column is a band and never sorted; the others fall between two
points. One counting pass gives the number of rows in every band, hence the first rank of each.

Ranks of bands of one value are then known in the task that reads the row. If that holds for all columns, the products of
ranks come out of that same pass and no row is moved. Other cells travel as (row, column, value): once to the task of their
band, which ranks them, and once back to their row. That is two exchanges, however many columns there are.

Ranks count only rows that a pair shares. Columns with the same gaps share their masks, so a column is ranked once per
different set of gaps it meets, not once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.keep import spread, stored_while
from tablewright.functions.products import CELLS_AT_ONCE, masked_products, matrices, plain_columns
from tablewright.session import importable

#: Values of all columns with few values together, as tables in every task (8 bytes each, twice per set of gaps).
TABLED_VALUES = 200_000
#: Rows of a band, as far as ``MAX_POINTS`` allows, and rows that one task sorts.
ROWS_PER_BAND = 100_000
ROWS_PER_TASK = 250_000
MIN_POINTS, MAX_POINTS = 64, 4_000


@dataclass(frozen=True)
class Ranked:
    """A column ranked among the rows where another one, ``gaps``, has a value too (-1: among all its own)."""

    column: int
    gaps: int


def _bands(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Band 2 i + 1 holds the values equal to point i, band 2 i those between it and the point before."""
    at = np.searchsorted(points, x)
    return 2 * at + (points[np.minimum(at, len(points) - 1)] == x) if len(points) else 2 * at


def _gap_classes(work: DataFrame, k: int, complete: Sequence[bool]) -> list[int]:
    """For each column the first one with the same gaps; -1 for columns without."""
    classes = [-1] * k
    gappy = [i for i in range(k) if not complete[i]]
    if gappy:
        flags = {f"m{i}": F.when(F.col(f"v{i}").isNotNull(), F.lit(1.0)) for i in gappy}
        n = masked_products(work, flags, [0.0] * len(gappy)).n
        for a, i in enumerate(gappy):
            same = [b for b in range(len(gappy)) if n[a, a] == n[b, b] == n[a, b]]
            classes[i] = gappy[same[0]]
    return classes


def _points(work: DataFrame, rows: int, distinct: Sequence[int], per_band: int, tabled: int) -> list[np.ndarray]:
    """Cut points of every column, in one job for those with few values and one for the others."""
    points: list[np.ndarray] = [np.zeros(0)] * len(distinct)
    few, room = [], tabled
    for i in sorted(range(len(distinct)), key=lambda i: distinct[i]):
        if distinct[i] * 5 // 4 <= room:
            few.append(i)
            room -= distinct[i] * 5 // 4
    many = [i for i in range(len(distinct)) if i not in few]
    if few:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("x")) for i in few]))
        held: dict[int, list[float]] = {i: [] for i in few}
        for i, x in work.select(cells.alias("c")).select("c.i", "c.x").where("x is not null").distinct().collect():
            held[i].append(x)
        for i in few:
            points[i] = np.unique(np.array(held[i], np.float64))
    if many:
        wanted = min(MAX_POINTS, max(MIN_POINTS, rows // per_band))
        shares = [(q + 0.5) / wanted for q in range(wanted)]
        found = work.agg(*[F.percentile_approx(f"v{i}", shares, 10 * wanted).alias(f"q{i}") for i in many]).first()
        for i, cuts in zip(many, found, strict=True):
            points[i] = np.unique(np.array(cuts or [], np.float64))
    return points


class _Plan:
    """What every task needs to know: the ranked columns, their points, and what the bands say about ranks."""

    def __init__(self, ranked: list[Ranked], width: int, points: list[np.ndarray]):
        self.ranked, self.width, self.points = ranked, width, points
        self.first: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.open: list[int] = []

    def bands(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per ranked column the rows it covers and their bands."""
        mask = ~np.isnan(rows)
        of_column: dict[int, np.ndarray] = {}
        for v, (column, gaps) in enumerate((r.column, r.gaps) for r in self.ranked):
            if column not in of_column:
                of_column[column] = _bands(np.where(mask[column], rows[column], 0.0), self.points[column])
            covered = mask[column] if gaps < 0 else mask[column] & mask[gaps]
            yield v, covered, of_column[column]

    def settle(self, counts: list[np.ndarray]) -> None:
        """From rows per band: the rank before each band, and centred ranks where a band has one value or row."""
        for v, n in enumerate(counts):
            centre = (n.sum() + 1) / 2
            before = np.cumsum(n) - n - centre
            one = (np.arange(len(n)) % 2 == 1) | (n <= 1)
            self.first.append(before)
            self.known.append(np.where(one, before + (n + 1) / 2, np.nan))
            if not one.all():
                self.open.append(v)

    def known_ranks(self, rows: np.ndarray) -> np.ndarray:
        """Centred ranks, one line per ranked column: 0 where a row is not covered, NaN where only a sort can tell."""
        out = np.zeros((len(self.ranked), rows.shape[1]))
        for v, covered, bands in self.bands(rows):
            out[v, covered] = self.known[v][bands[covered]]
        return out


def _count_bands(work: DataFrame, plan: _Plan) -> list[np.ndarray]:
    k, sizes = plan.width, [2 * len(plan.points[r.column]) + 1 for r in plan.ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(size, np.int64) for size in sizes]
        for rows in matrices(batches, k):
            for v, covered, bands in plan.bands(rows):
                held[v] += np.bincount(bands[covered], minlength=sizes[v])
        for v, n in enumerate(held):
            filled = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(filled), v, np.int32)), pa.array(filled), pa.array(n[filled])], ["v", "band", "n"]
            )

    counts = [np.zeros(size, np.int64) for size in sizes]
    lines = work.mapInArrow(run, "v int, band long, n long").groupBy("v", "band").agg(F.sum("n"))
    for v, band, n in lines.collect():
        counts[v][band] = n
    return counts


class _Blocks:
    """Products of centred ranks for the pairs that are asked for, by pairs of gap classes."""

    def __init__(self, pairs: Sequence[tuple[int, int]], gaps: list[int], ranked: list[Ranked]):
        blocks: dict[tuple, set[tuple[int, int]]] = {}
        for a, b in pairs:
            blocks.setdefault((gaps[a], gaps[b]), set()).add((a, b))
        self.sides = [(sorted({a for a, _ in held}), sorted({b for _, b in held})) for held in blocks.values()]
        self.wanted = {(a, b) for a, b in pairs}
        self.many = len(ranked)

    def start(self) -> list[np.ndarray]:
        return [np.zeros((len(a), len(b))) for a, b in self.sides] + [np.zeros(self.many)]

    def add(self, held: list[np.ndarray], ranks: np.ndarray) -> None:
        for total, (a, b) in zip(held, self.sides):
            total += ranks[a] @ ranks[b].T
        held[-1] += (ranks * ranks).sum(axis=1)

    def lines(self, held: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(a, b, total[x, y]) for total, (sa, sb) in zip(held, self.sides) for x, a in enumerate(sa) for y, b in enumerate(sb) if (a, b) in self.wanted]
        rows += [(v, v, s) for v, s in enumerate(held[-1])]
        a, b, s = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s, pa.float64())], ["a", "b", "s"])


LINE = "a int, b int, s double"


def _products_in_place(work: DataFrame, plan: _Plan, blocks: _Blocks) -> DataFrame:
    k = plan.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = blocks.start()
        for rows in matrices(batches, k, max(k, len(plan.ranked))):
            blocks.add(held, plan.known_ranks(rows))
        yield blocks.lines(held)

    return work.mapInArrow(run, LINE)


def _products_by_exchange(work: DataFrame, plan: _Plan, blocks: _Blocks, rows: int = 0, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Open cells go to the task of their band, are ranked there, and meet the known ranks of their row again.

    The number of tasks grows with the rows, so that what a task sorts does not.
    """
    k, many = plan.width, len(plan.ranked)
    tasks = max(work.sparkSession.sparkContext.defaultParallelism, 1 + rows * len(plan.open) // per_task)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS_AT_ONCE // many)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                (rows,) = matrices(iter([part]), k, 1)
                ids = part.column(k).to_numpy()
                ranks = plan.known_ranks(rows)
                told = np.zeros(len(ids), bool)
                for v, covered, bands in plan.bands(rows):
                    if v not in plan.open:
                        continue
                    at = np.flatnonzero(covered & np.isnan(ranks[v]))
                    first = at[~told[at]]  # the first open cell of a row carries what is known of it
                    told[at] = True
                    yield line(ids, at, v, bands[at], rows[plan.ranked[v].column][at], plan.first[v][bands[at]], first, ranks)
                rest = np.flatnonzero(~told)
                yield line(ids, rest, -1, ids[rest] % 65_536, np.zeros(len(rest)), np.zeros(len(rest)), rest, ranks)

    def line(ids, at, v, band, value, base, first, ranks) -> pa.RecordBatch:
        known = np.nan_to_num(ranks[:, first]).T.ravel()
        lengths = np.where(np.isin(at, first, assume_unique=True), many, 0)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(known, pa.float64()))
        columns = [pa.array(ids[at]), pa.array(np.full(len(at), v, np.int32)), pa.array(band.astype(np.int64)), pa.array(value), pa.array(base), lists]
        return pa.RecordBatch.from_arrays(columns, ["row", "v", "band", "value", "base", "known"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = blocks.start()
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, CELLS_AT_ONCE // many)):
                part = batch.slice(start, max(1, CELLS_AT_ONCE // many))
                ranks = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, many).T.copy()
                sorted_cells = part.column(1)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(sorted_cells).to_numpy(zero_copy_only=False))
                flat = sorted_cells.flatten()
                v = flat.field("v").to_numpy(zero_copy_only=False)
                x = flat.field("x").to_numpy(zero_copy_only=False)
                open_cells = v >= 0
                ranks[v[open_cells], row[open_cells]] = x[open_cells]
                blocks.add(held, ranks)
        yield blocks.lines(held)

    numbered = work.withColumn("row", F.monotonically_increasing_id())
    sent = numbered.mapInArrow(cells, "row long, v int, band long, value double, base double, known array<double>")
    sent = sent.repartition(tasks, "v", "band")
    band = Window.partitionBy("v", "band")
    rank = F.rank().over(band.orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy("v", "band", "value")) - 1) / 2
    ranked = sent.select("row", "known", F.struct("v", (F.col("base") + rank).alias("x")).alias("cell"))
    if len(plan.open) == 1:  # every row is one line, with all that is known of it
        together = ranked.select("known", F.array("cell").alias("cells"))
    else:
        together = ranked.repartition(tasks, "row").groupBy("row").agg(F.max("known").alias("known"), F.collect_list("cell").alias("cells"))
    return together.select("known", "cells").mapInArrow(products, LINE)


def rank_correlations(
    df: DataFrame,
    values: dict[str, Column],
    pairs: Sequence[tuple[str, str]],
    facts: dict[str, dict],
    per_band: int | None = None,
    tabled: int | None = None,
    per_task: int | None = None,
) -> dict[tuple[str, str], float | None]:
    """Pearson r of average ranks per pair; null where a side is constant among the rows the pair shares.

    ``facts`` has rows, count and an estimate of distinct values of each column.
    """
    importable(df.sparkSession)
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    at = {n: i for i, n in enumerate(names)}
    k, rows = len(names), max((facts[n]["rows"] for n in names), default=0)
    plain = plain_columns(df, {n: values[n] for n in names})
    gaps = _gap_classes(plain, k, [facts[n]["count"] == facts[n]["rows"] for n in names])
    ranked: dict[Ranked, int] = {}

    def ranked_for(a: int, b: int) -> int:
        other = gaps[b] if gaps[b] >= 0 and gaps[b] != gaps[a] else -1
        return ranked.setdefault(Ranked(a, other), len(ranked))

    asked = [(ranked_for(at[a], at[b]), ranked_for(at[b], at[a])) for a, b in pairs]
    columns = list(ranked)
    distinct = [max(1, facts[n]["distinct"]) * sum(r.column == at[n] for r in columns) for n in names]
    tabled = TABLED_VALUES if tabled is None else tabled
    moved = sum(d * 5 // 4 for d in distinct) > tabled
    with stored_while(spread(plain), "ranks") if moved else nullcontext(plain) as work:
        points = _points(work, rows, distinct, per_band or ROWS_PER_BAND, tabled)
        plan = _Plan(columns, k, points)
        plan.settle(_count_bands(work, plan))
        blocks = _Blocks(asked, [r.gaps if r.gaps >= 0 else gaps[r.column] for r in columns], columns)
        if plan.open:
            lines = _products_by_exchange(work, plan, blocks, rows, ROWS_PER_TASK if per_task is None else per_task)
        else:
            lines = _products_in_place(work, plan, blocks)
        found = {(a, b): s for a, b, s in lines.groupBy("a", "b").agg(F.sum("s")).collect()}
    result = {}
    for pair, (a, b) in zip(pairs, asked, strict=True):
        squares = found.get((a, a), 0.0) * found.get((b, b), 0.0)
        result[pair] = max(-1.0, min(1.0, found.get((a, b), 0.0) / squares**0.5)) if squares > 0 else None
    return result
