"""Sums of products of many columns in one pass, with gaps.

Each task multiplies its rows as matrices: values with 0 in place of a gap, and a mask that is 1 where there is a value. Every
pair's own count, sums and squares come out of the four products, whichever rows it shares. A task sends one line per pair;
the lines are added by an ordinary grouped sum. Nothing but the sums, a few numbers per pair of columns, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import importable

#: Cells a task turns into one matrix.
CELLS_AT_ONCE = 4_000_000


def matrices(batches: Iterator[pa.RecordBatch], width: int, per_row: int | None = None) -> Iterator[np.ndarray]:
    """The first ``width`` columns of Arrow batches as matrices of doubles, nulls as NaN; one line per column."""
    step = max(1, CELLS_AT_ONCE // max(1, per_row or width))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            rows = [part.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
            yield np.array(rows, np.float64).reshape(width, part.num_rows)


def plain_columns(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])


@dataclass(frozen=True)
class Products:
    """Per pair of columns, over the rows where both have a value: ``n`` rows, ``s[i, j]`` sum and ``ss[i, j]`` sum of squares
    of column i, ``sp`` sum of products. Values are taken relative to the centre of their column."""

    n: np.ndarray
    s: np.ndarray
    ss: np.ndarray
    sp: np.ndarray

    def moments(self, i: int, j: int) -> tuple[float, float, float]:
        """Centred sums of squares of i and j, and of products."""
        n = self.n[i, j]
        if n == 0:
            return 0.0, 0.0, 0.0
        a, b = self.s[i, j], self.s[j, i]
        return self.ss[i, j] - a * a / n, self.ss[j, i] - b * b / n, self.sp[i, j] - a * b / n

    def doubtful(self, i: int, j: int) -> bool:
        """Whether a side spreads so little around a value far from its centre that rounding may be all that is left."""
        sxx, syy, _ = self.moments(i, j)
        return sxx <= 1e-9 * self.ss[i, j] or syy <= 1e-9 * self.ss[j, i]


def masked_products(df: DataFrame, values: dict[str, Column], centres: Sequence[float]) -> Products:
    """All pairs of columns in one pass over the rows."""
    importable(df.sparkSession)
    k = len(values)
    middle = np.array(centres, np.float64)[:, None]
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, sp = (np.zeros((k, k)) for _ in range(4))
        for rows in matrices(batches, k):
            mask = ~np.isnan(rows)
            x = np.where(mask, rows - middle, 0.0)
            mask = mask.astype(np.float64)
            n += mask @ mask.T
            s += x @ mask.T
            ss += (x * x) @ mask.T
            sp += x @ x.T
        i, j = upper
        numbers = [n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], sp[i, j]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, numbers)], ["i", "j", *names]
        )

    names = ["n", "si", "sj", "ssi", "ssj", "sp"]
    lines = plain_columns(df, values).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    found = Products(*(np.zeros((k, k)) for _ in range(4)))
    for i, j, n, si, sj, ssi, ssj, sp in lines.groupBy("i", "j").agg(*[F.sum(c) for c in names]).collect():
        found.n[i, j] = found.n[j, i] = n
        found.sp[i, j] = found.sp[j, i] = sp
        found.s[i, j], found.s[j, i] = si, sj
        found.ss[i, j], found.ss[j, i] = ssi, ssj
    return found


def pair_moments(
    df: DataFrame, values: dict[str, Column], pairs: Sequence[tuple[int, int]], centres: Sequence[tuple[float, float]]
) -> dict[tuple[int, int], tuple[float, float, float, bool]]:
    """Centred sums of squares and products of some pairs, each around centres of its own, and whether a side is constant.

    One pass, for the pairs of which the products say too little.
    """
    importable(df.sparkSession)
    k = len(values)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    ends = ["lox", "hix", "loy", "hiy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pairs), 6))
        seen = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(pairs), 1))
        for rows in matrices(batches, k):
            mask = ~np.isnan(rows)
            for at, ((i, j), (a, b)) in enumerate(zip(pairs, centres, strict=True)):
                both = mask[i] & mask[j]
                if both.any():
                    raw_x, raw_y = rows[i][both], rows[j][both]
                    x, y = raw_x - a, raw_y - b
                    sums[at] += len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
                    seen[at] = (
                        min(seen[at, 0], raw_x.min()), max(seen[at, 1], raw_x.max()),
                        min(seen[at, 2], raw_y.min()), max(seen[at, 3], raw_y.max()),
                    )
        arrays = [pa.array(np.arange(len(pairs), dtype=np.int32)), *map(pa.array, sums.T), *map(pa.array, seen.T)]
        yield pa.RecordBatch.from_arrays(arrays, ["pair", *names, *ends])

    lines = plain_columns(df, values).mapInArrow(run, "pair int, " + ", ".join(f"{c} double" for c in [*names, *ends]))
    sums = [F.sum(c) for c in names] + [(F.min if c.startswith("lo") else F.max)(c) for c in ends]
    found = {}
    for at, n, sx, sy, sxx, syy, sxy, lox, hix, loy, hiy in lines.groupBy("pair").agg(*sums).collect():
        constant = n == 0 or lox == hix or loy == hiy
        n = max(n, 1.0)
        found[pairs[at]] = (sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n, constant)
    return found
