"""Codes at given positions of each class, without ordering rows.

One scan counts codes by class and leading bits, combined before the shuffle. That table, at most ``2 ** CELL_BITS`` lines a
class, says which cell holds a position, how many rows come before it, and what the class has in all. A second scan looks only
at the cells that hold a position: their codes are counted and ranked, or, where a cell holds very many rows, counted by
their next bits first. A cell of one code needs no second look, so a code that many or all rows share costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.keep import lookup, stored

CELL_BITS = 16


def _shift(low: int, high: int) -> int:
    return max(0, (high - low).bit_length() - CELL_BITS)


def _cell(low: int, shift: int) -> Column:
    return F.shiftright(F.col("_code") - F.lit(low), shift)


def count_cells(codes: DataFrame, low: int, high: int) -> DataFrame:
    """Per (_class, cell): rows, least and largest code, and the class's rows up to the end of the cell; a small stored table."""
    counted = codes.groupBy("_class", _cell(low, _shift(low, high)).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_code").alias("lo"), F.max("_code").alias("hi")
    )
    return stored(counted.withColumn("upto", F.sum("n").over(Window.partitionBy("_class").orderBy("cell"))), "cells")


def class_totals(cells: DataFrame) -> DataFrame:
    """``(_class, count)``."""
    return cells.groupBy("_class").agg(F.sum("n").alias("count"))


def positions(
    codes: DataFrame, cells: DataFrame, wanted: DataFrame, low: int, high: int, per_ranking: int
) -> DataFrame:
    """``(_class, which, rank, code, before, equal)`` for each ``(_class, which, rank)``, ranks counted from 1.

    ``before`` rows of the class have a smaller code, ``equal`` ones the same. ``cells`` is what ``count_cells`` gave for the
    same codes and range. A cell of up to ``per_ranking`` rows is ranked by one task.
    """
    shift = _shift(low, high)
    held = cells.join(wanted, "_class").where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
    held = held.withColumn("before", F.col("upto") - F.col("n")).drop("upto")  # cheap: from the table of cells alone
    names = ["_class", "which", "rank", "code", "before", "equal"]
    settled = held.where("lo = hi").withColumnsRenamed({"lo": "code", "n": "equal"}).select(names)
    rest = held.where("lo < hi")
    many, largest = rest.agg(F.count(F.lit(1)), F.max("n")).first()
    if not many:
        return settled
    places = lookup(rest.select("_class", "cell").distinct(), many)
    inside = codes.withColumn("cell", _cell(low, shift)).join(places, ["_class", "cell"])
    if largest <= per_ranking:
        counted = inside.groupBy("_class", "cell", F.col("_code").alias("code")).agg(F.count(F.lit(1)).alias("equal"))
        over = Window.partitionBy("_class", "cell").orderBy("code")
        ranked = counted.withColumn("upto", F.sum("equal").over(over))
        found = ranked.join(lookup(rest.select("_class", "cell", "which", "rank", "before"), many), ["_class", "cell"])
        upto = F.col("before") + F.col("upto")
        found = found.where((F.col("rank") > upto - F.col("equal")) & (F.col("rank") <= upto))
        found = found.withColumn("before", upto - F.col("equal"))
    else:
        one = F.struct("_class", "cell").alias("_class")
        finer = inside.select(one, (F.col("_code") - F.lit(low) - F.shiftleft("cell", shift)).alias("_code"))
        top = (1 << shift) - 1
        asked = rest.select(one, "which", (F.col("rank") - F.col("before")).alias("rank"))
        deep = positions(finer, count_cells(finer, 0, top), asked, 0, top, per_ranking)
        deep = deep.select("_class._class", "_class.cell", "which", "code", F.col("before").alias("inner"), "equal")
        found = deep.join(rest.select("_class", "cell", "which", "rank", "before"), ["_class", "cell", "which"])
        found = found.withColumns(
            {"code": F.lit(low) + F.shiftleft("cell", shift) + F.col("code"), "before": F.col("before") + F.col("inner")}
        )
    return settled.unionByName(found.select(names))
