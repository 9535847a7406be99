"""Reproducible hold-out splits without shuffling rows.

A row's part depends on a hash of its key and the seed, so the parts are disjoint and
complete, do not change with partitioning, and are recomputed identically after a failure.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import FLOAT_TYPES, as_text, col, dtype, require_target, resolve_columns
from tablewright.functions.hashing import HASH_BITS, HASH_RANGE, digits_below, key_digits, key_hash
from tablewright.functions.keep import lookup, stored
from tablewright.functions.selection import class_totals, count_cells, positions
from tablewright.functions.stats import local_frame
from tablewright.splits import Splits

#: Rows next to one cut that may be ranked by one task.
ROWS_PER_RANKING = 1_000_000
#: Equal rows that are laid out from one list.
COPIES = 65_536
MIN_CLASS_ROWS = 3
#: Too small classes that an error message names.
LISTED_CLASSES = 20


@dataclass(frozen=True)
class Assignment:
    """The input with a ``split`` column; ``splits()`` gives the three tables."""

    tagged: DataFrame

    def splits(self) -> Splits:
        return Splits.of(self.tagged)


def _key(df: DataFrame, key: str | Sequence[str] | None) -> list[str]:
    return resolve_columns(df, key, on_missing="error") or list(df.columns)


def _check_sizes(test: float, val: float) -> None:
    if not (0 <= test < 1 and 0 <= val < 1 and test + val < 1):
        raise ValueError(f"test size {test} and validation size {val} must be shares that leave rows to train on")


def random_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    key: str | Sequence[str] | None = None,
    stratify: str | None = None,
    exact: bool = False,
    order_by: str | None = None,
) -> Assignment:
    """Random hold-out.

    By default each row is placed by its own hash: no shuffle, shares correct on average.
    ``exact`` gives exact sizes, ``stratify`` exact shares per class, and ``order_by``
    splits by the order of an integer, date or timestamp column instead of at random.
    Identical keys share a part, but for the keys at the cuts of an ``exact`` split; without ``key`` the whole row is the key.
    """
    _check_sizes(test_size, val_size)
    if stratify:
        require_target(df, stratify)
        return _by_class(df, stratify, val_size, test_size, seed, _key(df, key))
    if order_by:
        return _sequential(df, order_by, test_size, val_size)
    if not exact:
        digits = key_digits(df, _key(df, key), seed)
        part = (
            F.when(digits < digits_below(test_size), "test")
            .when(digits < digits_below(test_size + val_size), "val")
            .otherwise("train")
        )
        return Assignment(df.withColumn("split", part))
    return _exact(df, key_hash(df, _key(df, key), seed), lambda n: exact_sizes(n, test_size, val_size))


def exact_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int]:
    """Test rows, then validation rows as a share of the rest; both rounded up."""
    n_test = math.ceil(n * test_size)
    rest = n - n_test
    n_val = math.ceil(rest * (val_size / (1 - test_size))) if val_size > 0 else 0
    return n_test, n_val


def _sequential(df: DataFrame, order_by: str, test_size: float, val_size: float) -> Assignment:
    """First rows to train, then validation, last rows to test, in the order of a column; rows without a value are last."""
    position = _order_code(df, order_by)
    n, low, last = df.agg(F.count(F.lit(1)), F.min(position), F.max(position)).first()
    low, last = (0, -1) if last is None else (low, last)
    position = F.coalesce(position, F.lit(last + 1).cast("long"))  # rows without a value come last
    n_test, n_val = exact_sizes(n, test_size, val_size)
    codes = df.select(F.lit("").alias("_class"), position.alias("_code"))
    cells = count_cells(codes, low, last + 1)
    counts = local_frame(
        df.sparkSession,
        [("", n - n_test - n_val, n - n_test)],
        "_class string, cut_test long, cut_val long",
    )
    return _cut(df, F.lit(""), position, cells, counts, (low, last + 1), parts=("train", "val", "test"))


def _order_code(df: DataFrame, name: str) -> Column:
    """A non-negative long that sorts like the column."""
    kind = dtype(df, name).simpleString()
    value = col(name)
    if kind in ("timestamp", "timestamp_ntz"):
        value = F.unix_micros(value.cast("timestamp"))
    elif kind == "date":
        value = F.unix_date(value)
    elif kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"order_by needs an integer, date or timestamp column; {name!r} is {kind}")
    return value.cast("long")


def _class_of(df: DataFrame, target: str) -> Column:
    return F.coalesce(as_text(df, target), F.lit("\\N"))


def _by_class(df, target, val_size, test_size, seed, key, least: int = 0) -> Assignment:
    """Per-class cut positions, each share rounded to the nearest row. One scan counts, one finds the cuts, one places rows."""
    label, code = _class_of(df, target), key_hash(df, key, seed)
    cells = count_cells(df.select(label.alias("_class"), code.alias("_code")), 0, HASH_RANGE - 1)
    counts = class_totals(cells)
    if least:
        _refuse_small(counts.where(F.col("count") < least).withColumnRenamed("_class", "label"))
    n_test = F.floor(F.col("count") * test_size + 0.5)
    n_val = F.floor(F.col("count") * val_size + 0.5)
    cuts = counts.select("_class", n_test.alias("cut_test"), (n_test + n_val).alias("cut_val"))
    return _cut(df, label, code, cells, cuts, (0, HASH_RANGE - 1))


def _wanted(cuts: DataFrame) -> DataFrame:
    """Positions to look for; a position of 0 is none."""
    pair = [F.struct(F.lit(t).alias("which"), F.col(c).alias("rank")) for t, c in (("t_test", "cut_test"), ("t_val", "cut_val"))]
    return cuts.select("_class", F.explode(F.array(*pair)).alias("w")).select("_class", "w.which", "w.rank").where("rank > 0")


def _cut(
    df: DataFrame,
    label: Column,
    code: Column,
    cells: DataFrame,
    cuts: DataFrame,
    ends: tuple[int, int],
    parts: tuple[str, str, str] = ("test", "val", "train"),
) -> Assignment:
    """Place rows by comparing their code with two thresholds of their class.

    Only (class, code) pairs are looked at to find the thresholds; the rows themselves meet
    a table of one line per class, which is broadcast unless there are very many classes.
    Rows that share the code at a threshold stay together, on the side below it.
    """
    codes = df.select(label.alias("_class"), code.alias("_code"))
    found = positions(codes, cells, _wanted(cuts), *ends, ROWS_PER_RANKING)
    thresholds = found.groupBy("_class").agg(*[F.max(F.when(F.col("which") == t, F.col("code"))).alias(t) for t in ("t_test", "t_val")])
    classes = cells.select("_class").distinct().count()
    placed = (
        F.when(F.col("_code") <= F.col("t_test"), parts[0])
        .when(F.col("_code") <= F.col("t_val"), parts[1])
        .otherwise(parts[2])
    )
    rows = df.withColumns({"_class": label, "_code": code}).join(lookup(thresholds, classes), "_class", "left")
    return Assignment(rows.withColumn("split", placed).select(*[col(c) for c in df.columns], "split"))


def _exact(
    df: DataFrame,
    code: Column,
    sizes: Callable[[int], tuple[int, int]],
    parts: tuple[str, str, str] = ("test", "val", "train"),
    by_content: bool = False,
) -> Assignment:
    """Exactly as many rows to each part as ``sizes`` says of their number, in the order of a code below ``HASH_RANGE``.

    Rows that share the code at a cut are ordered by a hash of their content, and equal rows are told apart by number only.
    """
    codes = df.select(F.lit("").alias("_class"), code.alias("_code"))
    cells = count_cells(codes, 0, HASH_RANGE - 1)
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first, second = sizes(n)
    cuts = local_frame(df.sparkSession, [("", first, first + second)], "_class string, cut_test long, cut_val long")
    found = positions(codes, cells, _wanted(cuts), 0, HASH_RANGE - 1, ROWS_PER_RANKING).collect()
    limits = {r["which"]: r["code"] for r in found}
    split = F.when(code <= F.lit(limits.get("t_test", -1)), parts[0]).when(code <= F.lit(limits.get("t_val", -1)), parts[1]).otherwise(parts[2])
    torn = {r["code"]: (r["before"], r["equal"]) for r in found if r["rank"] < r["before"] + r["equal"]}
    if not torn:
        return Assignment(df.withColumn("split", split))
    content = F.shiftrightunsigned(F.xxhash64(*[col(c) for c in df.columns]), 64 - HASH_BITS)
    tagged = df.where(~code.isin(list(torn))).withColumn("split", split)
    for value, (before, equal) in torn.items():
        cut = [min(max(at - before, 0), equal) for at in (first, first + second)]
        tied = df.where(code == F.lit(value))
        if by_content:
            tagged = tagged.unionByName(_numbered(tied, *cut, parts))
        else:
            tagged = tagged.unionByName(_exact(tied, content, lambda _, cut=cut: (cut[0], cut[1] - cut[0]), parts, by_content=True).tagged)
    return Assignment(tagged)


def _numbered(df: DataFrame, first: int, second: int, parts: tuple[str, str, str]) -> DataFrame:
    """Equal rows, the first ``first`` to one part, those up to ``second`` to the next, the rest to the last.

    They are counted per task, and each count is laid out again as rows: no task holds them all. The running total over
    tasks has one line per task and different row.
    """
    counted = df.withColumn("_task", F.spark_partition_id()).groupBy(*[col(c) for c in df.columns], "_task").agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted, "equal-rows")
    upto = F.sum("_n").over(Window.orderBy("_task", F.xxhash64(*[col(c) for c in df.columns])))
    placed = counted.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    zero = F.lit(0).cast("long")
    bounds = [(zero, F.lit(first).cast("long")), (F.lit(first).cast("long"), F.lit(second).cast("long")), (F.lit(second).cast("long"), F.col("_upto"))]
    shares = [
        F.struct(F.lit(part).alias("split"), F.greatest(zero, F.least("_upto", hi) - F.greatest("_before", lo)).alias("k"))
        for part, (lo, hi) in zip(parts, bounds, strict=True)
    ]
    each = placed.withColumn("_share", F.explode(F.array(*shares))).where("_share.k > 0")
    each = each.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_share.k - 1) div {COPIES})")))
    copies = F.explode(F.expr(f"sequence(1L, least({COPIES}L, _share.k - _block * {COPIES}))"))
    return each.withColumn("_copy", copies).select(*[col(c) for c in df.columns], F.col("_share.split").alias("split"))


def stratified_split(
    df: DataFrame,
    target: str | None,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    test_ratio: float = 0.15,
    seed: int = 42,
    key: str | Sequence[str] | None = None,
) -> Assignment:
    """Hold-out with the same class shares in every part, checked before it is built."""
    _check_target(df, target, train_ratio + val_ratio + test_ratio)
    return _by_class(df, target, val_ratio, test_ratio, seed, _key(df, key), MIN_CLASS_ROWS)


def small_classes(df: DataFrame, target: str) -> DataFrame:
    """Classes with too few rows to appear in three parts."""
    return df.groupBy(_class_of(df, target).alias("label")).count().where(F.col("count") < MIN_CLASS_ROWS)


def check_stratified(df, target, train_ratio=0.7, val_ratio=0.15, test_ratio=0.15) -> None:
    _check_target(df, target, train_ratio + val_ratio + test_ratio)
    _refuse_small(small_classes(df, target))


def _check_target(df: DataFrame, target: str | None, ratios: float) -> None:
    total = round(ratios, 10)
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"the three ratios must sum to 1, not {total}")
    require_target(df, target)
    if isinstance(dtype(df, target), FLOAT_TYPES):
        broken = df.where(col(target).isNotNull() & (col(target) != F.floor(col(target)))).limit(1).count()
        if broken:
            raise ValueError(f"target {target!r} is continuous; bin it before a stratified split")


def _refuse_small(few: DataFrame) -> None:
    shown = few.orderBy("label").limit(LISTED_CLASSES + 1).collect()
    if shown:
        listed = {row["label"]: row["count"] for row in shown[:LISTED_CLASSES]}
        more = f" and {few.count() - LISTED_CLASSES} more" if len(shown) > LISTED_CLASSES else ""
        raise ValueError(f"every class needs at least {MIN_CLASS_ROWS} rows, but found {listed}{more}")
