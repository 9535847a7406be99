"""Train / validation / test tables moved through a job together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("train", "val", "test")


@dataclass(frozen=True)
class Splits:
    """Three tables, or three views of one table with a ``split`` column (``source``).

    Work that treats all parts alike runs once over ``source`` instead of once per part.
    """

    train: DataFrame | None
    val: DataFrame | None = None
    test: DataFrame | None = None
    source: DataFrame | None = None

    @staticmethod
    def of(tagged: DataFrame) -> Splits:
        return Splits(
            **{part: tagged.where(F.col("split") == part).drop("split") for part in PARTS}, source=tagged
        )

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for name in PARTS:
            frame = getattr(self, name)
            if frame is not None:
                yield name, frame

    def each(self, fn: Callable[[DataFrame], DataFrame]) -> Splits:
        """Apply any function to the parts one by one."""
        return Splits(**{"train": None, **{name: fn(frame) for name, frame in self.items()}})

    def project(self, fn: Callable[[DataFrame], DataFrame]) -> Splits:
        """Apply a function that works row by row and lets a ``split`` column pass."""
        return self.each(fn) if self.source is None else Splits.of(fn(self.source))

    def tagged(self) -> DataFrame:
        """All parts in one table with a ``split`` column."""
        if self.source is not None:
            return self.source
        frames = [frame.select(F.lit(name).alias("split"), "*") for name, frame in self.items()]
        return reduce(DataFrame.unionByName, frames)
