"""Common shape of feature steps: fit on train, apply the same projection everywhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tablewright.functions.columns import col
from tablewright.splits import Splits


class Fitted:
    """Anything with a ``transform``; works on batch tables and on streams alike."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply(self, splits: Splits) -> Splits:
        return splits.project(self.transform)


@dataclass(frozen=True)
class Projection(Fitted):
    """Replaced, added and dropped columns, all in one ``select``.

    ``rows`` describes the fit, one line per column, with ``schema``. ``recipe`` names what builds the same projection again,
    and its arguments; it is what ``stored_steps`` writes.
    """

    replaced: dict[str, Column] = field(default_factory=dict)
    added: dict[str, Column] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    rows: tuple = ()
    schema: str = "column_name string, note string"
    recipe: tuple[str, dict] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [
            self.replaced[c].alias(c) if c in self.replaced else col(c)
            for c in df.columns
            if c not in self.dropped and c not in self.added
        ]
        return df.select(*kept, *[expr.alias(name) for name, expr in self.added.items()])

    def info(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)
