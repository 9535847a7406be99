"""New columns from pairs of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, require_distinct_names, resolve_columns
from tablewright.operators.fitted import Projection

# The middle part of a new column's name.
LABELS = {"multiply": "x", "ratio": "div", "add": "plus", "subtract": "minus"}


def parse_pairs(pairs: str | Sequence[tuple[str, str]] | None) -> list[tuple[str, str]]:
    """``"A:B, C:D"`` or a list of two-tuples."""
    if not pairs:
        raise ValueError("give at least one pair, as 'A:B' or ('A', 'B')")
    if not isinstance(pairs, str):
        return [(a, b) for a, b in pairs]
    found = []
    for token in filter(None, (t.strip() for t in pairs.split(","))):
        sides = [side.strip() for side in token.split(":")]
        if len(sides) != 2 or not all(sides):
            raise ValueError(f"pair {token!r} is not of the form 'A:B'")
        found.append((sides[0], sides[1]))
    if not found:
        raise ValueError("give at least one pair, as 'A:B' or ('A', 'B')")
    return found


def combine_pairs(operation: str, pairs: Sequence[tuple[str, str]]) -> Projection:
    """The projection that adds a column per pair."""
    combine = {
        "multiply": lambda x, y: x * y,
        "ratio": F.try_divide,
        "add": lambda x, y: x + y,
        "subtract": lambda x, y: x - y,
    }[operation]
    added = {f"{a}_{LABELS[operation]}_{b}": combine(col(a).cast("double"), col(b).cast("double")) for a, b in pairs}
    return Projection(
        added=added,
        rows=tuple((name, "double", "continuous", "feature") for name in added),
        schema="column_name string, dtype string, semantic_type string, role string",
        recipe=("pairs", {"operation": operation, "pairs": pairs}),
    )


@dataclass(frozen=True)
class Interactions:
    """A ratio is null wherever its denominator is 0."""

    pairs: str | Sequence[tuple[str, str]]
    operation: str = "multiply"

    def fit(self, train: DataFrame) -> Projection:
        if self.operation not in LABELS:
            raise ValueError(f"unknown operation {self.operation!r}; choose one of {tuple(LABELS)}")
        require_distinct_names(train)
        pairs = parse_pairs(self.pairs)
        resolve_columns(train, [name for pair in pairs for name in pair], on_missing="error")
        return combine_pairs(self.operation, pairs)
