"""User-written steps with checked parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.functions.columns import quoted


@dataclass(frozen=True)
class Param:
    """A parameter with a default and, optionally, a range or a list of choices."""

    default: Any
    low: float | None = None
    high: float | None = None
    choices: Sequence[Any] | None = None

    def check(self, name: str, value: Any) -> Any:
        if self.choices is not None and value not in self.choices:
            raise ValueError(f"{name}={value!r} is not one of {list(self.choices)}")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{name}={value!r} is outside {self.low} to {self.high}")
        return value


@dataclass(frozen=True)
class CustomStep:
    """A function as a step.

    ``mode`` is "table" for a function of DataFrames (planned by Spark), "batches" for one
    over iterators of pandas frames, "groups" for one over the rows of a group.
    """

    fn: Callable
    params: dict[str, Param]
    mode: str = "table"
    schema: T.StructType | str | None = None
    by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("table", "batches", "groups"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode != "table" and self.schema is None:
            raise ValueError("steps that run Python on rows need an output schema")
        if self.mode == "groups" and not self.by:
            raise ValueError("grouped steps need the grouping columns")

    def arguments(self, given: dict[str, Any]) -> dict[str, Any]:
        strange = set(given) - set(self.params)
        if strange:
            raise ValueError(f"unknown parameters {sorted(strange)}")
        return {name: spec.check(name, given.get(name, spec.default)) for name, spec in self.params.items()}

    def __call__(self, df: DataFrame, **given: Any) -> DataFrame:
        args, fn = self.arguments(given), self.fn
        if self.mode == "table":
            return df.transform(fn, **args)
        if self.mode == "batches":
            return df.mapInPandas(lambda frames: fn(frames, **args), self.schema)
        return df.groupBy(*[quoted(c) for c in self.by]).applyInPandas(lambda frame: fn(frame, **args), self.schema)


def custom_step(
    params: dict[str, Param] | None = None, mode: str = "table", schema=None, by: Sequence[str] = ()
) -> Callable[[Callable], CustomStep]:
    """Decorator form of ``CustomStep``."""
    return lambda fn: CustomStep(fn, params or {}, mode, schema, tuple(by))
