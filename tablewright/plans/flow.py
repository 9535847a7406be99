"""A whole job: profile, split, prepare, train, judge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tablewright.functions.keep import keep as keep_rows
from tablewright.operators.metrics import classification_metrics, regression_metrics
from tablewright.operators.training import TrainedModel
from tablewright.splits import Splits


@dataclass(frozen=True)
class Outcome:
    splits: Splits
    steps: list
    model: TrainedModel
    kept: list

    def predictions(self) -> Splits:
        return self.model.predictions(self.splits)

    def metrics(self) -> DataFrame:
        report = classification_metrics if self.model.task == "classification" else regression_metrics
        return report(self.predictions()).metrics()

    def release(self) -> None:
        """Give back the rows kept since ``run``."""
        for frame in self.kept:
            frame.unpersist()


def prepare(splits: Splits, steps: Sequence) -> tuple[Splits, list]:
    """Fit every step on the training part as left by the step before, apply it to all parts."""
    fitted = []
    for step in steps:
        found = step.fit(splits.train)
        splits = found.apply(splits)
        fitted.append(found)
    return splits, fitted


def run(
    splits: Splits,
    steps: Sequence,
    train: Callable[..., TrainedModel],
    target: str,
    use_val: bool = False,
    keep: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
    **params,
) -> Outcome:
    """Prepare, train, and hand back everything needed to judge the model.

    The steps and the model read the input several times, so its selected columns are kept
    until ``release``; pass ``keep=None`` where reading again is cheaper than keeping.
    """
    kept = []
    if keep is not None and splits.source is not None:
        kept.append(keep_rows(splits.source, keep))
        splits = Splits.of(kept[0])
    ready, fitted = prepare(splits, steps)
    if use_val:
        params["val"] = ready.val
    return Outcome(ready, fitted, train(ready.train, target, **params), kept)
