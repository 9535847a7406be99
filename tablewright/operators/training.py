"""MLlib trainers behind one contract: every column but the target is a feature."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager, nullcontext
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import NUMERIC_TYPES, col, dtype, log, missing, require_target
from tablewright.functions.keep import cached, persisted, widened
from tablewright.functions.stats import collect_aggregates, local_frame, quantiles
from tablewright.operators.curves import PROB_PREFIX
from tablewright.operators.tasks import detect_task
from tablewright.session import ensure_checkpoint_dir, importable
from tablewright.splits import Splits

SEED = 42
#: Spark's own limits: deepest tree, and features of the exact least-squares solver.
MAX_DEPTH = 30
#: Cut points tried per feature by default: every value of a feature with up to so many.
MAX_BINS = 256
NORMAL_SOLVER_FEATURES = 4096
#: Probability vectors are as long as this at most.
MAX_CLASSES = 1_000
#: The iterative solver goes on until it agrees with the exact one.
LBFGS_ROUNDS, LBFGS_TOLERANCE = 5_000, 1e-12
#: Boosters of different classes that are fitted at the same time.
PARALLEL_BOOSTERS = 4
#: Trees of a forest of counted cells that are fitted at the same time.
PARALLEL_TREES = 8
#: Rows up to which MLlib's own copies are small, so that fits on the rows are quicker than counting cells first.
DIRECT_ROWS = 1_000_000
#: Rows per cell of cut features and class, at least, for training on counted cells.
ROWS_PER_CELL = 20
#: Cells that one task of a fit reads.
CELLS_PER_TASK = 100_000
LABEL, FEATURES, WEIGHT = "_label", "_features", "_weight"


@dataclass(frozen=True)
class TrainedModel:
    """A fitted pipeline (assembler, scaler if any, model) with the names around it."""

    kind: str
    task: str
    target: str
    features: list[str]
    classes: list | None
    class_type: str | None
    pipeline: PipelineModel
    params: dict = field(default_factory=dict)
    train_rows: int = 0
    history_rows: list = field(default_factory=list)
    best_rounds: list = field(default_factory=list)

    # --- prediction ---

    def predict(self, df: DataFrame, target: str | None = None) -> DataFrame:
        """``y_true, y_pred`` and, for classes, ``y_prob_<class>`` in label order.

        A ``split`` column that is not a feature is passed on.
        """
        target = target or self.target
        kept = ["split"] if "split" in df.columns and "split" not in (*self.features, target) else []
        out = self.pipeline.transform(df)
        y_true = col(target).alias("y_true")
        if self.task == "regression":
            return out.select(*kept, y_true, F.col("prediction").alias("y_pred"))
        probs = self._probabilities()
        held = out.select(*kept, y_true, probs.alias("p"), self._winner(probs).alias("k"))
        labels = F.array(*[F.lit(c) for c in self.classes])
        return held.select(
            *kept,
            "y_true",
            F.element_at(labels, F.col("k") + 1).cast(self.class_type).alias("y_pred"),
            *[F.col("p")[i].alias(f"{PROB_PREFIX}{c}") for i, c in enumerate(self.classes)],
        )

    def predictions(self, splits: Splits) -> Splits:
        return splits.project(self.predict)

    def _boosters(self) -> list:
        return [s for s in self.pipeline.stages if s.hasParam("probabilityCol") and s.getProbabilityCol() != "probability"]

    def _probabilities(self) -> Column:
        """MLlib's own vector, or boosters of one class each scaled to sum to one."""
        boosters = self._boosters()
        if not boosters:
            return vector_to_array(F.col("probability"))
        yes = [vector_to_array(F.col(b.getProbabilityCol()))[1] for b in boosters]
        if len(yes) == 1:
            return F.array(F.lit(1.0) - yes[0], yes[0])
        total = sum(yes[1:], yes[0])
        return F.array(*[p / total for p in yes])

    def _winner(self, probs: Column) -> Column:
        if not self._boosters():
            return F.col("prediction").cast("int")
        return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")

    # --- reports ---

    def raw_importances(self) -> tuple[str, list[float]] | None:
        """Method and one weight per feature: tree importances or coefficient sizes."""
        trees = [s for s in self.pipeline.stages if hasattr(s, "featureImportances")]
        if trees:
            # A shortened booster's vector ends with the last feature that it uses.
            found = [dict(enumerate(t.featureImportances.toArray())) for t in trees]
            return "tree_importance", [float(sum(f.get(i, 0.0) for f in found) / len(found)) for i in range(len(self.features))]
        last = self.pipeline.stages[-1]
        if hasattr(last, "coefficientMatrix"):
            matrix = last.coefficientMatrix.toArray()
            return "coefficient_magnitude", [float(abs(matrix[:, i]).mean()) for i in range(len(self.features))]
        if hasattr(last, "coefficients"):
            return "coefficient_magnitude", [abs(c) for c in self.coefficients()]
        return None

    def coefficients(self) -> list[float]:
        """Least-squares coefficients; after scaling, per population standard deviation."""
        raw = [float(c) for c in self.pipeline.stages[-1].coefficients]
        if self.params.get("normalize"):
            n = self.train_rows
            raw = [c * math.sqrt((n - 1) / n) for c in raw]
        return raw

    def weights(self, spark) -> DataFrame:
        """``(rank, feature, weight)``: signed coefficients or importances, largest size first."""
        if self.kind == "linear_regression":
            values = self.coefficients()
        else:
            found = self.raw_importances()
            values = found[1] if found else []
        pairs = sorted(zip(self.features, (round(v, 6) for v in values)), key=lambda p: (-abs(p[1]), p[0]))
        return local_frame(
            spark, [(i + 1, f, v) for i, (f, v) in enumerate(pairs)], "rank long, feature string, weight double"
        )

    def intercept(self) -> float | None:
        last = self.pipeline.stages[-1]
        return float(last.intercept) if self.kind == "linear_regression" and self.params.get("fit_intercept") else None

    def info(self, spark) -> DataFrame:
        """Name-value rows: kind, task, target, features, classes, parameters, best rounds."""
        rows = [("model_type", self.kind), ("task", self.task), ("target", self.target), ("features", ",".join(self.features))]
        if self.classes is not None:
            rows.append(("classes", ",".join(str(c) for c in self.classes)))
        rows += [(f"param.{k}", str(v)) for k, v in self.params.items()]
        if self.best_rounds:
            rows.append(("best_iteration", ",".join(str(r) for r in self.best_rounds)))
        if self.intercept() is not None:
            rows.append(("intercept", str(round(self.intercept(), 6))))
        return local_frame(spark, rows, "name string, value string")

    def history(self, spark) -> DataFrame:
        """``(label, round, split, metric, value)`` of boosting with early stopping."""
        return local_frame(
            spark, self.history_rows, "label string, round long, split string, metric string, value double"
        )

    # --- storage ---

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {k: v for k, v in vars(self).items() if k != "pipeline"}
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        local_frame(spark, [(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedModel:
        meta = json.loads(spark.read.text(f"{path}/meta").where("value != ''").first()["value"])
        meta["history_rows"] = [tuple(r) for r in meta["history_rows"]]
        return TrainedModel(pipeline=PipelineModel.load(f"{path}/pipeline"), **meta)


def sample_counts(splits: Splits) -> DataFrame:
    return splits.tagged().groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def target_distribution(train: DataFrame, target: str) -> DataFrame:
    return train.groupBy(col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("count"))


# --- preparation -----------------------------------------------------------------------


@dataclass(frozen=True)
class _Prepared:
    """Features and label ready for MLlib, with what one grouped pass found out about them."""

    train: DataFrame
    assembler: VectorAssembler
    features: list[str]
    task: str
    classes: list | None
    class_type: str | None
    rows: int
    target: str

    def label(self, df: DataFrame) -> Column:
        if self.task == "regression":
            return col(self.target).cast("double")
        labels = F.array(*[F.lit(c) for c in self.classes])
        value = col(self.target).cast(_literal_type(self.class_type))
        return (F.array_position(labels, value) - 1).cast("double")

    def assembled(self, df: DataFrame) -> DataFrame:
        return self.assembler.transform(df).select(self.label(df).alias(LABEL), FEATURES)

    def fit(self, estimator, work: DataFrame | None = None):
        """Fit on persisted rows: MLlib reads its input several times."""
        with persisted(self.assembled(self.train) if work is None else work) as held:
            return estimator.fit(held)


@dataclass(frozen=True)
class _Cells:
    """Training rows of a classification, counted by what a tree can tell apart: the bins of all features, and the class.

    Columns ``_label``, one double per feature (``x0``...) and ``_weight``, the number of rows. A feature of at most
    ``max_bins`` values keeps them. Others are cut at quantiles of all rows, as MLlib cuts them at those of a sample, and are
    replaced by the number of the bin; ``binner`` does the same to the rows to be predicted.
    """

    counted: DataFrame
    binner: Bucketizer | None
    assembler: VectorAssembler
    cells: int

    @property
    def stages(self) -> list:
        return [self.assembler] if self.binner is None else [self.binner, self.assembler]

    @property
    def names(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.assembler.getInputCols()))]

    def tasks(self) -> int:
        return 1 + self.cells // CELLS_PER_TASK

    def vectors(self, df: DataFrame, weight: Column) -> DataFrame:
        assembler = VectorAssembler(inputCols=self.names, outputCol=FEATURES)
        return assembler.transform(df).select(LABEL, FEATURES, weight.cast("double").alias(WEIGHT))


def _feature_cuts(ready: _Prepared, max_bins: int) -> list[tuple[int, list[float] | None]] | None:
    """Per feature its number of bins and, if it has more values than bins, its cuts; None where cells would not be few."""
    room = ready.rows / ROWS_PER_CELL / len(ready.classes)
    values = {c: col(c).cast("double") for c in ready.features}
    if ready.rows <= DIRECT_ROWS or room < 1:
        return None
    estimates = collect_aggregates(ready.train, {c: F.approx_count_distinct(v) for c, v in values.items()})
    # An estimate is off by a few per cent, so this only turns away what has no chance.
    if math.prod(min(max_bins, n * 0.8) for n in estimates.values()) > room:
        return None
    few = [c for c in ready.features if estimates[c] <= 2 * max_bins]
    sizes = collect_aggregates(ready.train, {c: F.size(F.collect_set(values[c] + F.lit(0.0))) for c in few})
    wide = {c: values[c] for c in ready.features if sizes.get(c, max_bins + 1) > max_bins}
    if math.prod(min(max_bins, sizes.get(c, max_bins)) for c in ready.features) > room:
        return None
    shares = [(i + 1) / max_bins for i in range(max_bins - 1)]
    cuts = quantiles(ready.train, wide, shares, {c: ready.rows for c in wide}) if wide else {}
    return [(max_bins, sorted(set(cuts[c]))) if c in wide else (sizes[c], None) for c in ready.features]


@contextmanager
def _counted_cells(ready: _Prepared, max_bins: int):
    """The cells of a large classification with few of them, else None.

    The bins bound the cells whatever the values are: fits then take the time of the cells, not of the rows.
    """
    found = _feature_cuts(ready, max_bins) if ready.task == "classification" else None
    if found is None:
        yield None
        return
    wide = [(c, cuts) for c, (_, cuts) in zip(ready.features, found, strict=True) if cuts is not None]
    binner, inputs = None, list(ready.features)
    train = ready.train
    if wide:
        names = {c: f"_bin_{c}" for c, _ in wide}
        # A cut goes with the bin below it, as in MLlib's trees; the Bucketizer puts it above.
        edges = [[-math.inf, *[math.nextafter(x, math.inf) for x in cuts], math.inf] for _, cuts in wide]
        binner = Bucketizer(splitsArray=edges, inputCols=list(names), outputCols=list(names.values()))
        train, inputs = binner.transform(train), [names.get(c, c) for c in ready.features]
    plain = train.select(ready.label(train).alias(LABEL), *[(col(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(inputs)])
    counted = plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias(WEIGHT))
    with cached(counted) as held:
        assembler = VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error")
        yield _Cells(held, binner, assembler, held.count())


def _literal_type(class_type: str) -> str:
    return class_type if class_type in ("string", "boolean") else "double" if class_type in ("float", "double") else "bigint"


def _prepare(train: DataFrame, target: str | None, task: str | None = None, rule: str = "numeric") -> _Prepared:
    require_target(train, target)
    features = [c for c in train.columns if c != target]
    wrong = [c for c in features if not isinstance(dtype(train, c), (*NUMERIC_TYPES, T.BooleanType))]
    if wrong:
        raise ValueError(f"features {wrong} are not numeric; encode or drop them first")
    if not features:
        raise ValueError("there is no feature column besides the target")
    task = task or detect_task(train, target, rule)
    gaps = missing(train, target)
    for name in features:
        gaps = gaps | missing(train, name)
    classes = class_type = None
    counted = [F.count(F.lit(1)).alias("n"), F.count_if(gaps).alias("gaps")]
    if task == "classification":
        class_type = dtype(train, target).simpleString()
        groups = train.groupBy(col(target).alias("label")).agg(*counted).limit(MAX_CLASSES + 2).collect()
        if len(groups) > MAX_CLASSES + 1:
            raise ValueError(f"target {target!r} has more than {MAX_CLASSES} classes")
        classes = sorted(g["label"] for g in groups if g["label"] is not None)
    else:
        groups = [train.agg(*counted).first()]
    if sum(g["gaps"] for g in groups):
        raise ValueError("the training table has rows with missing values; impute or drop them first")
    rows = sum(g["n"] for g in groups)
    if not rows:
        raise ValueError("the training table is empty")
    assembler = VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="error")
    return _Prepared(train, assembler, features, task, classes, class_type, rows, target)


def _trained(kind: str, ready: _Prepared, stages: list, params: dict, first: list | None = None, **extra) -> TrainedModel:
    """``first``: the stages that make the features, if not the assembler alone."""
    return TrainedModel(
        kind, ready.task, ready.target, ready.features, ready.classes, ready.class_type,
        PipelineModel([*(first or [ready.assembler]), *stages]), params, ready.rows, **extra,
    )


def _depth(max_depth: int) -> int:
    if max_depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} deep here, not {max_depth}")
    return max_depth


def _leaf_rows(min_samples_split: int) -> int:
    """Spark bounds the rows of a leaf, not of a split node: half the split bound comes closest."""
    return max(1, min_samples_split // 2)


# --- trees -----------------------------------------------------------------------------


def decision_tree(
    train: DataFrame,
    target: str | None,
    max_depth: int = 10,
    min_samples_split: int = 2,
    criterion: str = "gini",
    task_rule: str = "tree",
    max_bins: int = MAX_BINS,
) -> TrainedModel:
    """One tree; ``max_bins`` bounds the cut points tried per feature."""
    ready = _prepare(train, target, rule=task_rule)
    common = dict(
        featuresCol=FEATURES, labelCol=LABEL, maxDepth=_depth(max_depth),
        minInstancesPerNode=_leaf_rows(min_samples_split), seed=SEED, maxBins=max_bins,
    )
    if ready.task == "classification":
        if criterion not in ("gini", "entropy"):
            log.warning("criterion %s is not for classes; using gini", criterion)
            criterion = "gini"
        estimator = DecisionTreeClassifier(impurity=criterion, **common)
    else:
        if criterion == "absolute_error":
            raise ValueError("there is no absolute_error criterion here; use squared_error")
        if criterion != "squared_error":
            log.warning("criterion %s is not for numbers; using squared_error", criterion)
            criterion = "squared_error"
        estimator = DecisionTreeRegressor(impurity="variance", **common)
    model = ready.fit(estimator)
    params = {"max_depth": max_depth, "min_samples_split": min_samples_split, "criterion": criterion}
    return _trained("decision_tree", ready, [model], params)


def random_forest(
    train: DataFrame,
    target: str | None,
    n_estimators: int = 100,
    max_depth: int = 10,
    min_samples_split: int = 2,
    max_bins: int = MAX_BINS,
) -> TrainedModel:
    """Trees on bootstrapped rows, a random choice of features at every node.

    MLlib keeps one number per row and tree while it fits. Large classifications with few cells (``_counted_cells``) are
    counted first, and every tree draws how often it takes the rows of a cell.
    """
    ready = _prepare(train, target)
    kind = RandomForestClassifier if ready.task == "classification" else RandomForestRegressor
    common = dict(featuresCol=FEATURES, labelCol=LABEL, maxDepth=_depth(max_depth), maxBins=max_bins)
    params = {"n_estimators": n_estimators, "max_depth": max_depth, "min_samples_split": min_samples_split}
    leaf = _leaf_rows(min_samples_split)
    few = _counted_cells(ready, max_bins) if n_estimators > 1 and 2 * leaf < ready.rows else nullcontext()
    with few as cells:
        if cells is not None:
            model = _forest_of_cells(ready, cells, n_estimators, leaf, common)
            return _trained("random_forest", ready, [model], params, cells.stages)
    model = ready.fit(kind(numTrees=n_estimators, minInstancesPerNode=leaf, seed=SEED, **common))
    return _trained("random_forest", ready, [model], params)


def _draws(cells: _Cells, trees: int) -> DataFrame:
    """How often each tree's bootstrap takes the rows of each cell: n rows taken Poisson(1) times each are taken Poisson(n) times.

    The numbers depend on the cell and the seed alone.
    """
    importable(cells.counted.sparkSession)
    names = [LABEL, *cells.names]
    schema = ", ".join(f"{c} double" for c in names) + ", draws array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, key = (batch.column(c).to_numpy() for c in (WEIGHT, "_key"))
            drawn = np.array([np.random.default_rng([SEED, k & (2**64 - 1)]).poisson(m, trees) for m, k in zip(n.tolist(), key.tolist())])
            offsets = np.arange(0, drawn.size + 1, trees, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(drawn.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "draws"])

    keyed = cells.counted.withColumn("_key", F.xxhash64(*names))
    return keyed.coalesce(cells.tasks()).mapInArrow(run, schema)


def _forest_of_cells(ready: _Prepared, cells: _Cells, trees: int, leaf: int, common: dict) -> RandomForestClassificationModel:
    """One tree a fit, side by side, each with its own weights; then all of them as one forest."""
    # Weights, not cells, are the rows of a leaf; half a row less, so that rounding does not matter.
    settings = dict(
        numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", weightCol=WEIGHT,
        minWeightFractionPerNode=(leaf - 0.5) / ready.rows, **common,
    )
    with cached(_draws(cells, trees)) as drawn:

        def grow(i):
            return RandomForestClassifier(seed=SEED + i, **settings).fit(cells.vectors(drawn, F.col("draws")[i]))

        with ThreadPool(PARALLEL_TREES) as pool:
            grown = pool.map(inheritable_thread_target(ready.train.sparkSession)(grow), range(trees), chunksize=1)
    context = SparkContext.getOrCreate()
    ml = context._jvm.org.apache.spark.ml.classification
    array = context._gateway.new_array(ml.DecisionTreeClassificationModel, trees)
    for i, one in enumerate(grown):
        array[i] = one._java_obj.trees()[0]
    first = grown[0]
    model = ml.RandomForestClassificationModel(f"{first._java_obj.uid()}_all", array, first.numFeatures, first.numClasses)
    whole = first._copyValues(RandomForestClassificationModel(model))
    whole._set(numTrees=trees)
    whole._transfer_params_to_java()
    return whole


# --- linear ----------------------------------------------------------------------------


def linear_regression(
    train: DataFrame, target: str | None, fit_intercept: bool = True, normalize: bool = False
) -> TrainedModel:
    """Ordinary least squares, in one pass over the rows up to 4096 features."""
    ready = _prepare(train, target, task="regression")
    work, stages, features = ready.assembled(train), [], FEATURES
    if normalize:
        features = "_scaled"
        scaler = StandardScaler(inputCol=FEATURES, outputCol=features, withMean=True, withStd=True).fit(work)
        stages.append(scaler)
        work = scaler.transform(work)
    solver = "normal" if len(ready.features) <= NORMAL_SOLVER_FEATURES else "l-bfgs"
    estimator = LinearRegression(
        featuresCol=features, labelCol=LABEL, solver=solver, regParam=0.0, fitIntercept=fit_intercept, standardization=False,
        maxIter=LBFGS_ROUNDS, tol=LBFGS_TOLERANCE,
    )
    # The normal equations take a single pass, so there is nothing to keep.
    stages.append(estimator.fit(work) if solver == "normal" else ready.fit(estimator, work))
    return _trained("linear_regression", ready, stages, {"fit_intercept": fit_intercept, "normalize": normalize})


def logistic_regression(
    train: DataFrame, target: str | None, C: float = 1.0, max_iter: int = 1000, penalty: str = "l2"
) -> TrainedModel:
    """Binary or multinomial; ``C`` weighs the summed loss, MLlib's ``regParam`` the mean loss."""
    if penalty not in ("l2", "l1", "none", None):
        raise ValueError(f"unknown penalty {penalty!r}; choose l2, l1 or none")
    ready = _prepare(train, target, task="classification")
    if len(ready.classes) < 2:
        raise ValueError(f"logistic regression needs at least 2 classes, found {ready.classes}")
    free = penalty in ("none", None)
    estimator = LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=max_iter, standardization=False,
        regParam=0.0 if free else 1.0 / (C * ready.rows), elasticNetParam=1.0 if penalty == "l1" else 0.0,
    )
    # MLlib keeps the rows itself, as blocks, and reads the input only twice: a second copy would push them out of memory.
    model = estimator.fit(ready.assembled(widened(train)))
    return _trained("logistic_regression", ready, [model], {"C": C, "max_iter": max_iter, "penalty": penalty})


# --- boosting --------------------------------------------------------------------------


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """Index of the lowest loss seen before ``patience`` rounds brought no gain; was it reached?"""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def gradient_boosting(
    train: DataFrame,
    target: str | None,
    val: DataFrame | None = None,
    learning_rate: float = 0.1,
    n_estimators: int = 100,
    max_depth: int = 6,
    subsample: float = 1.0,
    early_stopping_rounds: int = 0,
    colsample: float = 1.0,
    min_child_weight: int = 1,
    gamma: float = 0.0,
    reg_alpha: float = 0.0,
    reg_lambda: float = 1.0,
    max_bins: int = MAX_BINS,
    parallelism: int = PARALLEL_BOOSTERS,
    kind: str = "gradient_boosting",
) -> TrainedModel:
    """Boosted trees; several classes get one booster each, probabilities scaled to sum to one.

    Boosters of several classes are fitted side by side, ``parallelism`` at a time, from the same kept rows, so that the tasks of
    one fill the cores that the others leave idle. Large classifications with few cells (``_counted_cells``) are counted first:
    rounds on all rows then read the cells, with their numbers of rows as weights.

    Early stopping needs ``val``: rounds are added in doubling steps (four times the patience first) until the validation
    loss has not improved for ``early_stopping_rounds`` rounds, then the trees of the best
    number of rounds are kept, without another fit. ``colsample`` applies per tree node. L1 and L2 leaf penalties do not
    exist in MLlib, so other values than the defaults are refused.
    """
    if reg_alpha != 0.0 or reg_lambda != 1.0:
        raise ValueError("reg_alpha and reg_lambda have no counterpart here; leave them at 0 and 1")
    ready = _prepare(train, target)
    if ready.classes is not None and len(ready.classes) < 2:
        raise ValueError(f"boosting needs at least 2 classes, found {ready.classes}")
    ensure_checkpoint_dir(train.sparkSession)
    settings = dict(
        stepSize=learning_rate, maxDepth=_depth(max_depth), subsamplingRate=subsample, seed=SEED,
        featureSubsetStrategy="all" if colsample >= 1.0 else str(colsample),
        minInstancesPerNode=max(1, int(min_child_weight)), minInfoGain=gamma, maxBins=max_bins,
    )
    stop = early_stopping_rounds if val is not None and early_stopping_rounds > 0 and not val.isEmpty() else 0
    stages, history, rounds = [], [], []
    keep_val = persisted(ready.assembled(val)) if stop else nullcontext()
    # Rounds on a part of the rows, and losses, need the rows themselves.
    leaf = settings["minInstancesPerNode"]
    whole = subsample >= 1.0 and not stop and 2 * leaf < ready.rows
    with _counted_cells(ready, max_bins) if whole else nullcontext() as cells, ExitStack() as kept:
        held = kept.enter_context(keep_val)
        if cells is None:
            work = kept.enter_context(persisted(ready.assembled(train)))
        else:
            work = kept.enter_context(cached(cells.vectors(cells.counted, F.col(WEIGHT)).coalesce(cells.tasks())))
            settings.update(weightCol=WEIGHT, minInstancesPerNode=1, minWeightFractionPerNode=(leaf - 0.5) / ready.rows)
        labels = _boosted_labels(ready)

        def boost(index):
            return _boost(work, held, index, settings, n_estimators, stop)

        with ThreadPool(max(1, min(parallelism, len(labels)))) as pool:
            boosters = pool.map(inheritable_thread_target(train.sparkSession)(boost), [index for index, _ in labels])
        for (_, label), (model, found, used) in zip(labels, boosters, strict=True):
            stages.append(model)
            history += [(label, *row) for row in found]
            if stop:
                rounds.append(used - 1)
    params = dict(
        learning_rate=learning_rate, n_estimators=n_estimators, max_depth=max_depth, subsample=subsample,
        early_stopping_rounds=early_stopping_rounds, colsample=colsample, min_child_weight=min_child_weight, gamma=gamma,
    )
    first = None if cells is None else cells.stages
    return _trained(kind, ready, stages, params, first, history_rows=history, best_rounds=rounds)


def xgboost_style(train: DataFrame, target: str | None, val: DataFrame | None = None, **overrides) -> TrainedModel:
    """Boosting with the second set of defaults: slow, long, subsampled, early stopping on."""
    # The defaults of the second boosting operator.
    defaults = dict(
        learning_rate=0.05, n_estimators=500, max_depth=6, subsample=0.8, colsample=0.8,
        min_child_weight=1, gamma=0.0, early_stopping_rounds=10,
    )
    return gradient_boosting(train, target, val, kind="xgboost", **{**defaults, **overrides})


def _boosted_labels(ready: _Prepared) -> list[tuple[int | None, str]]:
    if ready.task == "regression":
        return [(None, "")]
    if len(ready.classes) == 2:
        return [(1, str(ready.classes[1]))]
    return list(enumerate(str(c) for c in ready.classes))


def _boost(work, held, index, settings, n_estimators, patience):
    """Fit one booster; returns it with its loss history and the number of rounds kept."""
    if index is None:
        def fit(rounds):
            return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, maxIter=rounds, **settings).fit(work)

        def losses(model, df):
            return [math.sqrt(x) for x in model.evaluateEachIteration(df, "squared")]

        metric = "rmse"
    else:
        def one_class(df):
            return df.withColumn(LABEL, (F.col(LABEL) == float(index)).cast("double"))

        work, held = one_class(work), None if held is None else one_class(held)

        def fit(rounds):
            booster = GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=rounds, **settings)
            booster.setRawPredictionCol(f"_raw{index}").setProbabilityCol(f"_prob{index}")
            return booster.setPredictionCol(f"_pred{index}").fit(work)

        def losses(model, df):
            # MLlib's loss is 2 log(1 + exp(-2yF)): twice the log loss.
            return [x / 2 for x in model.evaluateEachIteration(df)]

        metric = "logloss"
    if not patience:
        return fit(n_estimators), [], n_estimators
    # A fit begins anew, so a first step that is too short costs its rounds twice.
    rounds = min(n_estimators, 4 * patience)
    while True:
        model = fit(rounds)
        on_val = losses(model, held)
        best, stopped = best_round(on_val, patience)
        if stopped or rounds == n_estimators:
            break
        rounds = min(n_estimators, 2 * rounds)
    shown = min(len(on_val), best + patience + 1)
    on_train = losses(model, work)
    history = [(i, "train", metric, on_train[i]) for i in range(shown)]
    history += [(i, "val", metric, on_val[i]) for i in range(shown)]
    return (_first_trees(model, best + 1) or fit(best + 1)) if best + 1 < rounds else model, history, best + 1


def _first_trees(model, count: int):
    """The booster of the first ``count`` rounds: rounds add one tree each and change none, so nothing need be fitted again.

    None where none of these trees splits, as MLlib then finds no feature to weigh.
    """
    if all(tree.numNodes == 1 for tree in model.trees[:count]):
        return None
    context, java = SparkContext.getOrCreate(), model._java_obj
    ml = context._jvm.org.apache.spark.ml
    made = ml.classification.GBTClassificationModel if isinstance(model, GBTClassificationModel) else ml.regression.GBTRegressionModel
    trees = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, count)
    weights = context._gateway.new_array(context._jvm.double, count)
    for i in range(count):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    return model._copyValues(type(model)(made(f"{java.uid()}_first{count}", trees, weights)))
