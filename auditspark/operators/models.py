"""Candidate models: fitting on pinned folds, scoring, and permutation importance.

Training is Spark ML throughout. The feature transform is applied to source columns, so the
importances below permute source columns and never their one-hot parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.functions.exprs import draw
from auditspark.operators import metrics
from auditspark.operators.forest import Recipe, grow_forest
from auditspark.operators.ranking import column_statistics, dense_index
from auditspark.operators.split import HOLDOUT
from auditspark.operators.transform import FittedTransform
from auditspark.session import durable

Builder = Callable[["TrainingFacts", int], object]


@dataclass(frozen=True)
class TrainingFacts:
    """What a regularisation strength depends on: rows, and the label's spread."""

    n: int
    spread: float


def _logistic(facts: TrainingFacts, seed: int) -> LogisticRegression:
    # Penalising standardised coefficients equals scaling the features first. The solver scales by
    # the sample deviation, (n-1)/n turns that into the population deviation of the recipe (C=1).
    strength = (facts.n - 1) / facts.n / facts.n
    return LogisticRegression(maxIter=2000, regParam=strength, standardization=True)


def _ridge(facts: TrainingFacts, seed: int) -> LinearRegression:
    # The normal-equation solver divides the strength by the label's deviation (alpha=1).
    return LinearRegression(regParam=facts.spread / facts.n, solver="normal", standardization=True)


_BOOST = {"maxIter": 200, "stepSize": 0.1, "maxBins": 255, "maxDepth": 5}


def _boosted(facts: TrainingFacts, seed: int) -> GBTClassifier:
    return GBTClassifier(seed=seed, **_BOOST)


def _boosted_many(facts: TrainingFacts, seed: int) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(seed=seed, **_BOOST))


def _boosted_number(facts: TrainingFacts, seed: int) -> GBTRegressor:
    return GBTRegressor(seed=seed, **_BOOST)


CANDIDATES: dict[str, dict[str, Builder]] = {
    "binary": {"logistic_l2": _logistic, "hist_gbdt": _boosted},
    "multiclass": {"logistic_l2": _logistic, "hist_gbdt": _boosted_many},
    "regression": {"ridge": _ridge, "hist_gbdt": _boosted_number},
}


def forest(task: str, seed: int = vocab.DEFAULT_SEED):
    """The unit point's recipe ``rf-v1``: 200 trees, square-root feature subsets, grown deep."""
    options = {"numTrees": 200, "featureSubsetStrategy": "sqrt", "seed": seed, "maxDepth": 30,
               "maxBins": 255}
    return RandomForestRegressor(**options) if task == "regression" \
        else RandomForestClassifier(**options)


# ---------------------------------------------------------------- fitting and scoring


@dataclass(frozen=True)
class Model:
    """A fitted estimator with the classes its label indices stand for."""

    fitted: object
    task: str
    classes: list[str]

    def predict(self, assembled: DataFrame) -> DataFrame:
        """Adds ``prediction`` and ``score`` (binary), ``scores`` (multiclass) in label terms."""
        out = self.fitted.transform(assembled)
        if self.task == "regression":
            return out.withColumn("score", F.col("prediction"))
        if self.task == "binary":
            return out.withColumn("score", vector_to_array("probability")[1])
        names = F.array(*[F.lit(c) for c in self.classes])
        if "probability" in out.columns:
            scores = vector_to_array("probability")
        else:  # one-vs-rest margins of boosted trees: logistic link, then normalised
            link = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
            scores = F.transform(link, lambda p: p / F.aggregate(
                link, F.lit(0.0), lambda a, x: a + x))
        return out.withColumn("scores", scores).withColumn(
            "prediction", F.get(names, F.col("prediction").cast("int")))


def assemble(df: DataFrame, fit: FittedTransform, keep: Sequence[str]) -> DataFrame:
    """Source rows as (keep..., features); the vector is built inside one projection."""
    return fit.vector(df, keep).withColumn("features", array_to_vector("features"))


def _label(task: str, classes: Sequence[str], y: str = "y") -> Column:
    if task == "multiclass":
        names = F.array(*[F.lit(c) for c in classes])
        return (F.array_position(names, F.col(y)) - 1).cast("double")
    return F.col(y).cast("double")


def label_classes(df: DataFrame, task: str, y: str = "y") -> list[str]:
    """Sorted classes of a multiclass label (a class list is bounded by the task, not the data)."""
    if task != "multiclass":
        return []
    return sorted(r[0] for r in df.filter(F.col(y).isNotNull()).select(y).distinct().collect())


#: Estimators that see rows through weighted sums only, so that equal rows may be one weighted row.
#: The forest draws each row on its own, and the linear models' deviations take weights for
#: reliabilities, so these are given every row.
MERGED = (GBTClassifier, GBTRegressor, OneVsRest)


def merged(training: DataFrame) -> DataFrame:
    """Equal rows (``features``, ``label``) as one with their number as ``weight``, if that at least halves them.

    Partitions follow the rows that are left, which are sorted, as in ``prepared_features``.
    """
    counted = training.groupBy(vector_to_array("features").alias("x"), "label").agg(
        F.count("*").cast("double").alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    n, rows = counted.agg(F.count("*"), F.sum("weight")).first()
    if 2 * n > (rows or 0):
        counted.unpersist()
        return training.withColumn("weight", F.lit(1.0))
    placed = counted.repartition(math.ceil(n / ROWS_PER_TASK), "x", "label").sortWithinPartitions("x", "label")
    out = placed.select(array_to_vector("x").alias("features"), "label", "weight").persist(
        StorageLevel.MEMORY_AND_DISK)
    out.count()
    counted.unpersist()
    return out


#: Longer tables are boosted on the numbers of the features' bins, of which the recipe has 255 anyway, so that
#: rows alike to the trees are equal and may be merged: the cost follows the bins met, not the rows.
BINNED_ABOVE = 200_000
_FEW_VALUES = 300  # by a sketch; a feature of fewer keeps its values


def bin_bounds(training: DataFrame, n: int, bins: int = _BOOST["maxBins"]) -> dict[int, list[float]]:
    """Upper ends of equal-frequency bins of every feature with more values than bins, from all ``n`` rows."""
    x = training.select(vector_to_array("features").alias("x"))
    first = x.first()
    width = len(first.x)
    many: list[int] = []
    for start in range(0, width, _SUMS_PER_JOB):
        chunk = range(start, min(width, start + _SUMS_PER_JOB))
        row = x.agg(*[F.approx_count_distinct(F.get("x", F.lit(i))) for i in chunk]).first()
        many += [i for i, distinct in zip(chunk, row, strict=True) if distinct > _FEW_VALUES]
    ranks = sorted({max(1, b * n // bins) for b in range(1, bins)})
    cuts = column_statistics(x, {f"{i}": F.get("x", F.lit(i)) for i in many}, {f"{i}": ranks for i in many})
    ends: dict[int, set[float]] = {i: set() for i in many}
    for cut in cuts:
        ends[int(cut.group)].add(float(cut.key))
    return {i: sorted(e) for i, e in ends.items()}


def in_bins(df: DataFrame, bounds: dict[int, list[float]]) -> DataFrame:
    """``features`` with the number of its bin in place of each value of the features in ``bounds``."""
    def placed(value: Column, at: Column) -> Column:
        out = value
        for i, ends in bounds.items():
            number = F.size(F.filter(F.lit(ends), lambda end: end < value)).cast("double")
            out = F.when(at == i, number).otherwise(out)
        return out

    return df.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), placed)))


@dataclass(frozen=True)
class Binned:
    """A model fitted on bin numbers, which scores rows by the same bins."""

    fitted: object
    bounds: dict[int, list[float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.transform(in_bins(df, self.bounds))


#: Trees of a forest grown by one fit, and such fits at once.
TREES_PER_FIT, PARALLEL_FORESTS = 25, 8


@dataclass(frozen=True)
class Forest:
    """Forests fitted apart that vote as one: every tree counts alike."""

    members: list

    def transform(self, df: DataFrame) -> DataFrame:
        trees = [m.getNumTrees for m in self.members]
        votes, out = [], df
        for i, m in enumerate(self.members):
            named = m.copy()
            if isinstance(m, RandomForestRegressionModel):
                out = named.setPredictionCol(f"__p{i}").transform(out)
                votes.append(F.array(f"__p{i}"))
            else:
                out = named.setProbabilityCol(f"__p{i}").setRawPredictionCol("").setPredictionCol("").transform(out)
                votes.append(vector_to_array(f"__p{i}"))
        shares = F.transform(F.arrays_zip(*[v.alias(f"v{i}") for i, v in enumerate(votes)]), lambda row: sum(
            (row[f"v{i}"] * F.lit(float(n)) for i, n in enumerate(trees)), F.lit(0.0)) / F.lit(float(sum(trees))))
        if isinstance(self.members[0], RandomForestRegressionModel):
            return out.select(*df.columns, F.get(shares, F.lit(0)).alias("prediction"))
        most = F.array_position("__shares", F.array_max("__shares"))
        return out.select(*df.columns, shares.alias("__shares")).select(
            *df.columns, array_to_vector("__shares").alias("probability"), (most - 1).cast("double").alias("prediction"))


def fit_forest(estimator, training: DataFrame, n: int) -> Forest:
    """A forest grown in groups of trees side by side, every group over all rows.

    Deep trees need many short rounds, in which one group leaves cores idle; more partitions would
    not help, as each returns the statistics of every open node. Which node a row is in is kept,
    instead of sending all trees along with every round. Rows are placed and sorted by their
    values, so reruns draw the same rows.
    """
    placed = training.select(vector_to_array("features").alias("x"), "label").repartition(
        math.ceil(n / ROWS_PER_TASK), "x", "label").sortWithinPartitions("x", "label")
    rows = placed.select(array_to_vector("x").alias("features"), "label").persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    subset = estimator.getFeatureSubsetStrategy()
    if subset == "auto" and estimator.getNumTrees() > 1:  # a last group of one tree would read it as "all"
        subset = "sqrt" if isinstance(estimator, RandomForestClassifier) else "onethird"

    def grow(start: int):
        part = estimator.copy()
        part._set(numTrees=min(TREES_PER_FIT, estimator.getNumTrees() - start), cacheNodeIds=True,
                  seed=estimator.getSeed() + start, featureSubsetStrategy=subset)
        return part.fit(rows)

    with ThreadPoolExecutor(PARALLEL_FORESTS) as pool:
        members = list(pool.map(inheritable_thread_target(training.sparkSession)(grow),
                                range(0, estimator.getNumTrees(), TREES_PER_FIT)))
    rows.unpersist()
    return Forest(members)


#: Longer tables get the recipe's forest by ``grow_forest``, as deep trees over many distinct rows take Spark ML too
#: many rounds, and its model is too large to send along with every scoring task.
GROWN_ABOVE = 10_000
_GROWN = {"featureSubsetStrategy": "sqrt", "maxBins": _BOOST["maxBins"], "bootstrap": True, "subsamplingRate": 1.0,
          "minInstancesPerNode": 1, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}


def value_bounds(training: DataFrame, features: Sequence[int]) -> dict[int, list[float]]:
    """The middles between neighbouring values of features that have few."""
    x = training.select(vector_to_array("features").alias("x"))
    out: dict[int, list[float]] = {}
    for start in range(0, len(features), _SUMS_PER_JOB):
        chunk = features[start:start + _SUMS_PER_JOB]
        row = x.agg(*[F.sort_array(F.collect_set(F.get("x", F.lit(i)))) for i in chunk]).first()
        out |= {i: [(a + b) / 2 for a, b in zip(v, v[1:])] for i, v in zip(chunk, row, strict=True)}
    return out


def grown_forest(estimator, training: DataFrame, n: int, task: str, classes: Sequence[str]) -> Binned:
    """The recipe's forest over the numbers of every feature's bins."""
    rows = training.select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    width = len(rows.first().features)
    bounds = bin_bounds(rows, n, estimator.getMaxBins())
    bounds |= value_bounds(rows, [i for i in range(width) if i not in bounds])
    kinds = 0 if task == "regression" else len(classes) or 2
    recipe = Recipe(estimator.getNumTrees(), math.ceil(math.sqrt(width)), estimator.getMaxDepth(),
                    estimator.getSeed() % 2**63, kinds)
    bins = max(2, 1 + max(map(len, bounds.values())))
    forest = grow_forest(in_bins(rows, bounds), recipe, bins, training.sparkSession)
    rows.unpersist()
    return Binned(forest, bounds)


def fit_model(builder: Builder, assembled: DataFrame, task: str, classes: Sequence[str],
              seed: int = vocab.DEFAULT_SEED) -> Model:
    training = assembled.withColumn("label", _label(task, classes))
    spread = F.stddev_pop("label") if task == "regression" else F.lit(1.0)
    n, sd = training.agg(F.count("*"), spread).first()
    if not n:
        raise ValueError("no training rows")
    estimator = builder(TrainingFacts(n, sd or 1.0), seed)
    small = n <= ROWS_PER_TASK * PARALLEL_FORESTS  # a longer table has a task for every core in one fit
    if isinstance(estimator, (RandomForestClassifier, RandomForestRegressor)):
        if n > GROWN_ABOVE and all(estimator.getOrDefault(p) == v for p, v in _GROWN.items()):
            return Model(grown_forest(estimator, training, n, task, classes), task, list(classes))
        if small:
            return Model(fit_forest(estimator, training, n), task, list(classes))
    if not isinstance(estimator, MERGED):
        return Model(estimator.fit(training), task, list(classes))
    bounds = bin_bounds(training, n) if n > BINNED_ABOVE else {}
    weighted = merged(in_bins(training, bounds) if bounds else training)
    fitted = estimator.setWeightCol("weight").fit(weighted)
    weighted.unpersist()
    return Model(Binned(fitted, bounds) if bounds else fitted, task, list(classes))


def evaluate(predicted: DataFrame, metric: str, task: str, classes: Sequence[str] = (),
             group: Sequence[str] = ()) -> DataFrame:
    """(group..., value) of the task's form of a metric."""
    if task == "multiclass" and metric == "roc_auc":
        return metrics.auc_ovr(predicted, "y", "scores", classes)
    if task == "multiclass" and metric == "f1":
        return metrics.macro_f1(predicted, group=group)
    if task == "multiclass" and metric == "log_loss":
        return metrics.multiclass_log_loss(predicted, "y", "scores", classes)
    return metrics.score(predicted, metric, group=group)


@dataclass
class Candidate:
    """One fitted candidate; ``fit_error`` set means it could not be fit, not that it is bad."""

    name: str
    cv_scores: list[float] = field(default_factory=list)
    cv_mean: float | None = None
    holdout_score: float | None = None
    fit_error: str | None = None
    model: Model | None = None


ROWS_PER_TASK = 50_000
PARALLEL_FITS = 6  # fits submitted at once; their jobs interleave on the executors


def prepared_features(assigned: DataFrame, fit: FittedTransform,
                      row_id: str = "row_id") -> DataFrame:
    """Features of every labelled row with its part, computed once and kept.

    Rows are placed by their id and sorted within a partition, so tree fits see the same rows in
    the same order whatever produced them. Partitions follow the rows: small tables get few, as
    every tree level is a job that costs its number of tasks, and no task holds more than about
    ``ROWS_PER_TASK``.
    """
    usable = assigned.filter(F.col("y").isNotNull())
    parts = max(1, math.ceil(usable.count() / ROWS_PER_TASK))
    placed = usable.repartition(parts, F.col(row_id)).sortWithinPartitions(row_id)
    features = assemble(placed, fit, [row_id, "part", "y"]).persist(StorageLevel.MEMORY_AND_DISK)
    features.count()  # filled once here, not by every concurrent fit
    return features


SUMMED_WIDTH = 64  # wider feature vectors are fitted fold by fold
_SUMS_PER_JOB = 500


@dataclass(frozen=True)
class PartSums:
    """Additive sums of one part over (features, label), all shifted by the same centre."""

    n: int
    first: np.ndarray
    second: np.ndarray

    def __add__(self, other: PartSums) -> PartSums:
        return PartSums(self.n + other.n, self.first + other.first, self.second + other.second)

    def __sub__(self, other: PartSums) -> PartSums:
        return PartSums(self.n - other.n, self.first - other.first, self.second - other.second)


def part_sums(features: DataFrame, width: int) -> tuple[np.ndarray, dict[str, PartSums]]:
    """The centre, and the sums of every part: one pass for the means, one for all products.

    What reaches the driver is a square of ``width + 1`` numbers per part. The products are taken about
    the columns' means, so that large values with a small spread keep their digits.
    """
    flat = features.select("part", vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y"))
    cells = [F.get("x", F.lit(i)) for i in range(width)] + [F.col("y")]
    centre = np.array(flat.agg(*[F.avg(c) for c in cells]).first(), dtype=float)
    shifted = flat.select("part", *[(c - F.lit(float(m))).alias(f"z{i}")
                                    for i, (c, m) in enumerate(zip(cells, centre, strict=True))])
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    parts: dict[str, PartSums] = {}
    for at in range(0, len(pairs), _SUMS_PER_JOB):
        chunk = pairs[at:at + _SUMS_PER_JOB]
        rows = shifted.groupBy("part").agg(
            F.count("*").alias("n"), F.array(*[F.sum(f"z{i}") for i in range(width + 1)]).alias("first"),
            F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in chunk]).alias("second")).collect()
        for r in rows:
            kept = parts.setdefault(r.part, PartSums(
                r.n, np.array(r["first"]), np.zeros((width + 1, width + 1))))
            for (i, j), v in zip(chunk, r.second, strict=True):
                kept.second[i, j] = kept.second[j, i] = v
    return centre, parts


def ridge_rmse(train: PartSums, held: PartSums, centre: np.ndarray) -> float | None:
    """Error on ``held`` of the ridge (alpha 1, standardised features) that ``train`` determines.

    A feature without spread in the training rows gets no weight. None without held rows.
    """
    if not train.n:
        raise ValueError("no training rows")
    if not held.n:
        return None
    mean = train.first / train.n
    spread = train.second - train.n * np.outer(mean, mean)
    own = np.diag(spread)[:-1]
    noise = 1e-13 * np.diag(train.second)[:-1] + 1e-28 * train.n * centre[:-1] ** 2
    scale = np.divide(1.0, np.sqrt(np.abs(own) / train.n), out=np.zeros(len(own)), where=own > noise)
    gram = spread[:-1, :-1] * np.outer(scale, scale)
    weights = np.linalg.solve(gram + np.eye(len(own)), spread[:-1, -1] * scale) * scale
    toward = np.append(-weights, 1.0)  # residual = toward . (row - mean)
    about = held.second - np.outer(held.first, mean) - np.outer(mean, held.first) + held.n * np.outer(mean, mean)
    return math.sqrt(max(0.0, float(toward @ about @ toward)) / held.n)


def _summed_ridge(features: DataFrame, folds: int, width: int) -> tuple[list[float | None], float | None]:
    """The folds' scores and the holdout's, each training side being the whole less its fold."""
    centre, parts = part_sums(features, width)
    none = PartSums(0, np.zeros(width + 1), np.zeros((width + 1, width + 1)))
    train = sum((p for name, p in parts.items() if name != HOLDOUT), none)
    held = [parts.get(str(k), none) for k in range(folds)]
    return ([ridge_rmse(train - fold, fold, centre) for fold in held],
            ridge_rmse(train, parts.get(HOLDOUT, none), centre))


def cross_validate(features: DataFrame, task: str, metric: str, folds: int,
                   specs: dict[str, Builder] | None = None, seed: int = vocab.DEFAULT_SEED,
                   keep_models: bool = True) -> list[Candidate]:
    """Fit every candidate on the pinned folds, then on all train rows for the holdout score.

    ``features`` comes from ``prepared_features``. A candidate that cannot be fit records why and
    the others go on. Ridge scored by rmse on up to ``SUMMED_WIDTH`` features is not fitted fold by
    fold: one aggregation gives every fold's sums, from which its weights and errors follow. A model
    that is to be kept is then fitted once, on all train rows.
    """
    classes = label_classes(features, task)
    specs = specs or CANDIDATES[task]
    first = features.select("features").first() if metric == "rmse" and _ridge in specs.values() else None
    width = len(first.features) if first else 0
    summed = {name for name, b in specs.items() if b is _ridge and 0 < width <= SUMMED_WIDTH}
    train = features.filter(F.col("part") != HOLDOUT)
    held = features.filter(F.col("part") == HOLDOUT)

    def one(builder: Builder, fold: int | None) -> tuple[float | None, Model]:
        inside = train if fold is None else train.filter(F.col("part") != str(fold))
        outside = held if fold is None else train.filter(F.col("part") == str(fold))
        model = fit_model(builder, inside, task, classes, seed)
        return evaluate(model.predict(outside), metric, task, classes).first().value, model

    out = []
    run = inheritable_thread_target(features.sparkSession)(one)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        submitted = {
            name: [pool.submit(run, builder, k)
                   for k in [*range(folds), None]]
            for name, builder in specs.items() if name not in summed}
        by_sums = {name: pool.submit(inheritable_thread_target(features.sparkSession)(_summed_ridge),
                                     features, folds, width) for name in summed}
        for name, builder in specs.items():
            entry, futures = Candidate(name), submitted.get(name)
            try:
                if futures is None:
                    entry.cv_scores, entry.holdout_score = by_sums[name].result()
                    entry.cv_mean = sum(entry.cv_scores) / len(entry.cv_scores)
                    entry.model = fit_model(builder, train, task, classes, seed) if keep_models else None
                    out.append(entry)
                    continue
                entry.cv_scores = [f.result()[0] for f in futures[:-1]]
                entry.cv_mean = sum(entry.cv_scores) / len(entry.cv_scores)
                entry.holdout_score, final = futures[-1].result()
                entry.model = final if keep_models else None
            except Exception as error:  # one candidate's failure must not cost the others
                entry.fit_error = f"{type(error).__name__}: {error}"[:vocab.ERROR_MESSAGE_LIMIT]
            out.append(entry)
    return out


def candidate_rows(spark, run_id: str, entries: Sequence[Candidate]) -> DataFrame:
    return spark.createDataFrame(
        [(run_id, e.name, i, e.cv_scores, e.cv_mean, e.holdout_score, e.fit_error)
         for i, e in enumerate(entries)],
        "run_id string, name string, position int, cv_scores array<double>, cv_mean double, "
        "claimed_holdout_score double, fit_error string")


# ---------------------------------------------------------------- permutation importance

REPLICATE_ROWS = 200_000_000


def permutation_importance(
    model: Model, fit: FittedTransform, holdout: DataFrame, metric: str, *,
    repeats: int = vocab.PERMUTATION_REPEATS, seed: int = vocab.DEFAULT_SEED,
    row_id: str = "row_id", chunk_rows: int = REPLICATE_ROWS,
) -> DataFrame:
    """(column, mean, std): loss of score when a source column's values are shuffled.

    Holdout rows are numbered once in a hashed order; repeat r hands every row the values of the
    row a random distance further on, so one equi-join on the number supplies the shuffled values
    of all columns. Replicates of many (column, repeat) pairs are then scored in one pass; columns
    are taken in chunks that keep the replicated rows under ``chunk_rows``. The scores are written
    once, as one long table (column, repeat, y, score), so no later pass predicts again. No two
    repeats share a distance where there are more rows than repeats.
    """
    columns = fit.source_columns
    sign = 1.0 if vocab.GREATER_IS_BETTER[metric] else -1.0
    rows = holdout.filter(F.col("y").isNotNull()).select(row_id, "y", *columns)
    ordered = dense_index(
        rows.withColumn("__draw", draw(seed, F.col(row_id), ":order")), ["__draw", row_id], "__i")
    n = ordered.count()
    spark = rows.sparkSession
    if n < 2:
        return spark.createDataFrame([], "column string, mean double, std double")
    baseline = evaluate(
        model.predict(assemble(rows, fit, ["y"])), metric, model.task, model.classes).first().value
    # Never 0, so no row keeps its own values; each repeat draws from its own share of 1..n-1.
    low, high = (F.floor((F.col("repeat") + i) * F.lit(n - 1) / F.lit(repeats)) for i in (0, 1))
    shift = 1 + (low + draw(seed, F.col("repeat"), ":shift") % F.greatest(high - low, F.lit(1))) % F.lit(n - 1)
    replicas = (
        ordered.select(row_id, "y", "__i", F.struct(*columns).alias("own"),
                       F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
        .withColumn("__i", (F.col("__i") + shift) % F.lit(n)))
    donors = ordered.select("__i", F.struct(*columns).alias("donor"))
    shuffled = replicas.join(donors, "__i")
    per_pass = max(1, chunk_rows // max(1, n * repeats))
    parts = []
    for start in range(0, len(columns), per_pass):
        chunk = columns[start:start + per_pass]
        variants = [F.struct(F.lit(c).alias("column"), *[
            F.col(f"{'donor' if d == c else 'own'}.{d}").alias(d) for d in columns])
            for c in chunk]
        wide = shuffled.select("y", "repeat", F.explode(F.array(*variants)).alias("v")).select(
            "y", "repeat", F.col("v.column").alias("__column"),
            *[F.col(f"v.{d}").alias(d) for d in columns])
        scored = model.predict(assemble(wide, fit, ["y", "repeat", "__column"]))
        slim = [c for c in ("prediction", "score", "scores") if c in scored.columns]
        parts.append(_grouped(durable(scored.select("__column", "repeat", "y", *slim)), metric, model))
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    loss = F.lit(sign) * (F.lit(baseline) - F.col("value"))
    return values.groupBy(F.col("__column").alias("column")).agg(
        F.avg(loss).alias("mean"), F.stddev_pop(loss).alias("std"))


def _grouped(scored: DataFrame, metric: str, model: Model) -> DataFrame:
    by = ["__column", "repeat"]
    if model.task == "multiclass" and metric in ("roc_auc", "log_loss"):
        rows = scored.select(*by, F.posexplode("scores").alias("at", "score"), "y")
        names = F.array(*[F.lit(c) for c in model.classes])
        hit = (F.col("y") == F.get(names, F.col("at"))).cast("int")
        binary = rows.select(*by, "at", "score", hit.alias("hit"))
        if metric == "roc_auc":
            per_class = metrics.roc_auc(binary, "hit", "score", [*by, "at"])
            return per_class.groupBy(*by).agg(F.avg("value").alias("value"))
        return binary.filter("hit = 1").groupBy(*by).agg(
            (-F.avg(F.log(F.greatest("score", F.lit(2.2e-16))))).alias("value"))
    return evaluate(scored, metric, model.task, model.classes, by)
