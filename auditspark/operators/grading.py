"""Independent grading: refit, self-check, score on withheld rows, and a scale to read it on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.operators import metrics, models
from auditspark.operators.profile import encode_target, resolve_positive, scoring_rows
from auditspark.operators.split import HOLDOUT, attach
from auditspark.operators.transform import FittedTransform, fit_ordinal

# ---------------------------------------------------------------- status ladders


def rescore_precondition(withheld: Column, has_spec: Column, has_model: Column,
                         n_features: Column, known_model: Column) -> Column:
    """Why there is nothing to grade, or NULL."""
    return (
        F.when(~withheld, "no_withheld_holdout").when(~has_spec, "no_spec")
        .when(~has_model, "no_model").when(F.coalesce(n_features, F.lit(0)) == 0, "empty_matrix")
        .when(~known_model, "unknown_model_spec"))


def rescore_status(precondition: Column, single_class: Column, refit: Column, claimed: Column,
                   tolerance: float = vocab.REFIT_TOLERANCE) -> Column:
    """A refit that misses the claim keeps its score and is flagged, never pooled silently."""
    gap = refit - claimed
    return (
        F.when(precondition.isNotNull(), precondition)
        .when(F.coalesce(single_class, F.lit(False)), "single_class_holdout")
        .when(gap.isNull() | (F.abs(gap) > tolerance), "refit_mismatch").otherwise("ok"))


def baseline_status(withheld: Column, verified: Column, n_sources: Column,
                    single_class_train: Column, zero: Column, unit: Column) -> Column:
    """A failed unit point keeps the zero point and the other way round."""
    return (
        F.when(~withheld, "no_withheld_holdout").when(verified.isNull(), "rescore_unavailable")
        .when(n_sources == 0, "empty_source_matrix")
        .when(single_class_train, "single_class_train")
        .when(unit.isNull(), "unit_point_failed").when(zero.isNull(), "zero_point_failed")
        .otherwise("ok"))


# ---------------------------------------------------------------- one run


@dataclass
class Grade:
    """Grader outcome; a missing score always comes with the status that says why."""

    rescore_status: str = "not_attempted"
    verified: float | None = None
    refit: float | None = None
    refit_claim_gap: float | None = None
    n_withheld: int | None = None
    n_positive: int | None = None
    rescore_detail: str = ""
    baseline_status: str = "not_attempted"
    zero: float | None = None
    unit: float | None = None
    baseline_recipe: str = ""
    baseline_detail: str = ""
    rescore_seconds: float | None = None
    baseline_seconds: float | None = None
    classes: list[str] = field(default_factory=list)

    def row(self, spark, run_id: str) -> DataFrame:
        return spark.createDataFrame(
            [(run_id, self.verified, self.rescore_status, self.rescore_detail,
              self.refit_claim_gap, self.n_withheld, self.zero, self.unit, self.baseline_status,
              self.baseline_detail, self.baseline_recipe, self.rescore_seconds,
              self.baseline_seconds)],
            "run_id string, verified_holdout_score double, rescore_status string, "
            "rescore_detail string, refit_claim_gap double, n_withheld_rows bigint, "
            "baseline_zero_score double, baseline_unit_score double, baseline_status string, "
            "baseline_detail string, baseline_recipe string, rescore_seconds double, "
            "baseline_seconds double")


@dataclass(frozen=True)
class Task:
    target: str
    kind: str = "binary"
    metric: str = "roc_auc"
    positive: str | None = None


def encoded(agent: DataFrame, other: DataFrame | None, task: Task):
    """Both tables with ``y``; the positive class is resolved on the agents' rows alone."""
    positive = None
    mismatch = False
    if task.kind == "binary":
        positive, mismatch = resolve_positive(agent, task.target, task.positive).first()
    y = [encode_target(d, task.target, task.kind, positive) if d is not None else None
         for d in (agent, other)]
    return y[0], y[1], positive, mismatch


def rescore(agent: DataFrame, withheld: DataFrame | None, assignment: DataFrame, task: Task,
            fit: FittedTransform, chosen: str | None, claimed: float | None, *,
            tolerance: float = vocab.REFIT_TOLERANCE, seed: int = vocab.DEFAULT_SEED,
            specs: dict | None = None, row_id: str = "row_id") -> Grade:
    """Refit the promoted candidate, check it against the claim, score it on withheld rows."""
    grade = Grade()
    specs = specs or models.CANDIDATES[task.kind]
    if withheld is None:
        grade.rescore_status = "no_withheld_holdout"
    elif chosen is None:
        grade.rescore_status = "no_model"
    elif not fit.source_columns:
        grade.rescore_status = "empty_matrix"
    elif chosen not in specs:
        grade.rescore_status = "unknown_model_spec"
    if grade.rescore_status != "not_attempted":
        return grade
    own, held, positive, mismatch = encoded(agent, withheld, task)
    if mismatch:
        grade.rescore_detail = f"positive class fell back to {positive!r}"
    try:
        features = models.prepared_features(attach(own, assignment, row_id), fit, row_id)
        classes = grade.classes = models.label_classes(features, task.kind)
        train = features.filter(F.col("part") != HOLDOUT)
        model = models.fit_model(specs[chosen], train, task.kind, classes, seed)

        def value(rows: DataFrame) -> float | None:
            return models.evaluate(model.predict(rows), task.metric, task.kind, classes).first()[0]

        grade.refit = value(features.filter(F.col("part") == HOLDOUT))
        usable = held.filter(F.col("y").isNotNull())
        single = False
        if task.kind == "binary":
            facts = scoring_rows(usable).first()
            grade.n_withheld, grade.n_positive, single = facts
        else:
            grade.n_withheld = usable.count()
        if not single and grade.n_withheld:
            grade.verified = value(models.assemble(usable, fit, ["y"]))
        features.unpersist()
    except Exception as error:  # the grader's failure is a status of the grade, not of the run
        grade.rescore_status = "snippet_failed"
        grade.rescore_detail = f"{type(error).__name__}: {error}"[:vocab.ERROR_MESSAGE_LIMIT]
        return grade
    grade.refit_claim_gap = None if claimed is None or grade.refit is None \
        else grade.refit - claimed
    if single:
        grade.rescore_status = "single_class_holdout"
    elif grade.refit_claim_gap is None or abs(grade.refit_claim_gap) > tolerance:
        grade.rescore_status = "refit_mismatch"
    else:
        grade.rescore_status = "ok"
    return grade


def baseline(agent: DataFrame, withheld: DataFrame | None, assignment: DataFrame, task: Task,
             grade: Grade, *, seed: int = vocab.DEFAULT_SEED, estimator=None,
             row_id: str = "row_id") -> Grade:
    """Add the zero point (constant prediction) and the unit point (forest on raw columns)."""
    if withheld is None:
        grade.baseline_status = "no_withheld_holdout"
        return grade
    if grade.verified is None:
        grade.baseline_status = "rescore_unavailable"
        grade.baseline_detail = f"rescore_status={grade.rescore_status}"
        return grade
    own, held, _, _ = encoded(agent, withheld, task)
    train = attach(own, assignment, row_id).filter(
        (F.col("part") != HOLDOUT) & F.col("y").isNotNull()).drop("part")
    usable = held.filter(F.col("y").isNotNull())
    sources = [c for c in agent.columns if c not in (task.target, row_id)]
    if not sources:
        grade.baseline_status = "empty_source_matrix"
        return grade
    if task.kind != "regression":
        low, high = train.agg(F.min("y"), F.max("y")).first()
        if low == high:
            grade.baseline_status = "single_class_train"
            return grade
    grade.baseline_status, grade.baseline_recipe = "ok", vocab.BASELINE_RECIPE
    classes = models.label_classes(train, task.kind)
    try:
        constant = metrics.zero_point(train, usable, task.kind)
        if task.kind == "multiclass":
            shares = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
            total = sum(shares.values())
            constant = constant.withColumn(
                "scores", F.array(*[F.lit(shares[c] / total) for c in classes]))
        grade.zero = models.evaluate(constant, task.metric, task.kind, classes).first()[0]
    except Exception as error:
        grade.baseline_status = "zero_point_failed"
        grade.baseline_detail = f"{type(error).__name__}: {error}"[:vocab.ERROR_MESSAGE_LIMIT]
    try:
        raw = fit_ordinal(train.select(row_id, task.target, *sources), task.target, row_id)
        order = F.array(*[F.col(f"`{c}`") for c in raw.feature_order])

        def matrix(df: DataFrame) -> DataFrame:
            return raw.transform(df, ["y"]).select(
                "y", models.array_to_vector(order).alias("features"))

        forest = estimator() if estimator else models.forest(task.kind, seed)
        model = models.fit_model(lambda facts, s: forest, matrix(train), task.kind, classes, seed)
        predicted = model.predict(matrix(usable))
        slim = predicted.select(*[c for c in ("y", "prediction", "score", "scores") if c in predicted.columns]).persist()
        grade.unit = models.evaluate(slim, task.metric, task.kind, classes).first()[0]
        slim.unpersist()
    except Exception as error:
        grade.baseline_status = "unit_point_failed"
        grade.baseline_detail = f"{type(error).__name__}: {error}"[:vocab.ERROR_MESSAGE_LIMIT]
    return grade
