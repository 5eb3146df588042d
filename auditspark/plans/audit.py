"""One audit of one table, end to end."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.operators import grading, metrics, models, profile, split, transform
from auditspark.operators.grading import Grade, Task


@dataclass
class Audit:
    """Everything one audit produced; tables stay distributed, scores are plain numbers."""

    prepared: split.Prepared
    profile: DataFrame
    association: DataFrame
    forced: DataFrame
    drops: list[str]
    assignment: DataFrame
    fit: transform.FittedTransform
    candidates: list[models.Candidate]
    chosen: str | None
    importances: DataFrame | None
    grade: Grade

    @property
    def claimed(self) -> float | None:
        return next((c.holdout_score for c in self.candidates if c.name == self.chosen), None)

    def evidence(self) -> DataFrame:
        return profile.evidence(self.profile, self.association, self.prepared.target)


def audit(df: DataFrame, task: Task, *, drops: tuple[str, ...] = (), naming: str = "descriptive",
          withheld_fraction: float = 0.2, spec: split.SplitSpec | None = None,
          binding: DataFrame | None = None, specs: dict | None = None, forest=None,
          importances: bool = True, repeats: int = vocab.PERMUTATION_REPEATS,
          seed: int = vocab.DEFAULT_SEED, row_id: str = "row_id") -> Audit:
    """Profile, split, transform, fit, explain, and grade ``df`` against ``task.target``.

    The withheld rows are carved before anything else looks at the table and are read again only
    by the grader. ``drops`` are proposals; forced drops are added to them.
    """
    spec = spec or split.SplitSpec(seed=seed)
    prepared = split.prepare(df, task.target, withheld_fraction, seed, row_id, naming)
    agent = prepared.agent
    columns = [c for c in agent.columns if c != row_id]
    profiled = profile.column_profile(agent.select(*columns))
    associated = profile.association(agent, task.target, columns, row_id)
    forced = transform.forced_drops(profiled, task.target, binding)
    spark = df.sparkSession
    proposed = spark.createDataFrame([(c,) for c in drops], "column string")
    merged = transform.merge_drops(profiled, forced, proposed)
    # Column names only; their number is the width of the table.
    gone = sorted(r["column"] for r in merged.select("column").collect()
                  if r["column"] != task.target)
    assignment = split.pin_split(agent, task.target, spec, row_id)
    split.verify_split(agent, assignment, row_id=row_id)
    own, _, _, _ = grading.encoded(agent, None, task)
    # Every fitting step below scans this join, so it is kept rather than recomputed.
    assigned = split.attach(own, assignment, row_id).persist(StorageLevel.MEMORY_AND_DISK)
    train = assigned.filter(F.col("part") != split.HOLDOUT)
    fit = transform.fit_transform(train.drop("part", "y"), task.target, gone, row_id)
    entries: list[models.Candidate] = []
    chosen, explained = None, None
    if fit.source_columns:
        features = models.prepared_features(assigned, fit, row_id)
        entries = models.cross_validate(features, task.kind, task.metric, spec.folds, specs, seed)
        features.unpersist()
        best = metrics.best_candidate(
            models.candidate_rows(spark, "audit", entries), task.metric).first()
        chosen = best.best if best else None
        model = next((e.model for e in entries if e.name == chosen), None)
        if model is not None and importances:
            held = assigned.filter(F.col("part") == split.HOLDOUT)
            explained = models.permutation_importance(
                model, fit, held, task.metric, repeats=repeats, seed=seed, row_id=row_id)
    assigned.unpersist()
    claimed = next((e.holdout_score for e in entries if e.name == chosen), None)
    began = time.monotonic()
    grade = grading.rescore(agent, prepared.withheld, assignment, task, fit, chosen, claimed,
                            seed=seed, specs=specs, row_id=row_id)
    graded = time.monotonic()
    if prepared.withheld is not None and grade.verified is not None:
        grade.rescore_seconds = graded - began
    grade = grading.baseline(agent, prepared.withheld, assignment, task, grade, seed=seed,
                             estimator=forest, row_id=row_id)
    if grade.baseline_recipe:
        grade.baseline_seconds = time.monotonic() - graded
    return Audit(prepared, profiled, associated, forced, gone, assignment, fit, entries, chosen,
                 explained, grade)
