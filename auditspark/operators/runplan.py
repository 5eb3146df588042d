"""Run plans, spend caps and dataset admission as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.operators.ranking import running_totals

# ---------------------------------------------------------------- plan


def plan(cells: DataFrame, replicates: int, n: int) -> DataFrame:
    """Replicate-major run plan with a dense ``seq``.

    ``cells`` carries ``ord`` (0-based). Every cell's first replicate precedes every second one,
    so a spend cap hits all cells evenly. The position is arithmetic; nothing is sorted or joined.
    """
    width = cells.count()
    return (
        cells.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("seq", (
            ((F.col("replicate") - 1).cast("bigint") * F.lit(width) + F.col("ord")) * F.lit(n)
            + F.col("run_index"))))


def plan_estimate(planned: DataFrame) -> DataFrame:
    return planned.agg(F.count("*").alias("runs"), F.sum("est_cost_usd").alias("estimated_usd"))


# ---------------------------------------------------------------- spend replay


def charges(outcomes: DataFrame) -> DataFrame:
    """What each run costs the cap: the measured cost, or the estimate of a run that failed."""
    return outcomes.withColumn(
        "charge", F.when(F.col("failed"), F.col("est_cost_usd")).otherwise(F.col("cost_usd")))


def first_cap_hit(outcomes: DataFrame, cap: float) -> DataFrame:
    """(seq, spent): the first run that may not start because its estimate would pass the cap.

    ``outcomes(seq, est_cost_usd, cost_usd, failed)``. Spend is accumulated in ranges of ``seq``.
    """
    walked = running_totals(charges(outcomes), "seq", {"__upto": F.col("charge")})
    spent = F.col("__upto") - F.col("charge")
    return walked.filter(spent + F.col("est_cost_usd") > cap).agg(
        F.min("seq").alias("seq"), F.min_by(spent, F.col("seq")).alias("spent"))


_SPAN = 65_536


def first_failure_streak(outcomes: DataFrame,
                         length: int = vocab.MAX_CONSECUTIVE_FAILURES) -> DataFrame:
    """(seq): the run completing the first ``length`` consecutive failures.

    ``seq`` is dense, so the log is cut into spans of 65,536 runs, each handed the last
    ``length - 1`` runs of the span before it; a streak across a border is then seen whole.
    """
    span = F.floor(F.col("seq") / _SPAN).cast("bigint")
    tail = (F.col("seq") % _SPAN) >= _SPAN - (length - 1)
    placed = outcomes.select("seq", "failed", F.explode(
        F.when(tail, F.array(span, span + 1)).otherwise(F.array(span))).alias("span"))
    order = Window.partitionBy("span").orderBy("seq")
    streak = F.col("failed")
    for k in range(1, length):
        streak = streak & F.coalesce(F.lag("failed", k).over(order), F.lit(False))
    return placed.withColumn("__streak", streak).filter("__streak").agg(F.min("seq").alias("seq"))


def stop_reason(outcomes: DataFrame, cap: float) -> dict:
    """Why and where a replay stops: the cap is checked before a run, failures after it."""
    capped = first_cap_hit(outcomes, cap).first().seq
    failed = first_failure_streak(outcomes).first().seq
    if capped is not None and (failed is None or capped <= failed):
        return {"stopped_early": "cost cap", "ran": int(capped)}
    if failed is not None:
        return {"stopped_early": "consecutive failures", "ran": int(failed) + 1}
    return {"stopped_early": None, "ran": outcomes.count()}


def cell_tally(cells: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts and spend per planned cell; a cell that never ran reads zeros.

    ``outcomes(cell, failed, publishable, cost_usd, est_cost_usd, leakage_remediated, errored)``.
    """
    failed = F.col("failed")
    written = ~failed & F.col("publishable")
    tallied = outcomes.groupBy("cell").agg(
        F.count_if(written).alias("rows_written"),
        F.count_if(~failed & ~F.col("publishable")).alias("rows_refused"),
        F.count_if(failed).alias("runs_failed"),
        F.sum(F.when(failed, F.col("est_cost_usd")).otherwise(F.col("cost_usd"))).alias(
            "spend_usd"),
        F.coalesce(F.sum(F.when(failed, F.col("est_cost_usd"))), F.lit(0.0)).alias(
            "charged_estimate_usd"),
        F.count_if(written & F.coalesce("leakage_remediated", F.lit(False))).alias(
            "leakage_remediated"),
        F.count_if(written & F.col("errored")).alias("errored"))
    return cells.select("cell").join(tallied, "cell", "left").fillna(0)


def annotate(rows: DataFrame, subset: str, name: str, plan: DataFrame | None = None) -> DataFrame:
    """Harness annotations; the name becomes part of a path, so its form is checked.

    ``plan`` holds ``cell``, ``replicate`` and ``run_index`` of each ``run_id``; a run outside it
    has none.
    """
    import re

    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", name):
        raise ValueError(f"eval name {name!r} must be lowercase letters, digits and hyphens")
    if plan is not None:
        added = ["cell", "replicate", "run_index"]
        rows = rows.drop(*added).join(plan.select("run_id", *added), "run_id", "left")
    return rows.withColumns({"eval_subset": F.lit(subset), "eval_name": F.lit(name)})


def price_per_cell(rows: DataFrame, by: str = "cell") -> DataFrame:
    """Mean measured cost, rounded up to a tenth of a cent."""
    return rows.groupBy(by).agg(
        (F.ceil(F.round(F.avg("cost_usd") * 1000, 6)) / 1000.0).alias("est_cost_usd"))


# ---------------------------------------------------------------- cost model


def cost_model(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares y = a + b*x1 + c*x2 from one pass of centred sums, with the residual sd.

    Covariances are built-in aggregates, so the fit is a single map-side aggregation followed by
    arithmetic on one row.
    """
    a, b, c = F.col(x1), F.col(x2), F.col(y)
    s = rows.agg(
        F.count("*").alias("n"), F.avg(c).alias("my"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
        F.var_pop(a).alias("v1"), F.var_pop(b).alias("v2"), F.var_pop(c).alias("vy"),
        F.covar_pop(a, b).alias("c12"), F.covar_pop(a, c).alias("c1y"),
        F.covar_pop(b, c).alias("c2y"))
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    fitted = s.withColumn(
        "b", (F.col("c1y") * F.col("v2") - F.col("c2y") * F.col("c12")) / det).withColumn(
        "c", (F.col("c2y") * F.col("v1") - F.col("c1y") * F.col("c12")) / det)
    unexplained = F.col("vy") - F.col("b") * F.col("c1y") - F.col("c") * F.col("c2y")
    return fitted.select(
        "n", (F.col("my") - F.col("b") * F.col("m1") - F.col("c") * F.col("m2")).alias("a"), "b",
        "c", F.sqrt(F.greatest(unexplained, F.lit(0.0)) * F.col("n") / (F.col("n") - 3)).alias(
            "residual_sd"))


# ---------------------------------------------------------------- dataset admission


def failed_rule(rule: dict | None = None) -> Column:
    """First admission limit a measured dataset breaks, or why it could not be measured."""
    r = rule or vocab.SELECTION
    return (
        F.when(F.col("failed").isNotNull(), F.col("failed"))
        .when(F.col("n_rows") > r["max_rows"], "max_rows")
        .when(F.col("n_features") > r["max_features"], "max_features")
        .when(F.col("n_rows") * F.col("n_features") > r["max_cells"], "max_cells")
        .when(F.col("n_usable_features") < r["min_usable_features"], "min_usable_features"))


def select_datasets(measured: DataFrame, rule: dict | None = None) -> DataFrame:
    """measured(dataset_id, name, n_rows, n_features, n_usable_features, failed) with ``failed``
    filled by the rule; beyond the target count the largest tables are ``target_count``.

    The rank filter runs before the shuffle, so only the smallest ``target_high`` survivors of
    each task are compared.
    """
    r = rule or vocab.SELECTION
    judged = measured.withColumn("failed", failed_rule(r))
    admitted = judged.filter(F.col("failed").isNull())
    order = [(F.col("n_rows") * F.col("n_features")).asc(), F.col("dataset_id").asc()]
    kept = admitted.orderBy(*order).limit(r["target_high"]).select("dataset_id")
    surplus = admitted.join(F.broadcast(kept), "dataset_id", "left_anti").withColumn(
        "failed", F.lit("target_count"))
    chosen = admitted.join(F.broadcast(kept), "dataset_id", "left_semi")
    return judged.filter(F.col("failed").isNotNull()).unionByName(surplus).unionByName(chosen)


def count_warning(selected: DataFrame, rule: dict | None = None) -> DataFrame:
    r = rule or vocab.SELECTION
    return selected.agg(F.count_if(F.col("failed").isNull()).alias("kept")).withColumn(
        "outside_target", ~F.col("kept").between(r["target_low"], r["target_high"]))


def exclusions(selected: DataFrame) -> DataFrame:
    """Rejected datasets with the measurements that rejected them, by reason then name."""
    return selected.filter(F.col("failed").isNotNull()).select(
        "name", "failed", F.create_map(
            F.lit("n_rows"), F.col("n_rows").cast("bigint"),
            F.lit("n_features"), F.col("n_features").cast("bigint"),
            F.lit("n_usable_features"), F.col("n_usable_features").cast("bigint")).alias(
                "measured")).orderBy("failed", F.lower("name"))


def published_best(evaluations: DataFrame) -> DataFrame:
    """Best published score per task with the run that made it; tasks without one keep NULL.

    ``evaluations(task_id, run_id, flow_name, value)``. Ties go to the smallest run id.
    """
    best = F.max(F.when(F.col("value").isNotNull(), F.struct(
        F.col("value"), (-F.col("run_id")).alias("neg"), "flow_name")))
    return evaluations.groupBy("task_id").agg(best.alias("b")).select(
        "task_id", (-F.col("b.neg")).alias("run_id"), F.col("b.flow_name").alias("flow_name"),
        F.round(F.col("b.value"), 6).alias("value"))


def candidate_list(*lists: DataFrame) -> DataFrame:
    """Union of named lists ordered by lower-case name, then task id."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.orderBy(F.lower("name"), "task_id")
