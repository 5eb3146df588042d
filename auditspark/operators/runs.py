"""Grading each run into one wide row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.functions.exprs import flatten_note, truncate
from auditspark.operators import metrics, reviewlog
from auditspark.session import durable

_NAMES = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NAMES)


# ---------------------------------------------------------------- leakage against ground truth


def graded(planted: Column) -> Column:
    """Ground truth is a complete list or nothing: only a non-empty list can be graded against."""
    return F.coalesce(F.size(planted) > 0, F.lit(False))


def leakage_columns(planted: Column, flagged: Column, standing: Column,
                    final: Column) -> dict[str, Column]:
    """Set comparison of flagged columns with the planted ones; NULL wherever nothing was planted.

    ``final`` empty or NULL is not remediation: a run that shipped no matrix fixed nothing.
    """
    is_graded = graded(planted)
    flagged, standing = F.coalesce(flagged, _empty()), F.coalesce(standing, _empty())
    planted = F.coalesce(planted, _empty())
    hit = F.size(F.array_intersect(flagged, planted))
    wrong = F.array_sort(F.array_except(flagged, planted))
    return {
        "leakage_graded": is_graded,
        "leakage_planted": F.array_sort(planted),
        "leakage_flagged": F.array_sort(flagged),
        "leakage_caught": F.when(is_graded, hit > 0),
        "leakage_remediated": F.when(is_graded & (F.size(final) > 0),
                                     ~F.arrays_overlap(planted, final)),
        "leakage_recall": F.when(is_graded, hit / F.size(planted)),
        "leakage_precision": F.when(is_graded & (F.size(flagged) > 0), hit / F.size(flagged)),
        "false_alarm_columns": F.when(is_graded, wrong),
        "false_alarm": F.when(is_graded, F.size(wrong).cast("bigint")),
        "leakage_flagged_standing": F.array_sort(standing),
        "false_alarm_standing": F.when(
            is_graded, F.size(F.array_except(standing, planted)).cast("bigint")),
    }


def detector_columns(prefix: str, named: Column, planted: Column) -> dict[str, Column]:
    """One detector's columns: NULL when it never ran, zeros when it looked and declined."""
    is_graded = graded(planted)
    ran = named.isNotNull()
    hit = F.size(F.array_intersect(named, planted))
    return {
        f"{prefix}_nominated": F.array_sort(F.array_distinct(named)),
        f"{prefix}_caught": F.when(ran & is_graded, hit > 0),
        f"{prefix}_recall": F.when(ran & is_graded, hit / F.size(planted)),
        f"{prefix}_false_alarm": F.when(ran & is_graded, F.size(
            F.array_except(named, planted)).cast("bigint")),
    }


def surviving_plants(planted: DataFrame, dropped: DataFrame) -> DataFrame:
    """Planted columns a mechanical filter would remove; any row makes a test table useless."""
    return planted.join(dropped.select("column"), "column", "left_semi")


def missing_known(known: DataFrame, profile: DataFrame) -> DataFrame:
    """Documented leak columns that do not exist in the measured table; must be empty."""
    return known.join(profile.select("column"), "column", "left_anti")


# ---------------------------------------------------------------- cost and time


def publishable(runs: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, publishable, reason). A halted run is publishable; an untraced or stubbed one
    is not."""
    traced = events.groupBy("run_id").agg(
        F.bool_or(F.coalesce(F.col("model").isin(*vocab.PLACEHOLDER_MODELS), F.lit(False))).alias(
            "stubbed"))
    reason = F.when(F.col("stubbed").isNull(), "empty trace").when(
        F.col("stubbed"), "placeholder model in trace")
    return runs.select("run_id").join(traced, "run_id", "left").select(
        "run_id", reason.isNull().alias("publishable"), reason.alias("reason"))


def priced(usage: DataFrame, prices: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """usage with ``cost_usd``; tokens are priced per million in four tiers.

    ``prices`` (model, input, output, cache_write, cache_read) and ``aliases`` (alias, model) are
    price lists of a few rows. A model without a price is an error, never free.
    """
    staged = usage
    if aliases is not None:
        names = F.broadcast(aliases.select(F.col("alias").alias("model"),
                                           F.col("model").alias("__id")))
        staged = staged.join(names, "model", "left")
    else:
        staged = staged.withColumn("__id", F.lit(None).cast("string"))
    staged = staged.withColumn("__id", F.coalesce("__id", "model"))
    rates = F.broadcast(prices.select(F.col("model").alias("__id"), *[
        F.col(t).alias(f"__{t}") for t in ("input", "output", "cache_write", "cache_read")]))
    joined = staged.join(rates, "__id", "left")
    amount = F.lit(0.0)
    for tier in ("input", "output", "cache_write", "cache_read"):
        tokens = F.col(f"{tier}_tokens") if f"{tier}_tokens" in usage.columns else F.lit(0)
        amount = amount + F.coalesce(tokens, F.lit(0)) * F.col(f"__{tier}")
    # Raised inside the plan, so no extra pass over the usage log is needed to find the gap.
    cost = F.when(F.col("__input").isNotNull(), amount / 1e6).otherwise(
        F.raise_error(F.concat(F.lit("no price for model "), F.col("__id"))).cast("double"))
    return joined.withColumn("cost_usd", F.when(F.col("model").isNotNull(), cost).otherwise(
        F.lit(0.0))).select(*usage.columns, "cost_usd")


def run_costs(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.sum("cost_usd").alias("cost_usd"))


def _seconds(start: str, end: str) -> Column:
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (end, start)]
    return (micros[0] - micros[1]) / F.lit(1e6)


def node_seconds_long(events: DataFrame) -> DataFrame:
    """(run_id, node, seconds): repeats summed, unfinished visits contribute nothing."""
    return events.filter(F.col("ended").isNotNull()).groupBy("run_id", "node").agg(
        F.round(F.sum(_seconds("started", "ended")), 3).alias("seconds"))


def node_seconds(events: DataFrame) -> DataFrame:
    """(run_id, node_seconds map); nodes are a closed list of names, so the map stays small."""
    return node_seconds_long(events).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("node", "seconds"))).alias("node_seconds"))


def wall_seconds(started: str = "started_at", ended: str = "ended_at") -> Column:
    return F.when(F.col(ended).isNotNull(), _seconds(started, ended))


def trace_totals(events: DataFrame) -> DataFrame:
    """Per-run trace: one row per node and a grand total (node NULL, is_total true)."""
    rolled = events.groupBy("run_id", "node").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"))
    total = rolled.groupBy("run_id").agg(
        F.lit(None).cast("string").alias("node"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))
    return rolled.withColumn("is_total", F.lit(False)).unionByName(
        total.withColumn("is_total", F.lit(True)))


def stage_usage(calls: DataFrame) -> DataFrame:
    """Tokens, cost and last model per stage visit, summed over its calls."""
    return calls.groupBy("run_id", "node", "visit").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.max_by("model", "seq").alias("model"))


# ---------------------------------------------------------------- candidates


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Per run: candidates, fit failures and their names (a handful of candidates per run)."""
    failed = F.col("fit_error").isNotNull() & (F.col("fit_error") != "")
    return candidates.groupBy("run_id").agg(
        F.count("*").alias("n_candidates"), F.count_if(failed).alias("n_candidates_failed_to_fit"),
        F.array_sort(F.collect_set(F.when(failed, F.col("name")))).alias(
            "candidates_failed_to_fit"))


def candidate_table(candidates: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Report table: cv mean and scores, claim, and a one-line note of what went wrong."""
    mean = F.aggregate("cv_scores", F.lit(0.0), lambda a, x: a + x) / F.size("cv_scores")
    out = candidates.select(
        "run_id", "name", F.when(F.size("cv_scores") > 0, mean).alias("cv_mean"), "cv_scores",
        "claimed_holdout_score",
        F.coalesce(flatten_note(F.col("fit_error")), F.lit("")).alias("note"))
    if chosen is None:
        return out
    return out.join(chosen.select("run_id", F.col("chosen").alias("name"), F.lit(True).alias(
        "chosen")), ["run_id", "name"], "left").fillna(False, ["chosen"])


# ---------------------------------------------------------------- the wide row


CONDITIONS = (
    "run_id", "dataset_id", "arm", "reviewer_enabled", "default_model", "reviewer_model",
    "reviewer_prompt", "reviewer_sees_code", "naming", "loop_cap", "objection_routing",
    "objection_closure", "forced_drop_release", "random_seed", "commit", "dataset_source",
    "holdout_fraction", "dataset_hash",
)
GRADE_COLUMNS = (
    "verified_holdout_score", "rescore_status", "rescore_detail", "refit_claim_gap",
    "n_withheld_rows", "baseline_zero_score", "baseline_unit_score", "baseline_status",
    "baseline_detail", "baseline_recipe", "rescore_seconds", "baseline_seconds",
)


def attach_grades(runs: DataFrame, grades: DataFrame) -> DataFrame:
    """Grader outcome per run. A run never graded reads ``not_attempted`` with NULL durations;
    a grader failure is a status, never an error of the run."""
    joined = runs.join(grades.select("run_id", *GRADE_COLUMNS), "run_id", "left")
    return joined.withColumns({
        "rescore_status": F.coalesce("rescore_status", F.lit("not_attempted")),
        "baseline_status": F.coalesce("baseline_status", F.lit("not_attempted")),
        **{c: truncate(F.coalesce(c, F.lit(""))) for c in ("rescore_detail", "baseline_detail")},
        "baseline_recipe": F.coalesce("baseline_recipe", F.lit(""))})


def error_list(errors: DataFrame) -> DataFrame:
    """(run_id, errors): node, message cut to 500 characters, recoverable, in order."""
    reviewlog.within_one_row(errors, "errors")
    item = F.struct("seq", "node", truncate(F.col("message")).alias("message"), "recoverable")
    return errors.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("e")).select(
        "run_id", F.transform("e", lambda x: F.struct(
            x["node"].alias("node"), x["message"].alias("message"),
            x["recoverable"].alias("recoverable"))).alias("errors"))


def results_rows(runs: DataFrame, objections: DataFrame, passes: DataFrame,
                 candidates: DataFrame, nominations: DataFrame, events: DataFrame,
                 errors: DataFrame, grades: DataFrame) -> DataFrame:
    """One wide row per run from the fact tables, keyed by ``run_id``.

    ``runs`` carries the conditions, ``metric``, ``profiled``, ``planted``, ``final_features``,
    ``skipped_high_cardinality``, ``top_importances`` (array<struct<column,mean>>),
    ``chosen_model``, ``review_verdict``, ``review_loops``, ``started_at`` and ``ended_at``. Each
    fact is aggregated to one row per run before it is joined, so a run with most of the log
    behaves like any other in the joins.
    """
    passes = durable(passes)  # read three times below
    latest = reviewlog.latest_dispositions(reviewlog.exploded_dispositions(passes))
    nominated = nominations.select("run_id", "column").distinct().groupBy("run_id").agg(
        F.collect_list("column").alias("__nominated"))
    claimed = candidates.select(
        "run_id", F.col("name").alias("chosen_model"), "claimed_holdout_score").join(
            runs.select("run_id", "chosen_model"), ["run_id", "chosen_model"], "left_semi").drop(
                "chosen_model")
    facts = [
        reviewlog.review_facts(objections, latest, runs), nominated, claimed, candidate_summary(candidates),
        reviewlog.route_sequences(passes), node_seconds(events), run_costs(events),
        reviewlog.halts(errors).drop("halted"), error_list(errors),
    ]
    wide = attach_grades(runs, grades)
    for fact in facts:
        wide = wide.join(fact, "run_id", "left")

    c = F.col
    planted, final = c("planted"), c("final_features")
    reviewed = c("reviewer_enabled") & c("route_sequence").isNotNull()
    named_by_profiler = F.when(c("profiled"), F.coalesce(c("__nominated"), _empty()))
    named_by_reviewer = F.when(reviewed, F.coalesce(c("__objected"), _empty()))
    share, n80, shape = metrics.importance_shape_of(c("top_importances"))
    metric = c("metric")

    def zeros(values: Sequence[str]) -> Column:
        return F.create_map(*[F.lit(x) for v in values for x in (v, 0)]).cast("map<string,bigint>")

    def count(name: str) -> Column:
        return F.coalesce(c(name), F.lit(0))

    def when_reviewed(name: str, default: Column) -> Column:
        return F.when(reviewed, F.coalesce(c(name), default))

    has_matrix = F.coalesce(F.size(final) > 0, F.lit(False))
    columns: dict[str, Column] = {
        **{k: c(k) for k in CONDITIONS},
        "claimed_holdout_score": c("claimed_holdout_score"),
        "verified_holdout_score": c("verified_holdout_score"),
        "holdout_claim_gap": metrics.claim_gap(
            c("claimed_holdout_score"), c("verified_holdout_score"), metric),
        "metric": metric,
        **{k: c(k) for k in ("rescore_status", "rescore_detail", "refit_claim_gap",
                             "n_withheld_rows", "baseline_zero_score", "baseline_unit_score")},
        "baseline_normalised_score": F.when(metric.isNotNull(), metrics.normalised(
            c("verified_holdout_score"), c("baseline_zero_score"), c("baseline_unit_score"),
            metric, graded(planted))),
        "baseline_separation": F.when(metric.isNotNull(), metrics.separation(
            c("baseline_zero_score"), c("baseline_unit_score"), metric)),
        **{k: c(k) for k in ("baseline_status", "baseline_detail", "baseline_recipe")},
        **leakage_columns(planted, c("__flagged"), c("__standing"), final),
        "n_final_features": F.when(final.isNotNull(), F.size(final).cast("bigint")),
        "n_skipped_high_cardinality": F.size(
            F.coalesce("skipped_high_cardinality", _empty())).cast("bigint"),
        "n_candidates": count("n_candidates"),
        "n_candidates_failed_to_fit": count("n_candidates_failed_to_fit"),
        "candidates_failed_to_fit": F.coalesce("candidates_failed_to_fit", _empty()),
        "top_importance_share": share, "top_importance_n80": n80, "top_importance_status": shape,
        **detector_columns("profiler", named_by_profiler, planted),
        **detector_columns("reviewer", named_by_reviewer, planted),
        "review_verdict": c("review_verdict"), "review_loops": c("review_loops"),
        "objections_raised": count("objections_raised"),
        "objections_by_category": F.coalesce("objections_by_category", zeros(vocab.CATEGORIES)),
        "objections_open_at_end": count("objections_open_at_end"),
        "objections_resolved": when_reviewed("objections_resolved", F.lit(0)),
        "objections_withdrawn": when_reviewed("objections_withdrawn", F.lit(0)),
        "objections_falsely_resolved": F.when(
            has_matrix, when_reviewed("objections_falsely_resolved", F.lit(0))),
        "objections_by_target_node": F.coalesce(
            "objections_by_target_node", zeros(vocab.ACTING_NODES)),
        "objections_rerouted": count("objections_rerouted"),
        "objected_columns_unremediated": F.when(
            has_matrix, F.array_sort(F.array_intersect(named_by_reviewer, final))),
        "route_sequence": F.coalesce("route_sequence", _empty()),
        "new_objections_per_pass": F.coalesce(
            "new_objections_per_pass", F.array().cast("array<bigint>")),
        "wall_seconds": wall_seconds(),
        "rescore_seconds": c("rescore_seconds"), "baseline_seconds": c("baseline_seconds"),
        "node_seconds": F.coalesce("node_seconds", F.create_map().cast("map<string,double>")),
        "cost_usd": F.coalesce("cost_usd", F.lit(0.0)),
        "errored": F.coalesce("errored", F.lit(False)),
        "halted_at": c("halted_at"),
        "errors": F.coalesce("errors", F.array().cast(
            "array<struct<node:string,message:string,recoverable:boolean>>")),
    }
    return wide.select(*[expr.alias(name) for name, expr in columns.items()])


def loop_exhausted(iterations: Column, cap: Column) -> Column:
    return iterations >= cap
