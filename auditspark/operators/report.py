"""Aggregates a results report is written from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.operators.transform import medians


def schema_drift(lines: DataFrame, current: Sequence[str]) -> DataFrame:
    """lines(file, value: JSON text) -> per file: rows, columns, missing and extra names.

    Keys are read from the text, so a column is present only where a file really wrote it.
    """
    rows = lines.filter(F.trim("value") != "")
    keys = rows.select("file", F.explode(F.json_object_keys("value")).alias("key")).distinct()
    known = F.array(*[F.lit(c) for c in current])
    per_file = keys.groupBy("file").agg(F.collect_list("key").alias("keys"))  # schema-sized
    counts = rows.groupBy("file").agg(F.count("*").alias("n_rows"))
    return counts.join(per_file, "file", "left").select(
        "file", "n_rows", F.size("keys").cast("bigint").alias("n_columns"),
        F.size(F.array_except(known, "keys")).cast("bigint").alias("n_missing"),
        F.array_sort(F.array_except("keys", known)).alias("extra"))


def run_summary(rows: DataFrame, config: Sequence[str] = ()) -> DataFrame:
    """Rows, spend, minutes, distinct commits and configurations, halted runs."""
    configs = F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                          for c in config])) if config else F.lit(0).cast("bigint")
    return rows.agg(
        F.count("*").alias("runs"), F.sum("cost_usd").alias("cost_usd"),
        (F.sum("wall_seconds") / 60).alias("wall_minutes"),
        F.count_distinct("commit").alias("commits"), configs.alias("configurations"),
        F.count("halted_at").alias("halted"))


def dataset_means(rows: DataFrame, columns: Sequence[str], by: str = "dataset_id") -> DataFrame:
    """Means per dataset with a histogram of review loops; the dearest dataset first."""
    means = rows.groupBy(by).agg(
        *[F.avg(c).alias(c) for c in columns],
        F.count_if(F.col("objections_raised") > 0).alias("objecting_runs"),
        F.count("*").alias("runs"))
    loops = rows.groupBy(by, "review_loops").agg(F.count("*").alias("n")).groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("review_loops", "n")))).alias(
            "loops"))
    return means.join(loops, by).orderBy(F.desc("cost_usd"), by)


def gap_stats(rows: DataFrame, gap: str = "holdout_claim_gap", wide: float = 0.02) -> DataFrame:
    """Mean, median, extremes and the number of gaps wider than ``wide``."""
    middle = medians(rows.select(gap).filter(F.col(gap).isNotNull()), [gap])[gap]
    value = F.col(gap)
    return rows.agg(
        F.avg(value).alias("mean"), F.lit(middle).alias("median"), F.max(value).alias("max"),
        F.min(value).alias("min"), F.count_if(F.abs(value) > wide).alias("wide"),
        F.count(value).alias("n"))


def node_share(node_times: DataFrame) -> DataFrame:
    """node_times(run_id, node, seconds) -> mean seconds per node and its share of their sum."""
    means = node_times.groupBy("node").agg(F.avg("seconds").alias("mean_seconds"))
    total = means.agg(F.sum("mean_seconds")).first()[0]
    return means.select("node", "mean_seconds",
                        (100 * F.col("mean_seconds") / F.lit(total)).alias("percent"))


def node_times(rows: DataFrame) -> DataFrame:
    """(run_id, node, seconds) from the map column of results rows."""
    return rows.select("run_id", F.explode("node_seconds").alias("node", "seconds"))


ARM_KEYS = ("dataset_id", "naming", "reviewer_prompt", "objection_routing", "reviewer_model",
            "loop_cap", "forced_drop_release")


def arm_table(rows: DataFrame, keys: Sequence[str] = ARM_KEYS) -> DataFrame:
    """Rates and means per arm; NULL conditions form their own arm."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("profiler_recall").alias("profiler_recall"),
        F.count_if(F.coalesce("reviewer_caught", F.lit(False))).alias("reviewer_caught"),
        F.count_if(F.coalesce("leakage_remediated", F.lit(False))).alias("leakage_remediated"),
        F.avg("claimed_holdout_score").alias("claimed_holdout_score"),
        F.avg("cost_usd").alias("cost_usd"))


def loop_multiplier(rows: DataFrame, by: str = "dataset_id", loops: str = "review_loops",
                    cost: str = "cost_usd") -> DataFrame:
    """Cost of a run relative to its own dataset's mean one-loop run, averaged per loop count.

    sum(cost / mean) is sum(cost) / mean within a dataset, so the rows are aggregated to
    (dataset, loops) first and the one-loop mean is joined per dataset.
    """
    per = rows.groupBy(by, loops).agg(F.sum(cost).alias("total"), F.count(cost).alias("n"))
    first = per.filter(F.col(loops) == 1).select(by, (F.col("total") / F.col("n")).alias("base"))
    return per.join(first, by).groupBy(loops).agg(
        F.sum("n").alias("n"), (F.sum(F.col("total") / F.col("base")) / F.sum("n")).alias(
            "multiplier"), F.count("*").alias("datasets"))


def objection_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.sum("objections_raised").alias("objections"),
        F.count_if(F.col("objections_raised") > 0).alias("objecting_runs"),
        F.count("*").alias("runs"),
        F.count_distinct(F.when(F.col("objections_raised") > 0, F.col("dataset_id"))).alias(
            "datasets"),
        F.count_if("errored").alias("errored"),
        F.count_if(F.col("n_candidates_failed_to_fit") > 0).alias("fit_failures"))


def fired_categories(rows: DataFrame) -> DataFrame:
    """Non-zero objection categories of runs that erred or left an objected column in."""
    troubled = F.col("errored") | (F.size("objected_columns_unremediated") > 0)
    return rows.filter(F.coalesce(troubled, F.lit(False))).select(
        "run_id", "dataset_id", "review_verdict", "review_loops", "errored",
        F.map_filter("objections_by_category", lambda _, n: n > 0).alias("fired"))


def membership_rates(rows: DataFrame, columns: Sequence[str],
                     arrays: Sequence[str]) -> DataFrame:
    """How many rows list each given column in each array column, in one pass."""
    def hits(array: str, name: str) -> Column:
        return F.count_if(F.coalesce(F.array_contains(array, name), F.lit(False)))

    wide = rows.agg(F.count("*").alias("n"), *[
        hits(a, c).alias(f"{i}_{j}") for i, c in enumerate(columns) for j, a in enumerate(arrays)])
    return wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.col(f"{i}_{j}").alias(a) for j, a in enumerate(arrays)])
        for i, c in enumerate(columns)])).alias("s")).select("s.*", "n")
