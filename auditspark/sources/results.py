"""Append-only JSON-lines logs: results rows and metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
_COUNTS = T.MapType(T.StringType(), T.LongType())


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


# Maps are declared: inference would read them as structs whose fields differ from file to file.
RESULTS = T.StructType([
    *_fields(T.StringType(), "run_id dataset_id arm default_model reviewer_model reviewer_prompt "
             "naming objection_routing objection_closure forced_drop_release commit "
             "dataset_source dataset_hash metric rescore_status rescore_detail baseline_status "
             "baseline_detail baseline_recipe top_importance_status review_verdict halted_at "
             "cell eval_subset eval_name"),
    *_fields(T.BooleanType(), "reviewer_enabled reviewer_sees_code leakage_graded leakage_caught "
             "leakage_remediated profiler_caught reviewer_caught errored"),
    *_fields(T.LongType(), "loop_cap random_seed n_withheld_rows false_alarm false_alarm_standing "
             "n_final_features n_skipped_high_cardinality n_candidates "
             "n_candidates_failed_to_fit top_importance_n80 profiler_false_alarm "
             "reviewer_false_alarm review_loops objections_raised objections_open_at_end "
             "objections_resolved objections_withdrawn objections_falsely_resolved "
             "objections_rerouted replicate run_index"),
    *_fields(T.DoubleType(), "holdout_fraction claimed_holdout_score verified_holdout_score "
             "holdout_claim_gap refit_claim_gap baseline_zero_score baseline_unit_score "
             "baseline_normalised_score baseline_separation leakage_recall leakage_precision "
             "top_importance_share profiler_recall reviewer_recall wall_seconds rescore_seconds "
             "baseline_seconds cost_usd"),
    *_fields(_STRINGS, "leakage_planted leakage_flagged false_alarm_columns "
             "leakage_flagged_standing candidates_failed_to_fit profiler_nominated "
             "reviewer_nominated objected_columns_unremediated route_sequence"),
    *_fields(T.ArrayType(T.LongType()), "new_objections_per_pass"),
    *_fields(_COUNTS, "objections_by_category objections_by_target_node"),
    T.StructField("node_seconds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("errors", T.ArrayType(T.StructType([
        T.StructField("node", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("recoverable", T.BooleanType())]))),
])
METRICS = "run_id string, name string, value double"


def read_results(spark: SparkSession, paths: str | list[str],
                 schema: T.StructType = RESULTS) -> DataFrame:
    """One row per JSON line with its file name; blank lines are skipped and a column a file
    predates reads as NULL."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return rows.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value): the raw text, for questions about which keys a file wrote."""
    return spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), "value")


def _gated(rows: DataFrame, gate: DataFrame) -> tuple[DataFrame, Observation]:
    """Publishable rows, and what the write that follows will have written and refused."""
    allowed = gate.groupBy("run_id").agg(F.bool_and("publishable").alias("publishable"))
    counts = Observation()
    judged = rows.join(allowed, "run_id", "left").withColumn(
        "publishable", F.coalesce("publishable", F.lit(False))).observe(
            counts, F.count_if("publishable").alias("written"), F.count_if(~F.col("publishable")).alias("refused"))
    return judged.filter("publishable").drop("publishable"), counts


def append_results(rows: DataFrame, gate: DataFrame, path: str,
                   partition_by: list[str] | None = None) -> dict[str, int]:
    """Append publishable rows as JSON lines; refused ones are counted, not written.

    ``gate`` is (run_id, publishable). A run the gate does not know is refused, and so is one of
    which it says both. The counts are those of the rows that passed through the write itself.
    """
    kept, counts = _gated(rows, gate)
    writer = kept.write.mode("append").option("ignoreNullFields", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)
    return {k: counts.get[k] for k in ("written", "refused")}


def commit_results(rows: DataFrame, gate: DataFrame, path: str, *, day: str, batch: str) -> dict[str, int]:
    """Put annotated publishable rows under ``path``/day/eval_name/batch, again if need be.

    The files are staged and then take the place of those partitions alone, so a commit repeated
    after a failure adds no row, and other days, names and batches stay. Counts as in
    :func:`append_results`.
    """
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) or not re.fullmatch(r"[a-z0-9][a-z0-9-]*", batch):
        raise ValueError(f"day {day!r} and batch {batch!r} must be a date and lowercase letters, digits and hyphens")
    kept, counts = _gated(rows, gate)
    dated = kept.withColumns({"day": F.lit(day), "batch": F.lit(batch)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "ignoreNullFields", False).partitionBy("day", "eval_name", "batch").json(path)
    return {k: counts.get[k] for k in ("written", "refused")}


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select("run_id", "name", F.col("value").cast("double").alias("value")).write.mode(
        "append").json(path)


def stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METRICS).json(path)
