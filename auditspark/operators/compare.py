"""Comparing two sets of runs cell by cell.

A cell is one combination of run conditions. Nothing is ever rolled up across cells, and a
difference between too few replicates is called underpowered however large it looks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.functions.exprs import (
    disjoint, field_types, metric_outcome, power_verdict, metric_ask, wilson,
)


def with_cell_keys(df: DataFrame, keys: Sequence[str] = vocab.CONDITION_FIELDS) -> DataFrame:
    """Conditions as strings; one a file predates reads as NULL, which is a value like any other."""
    types = field_types(df)
    return df.withColumns({
        k: F.col(k).cast("string") if k in types else F.lit(None).cast("string") for k in keys})


def _outcomes(df: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys..., replicate, metric, success): one row per run and metric."""
    types = field_types(df)
    replicate = F.col("replicate").cast("bigint") if "replicate" in types \
        else F.lit(None).cast("bigint")
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), metric_outcome(df, m).alias("success"))
        for m in metrics])).alias("__m")
    return with_cell_keys(df, keys).select(
        *keys, replicate.alias("replicate"), cells).select(
            *keys, "replicate", "__m.metric", "__m.success")


def tally(df: DataFrame, metrics: Sequence[str] = vocab.DEFAULT_METRICS,
          keys: Sequence[str] = vocab.CONDITION_FIELDS, extra: Sequence[str] = ()) -> DataFrame:
    """Successes, denominator, excluded rows and replicate buckets per cell and metric.

    A NULL metric is excluded, never a failure. Two levels of aggregation: (cell, metric,
    replicate) is combined map-side, so the size of a cell does not matter.
    """
    by = [*extra, *keys, "metric"]
    outcomes = _outcomes(df, metrics, [*extra, *keys])
    buckets = outcomes.groupBy(*by, "replicate").agg(
        F.count_if("success").alias("s"), F.count("success").alias("n"),
        F.count_if(F.col("success").isNull()).alias("x"))
    return _fold_replicates(buckets, by)


def _fold_replicates(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    labelled = F.coalesce(F.bool_or(F.col("replicate").isNotNull()), F.lit(False))
    used = F.col("n") > 0  # a replicate without a single measured row is no bucket
    item = F.struct(F.col("replicate").isNull().alias("last"), F.col("replicate").alias("r"),
                    F.col("s").alias("successes"), F.col("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.when(used, item)))
    pairs = F.transform(ordered, lambda b: F.struct(b["successes"].alias("successes"),
                                                    b["n"].alias("n")))
    return buckets.groupBy(*by).agg(
        F.sum("s").alias("successes"), F.sum("n").alias("n"), F.sum("x").alias("excluded"),
        F.when(labelled, F.count_if(used)).otherwise(F.lit(0)).alias("replicates"),
        F.when(labelled, pairs).otherwise(F.slice(pairs, 1, 0)).alias("per_replicate"))


def with_interval(counts: DataFrame, z: float = vocab.WILSON_Z) -> DataFrame:
    low, high = wilson(F.col("successes"), F.col("n"), z)
    return counts.withColumns({"low": low, "high": high})


def _majority(successes: Column, n: Column) -> Column:
    """The more common outcome, ties counting as True; NULL without rows."""
    return F.when(n > 0, successes * 2 >= n)


def compare(before: DataFrame, after: DataFrame,
            metrics: Sequence[str] = vocab.DEFAULT_METRICS,
            keys: Sequence[str] = vocab.CONDITION_FIELDS, z: float = vocab.WILSON_Z) -> DataFrame:
    """One row per cell and metric with both sides, the verdict and a direction flip.

    The sides are tallied together and folded on the cell, so NULL conditions meet NULL conditions
    without a null-safe join, and a cell on one side only is still reported.
    """
    for m in metrics:
        metric_ask(m)  # an unknown predicate must fail before any job starts
    both = _outcomes(before, metrics, keys).withColumn("side", F.lit("before")).unionByName(
        _outcomes(after, metrics, keys).withColumn("side", F.lit("after")))
    by = [*keys, "metric", "side"]
    counts = _fold_replicates(both.groupBy(*by, "replicate").agg(
        F.count_if("success").alias("s"), F.count("success").alias("n"),
        F.count_if(F.col("success").isNull()).alias("x")), by)
    fields = ["successes", "n", "excluded", "replicates", "per_replicate"]

    def side(name: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.struct(*fields))).alias(name)

    paired = counts.groupBy(*keys, "metric").agg(side("before"), side("after"))
    b, a = F.col("before"), F.col("after")
    b_low, b_high = wilson(b["successes"], b["n"], z)
    a_low, a_high = wilson(a["successes"], a["n"], z)
    only_in = F.when(b.isNull(), "after").when(a.isNull(), "before")
    flips = F.split_part(F.col("metric"), F.lit(":"), F.lit(1)).isin(*vocab.FLIP_METRICS)
    flipped = F.coalesce(
        flips & (_majority(b["successes"], b["n"]) != _majority(a["successes"], a["n"])),
        F.lit(False))
    return paired.select(
        *keys, "metric", only_in.alias("only_in"), "before", "after",
        F.when(b.isNotNull(), b_low).alias("before_low"),
        F.when(b.isNotNull(), b_high).alias("before_high"),
        F.when(a.isNotNull(), a_low).alias("after_low"),
        F.when(a.isNotNull(), a_high).alias("after_high"),
        F.when(b.isNull(), "only in after").when(a.isNull(), "only in before").otherwise(
            power_verdict(b["replicates"], a["replicates"],
                          disjoint(b_low, b_high, a_low, a_high))).alias("verdict"),
        flipped.alias("flipped"))


def compare_means(before: DataFrame, after: DataFrame,
                  columns: Sequence[str] = vocab.CONTINUOUS_COLUMNS,
                  keys: Sequence[str] = vocab.CONDITION_FIELDS) -> DataFrame:
    """(cell, column, before, after): means of continuous columns, NULLs skipped."""
    def long(df: DataFrame, name: str) -> DataFrame:
        types = field_types(df)
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"),
                     (F.col(c) if c in types else F.lit(None)).cast("double").alias("value"))
            for c in columns])).alias("__c")
        return with_cell_keys(df, keys).select(*keys, F.lit(name).alias("side"), pairs).select(
            *keys, "side", "__c.column", "__c.value")

    both = long(before, "before").unionByName(long(after, "after"))
    return both.groupBy(*keys, "column").agg(
        F.avg(F.when(F.col("side") == "before", F.col("value"))).alias("before"),
        F.avg(F.when(F.col("side") == "after", F.col("value"))).alias("after"))


def in_cell_order(df: DataFrame, keys: Sequence[str] = vocab.CONDITION_FIELDS) -> DataFrame:
    """Missing first, then by string form (so 10 sorts before 9), key by key."""
    return df.orderBy(*[F.col(k).cast("string").asc_nulls_first() for k in keys])


def _count_text(side: Column, low: Column, high: Column) -> Column:
    pairs = F.transform(side["per_replicate"], lambda p: F.concat_ws(
        "/", p["successes"].cast("string"), p["n"].cast("string")))
    return F.concat(
        F.format_string("%d/%d [%.3f, %.3f]", side["successes"], side["n"], low, high),
        F.when(side["excluded"] > 0, F.format_string(" (%d excluded)", side["excluded"]))
        .otherwise(F.lit("")),
        F.when(side["replicates"] > 0, F.concat(
            F.format_string(" -- %d replicates: ", side["replicates"]), F.array_join(pairs, ", ")))
        .otherwise(F.lit("")))


def rendered(comparison: DataFrame, keys: Sequence[str] = vocab.CONDITION_FIELDS) -> DataFrame:
    """Cell, metric, verdict and both sides as text columns. Never an effect size or a p-value."""
    shown = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k))) for k in keys]
    cell = F.concat_ws(" ", *shown)
    return comparison.select(
        F.when(cell == "", "<no condition fields recorded>").otherwise(cell).alias("cell"),
        "metric",
        F.when(F.col("verdict") == "separates", "separates at this n")
        .otherwise(F.col("verdict")).alias("verdict"),
        "flipped",
        _count_text(F.col("before"), F.col("before_low"), F.col("before_high")).alias("before"),
        _count_text(F.col("after"), F.col("after_low"), F.col("after_high")).alias("after"))
