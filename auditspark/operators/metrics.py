"""Scores in natural units, as exact aggregates over a table of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.functions import vocab
from auditspark.functions.exprs import signed
from auditspark.operators.ranking import range_splits, running_totals

#: Probabilities are clipped this far from 0 and 1 before their logarithm is taken.
EPS = 2.220446049250313e-16


def roc_auc(df: DataFrame, label: str, score: str, group: Sequence[str] = (),
            buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group; tied scores count half.

    Rows collapse to one count per distinct score first (map-side), then negatives are accumulated
    along the score in value ranges, so neither a score shared by most rows nor millions of
    distinct scores land in one task. NULL when a side is empty.
    """
    group = list(group)
    y = F.col(label).cast("bigint")
    usable = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    per_score = usable.groupBy(*group, F.col(score).cast("double").alias("__score")).agg(
        F.sum(y).alias("__pos"), F.sum(1 - y).alias("__neg"))
    # ranges of distinct scores, which are what is walked: a score of most rows counts once
    splits = range_splits(per_score, "__score", buckets)
    walked = running_totals(
        per_score, "__score", {"__neg_upto": F.col("__neg")}, group, splits=splits)
    pos, neg = F.col("__pos"), F.col("__neg")
    wins = F.sum(pos * (F.col("__neg_upto") - neg) + 0.5 * pos * neg)
    total = F.sum(pos).cast("double") * F.sum(neg)
    value = F.when(total > 0, wins / total).alias("value")
    return walked.groupBy(*group).agg(value) if group else walked.agg(value)


def _plain(metric: str, label: str, prediction: str, score: str) -> Column:
    """Metrics that need one pass only, as an aggregate expression."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    s = F.col(score).cast("double")
    if metric == "accuracy":
        return F.avg((F.col(label).cast("string") == F.col(prediction).cast("string")).cast(
            "double"))
    if metric == "f1":
        tp, wrong = F.sum(y * p), F.sum(F.abs(y - p))
        return F.when(2 * tp + wrong > 0, 2 * tp / (2 * tp + wrong)).otherwise(F.lit(0.0))
    if metric == "log_loss":
        q = F.least(F.greatest(s, F.lit(EPS)), F.lit(1 - EPS))
        return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))
    if metric == "rmse":
        return F.sqrt(F.avg((y - p) * (y - p)))
    if metric == "mae":
        return F.avg(F.abs(y - p))
    if metric == "r2":
        # var_pop * n is the centred sum of squares without a second pass.
        spread = F.var_pop(y) * F.count(y)
        residual = F.sum((y - p) * (y - p))
        return F.when(spread > 0, 1 - residual / spread).otherwise(
            F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    raise ValueError(f"unknown metric {metric!r}; expected one of "
                     f"{tuple(vocab.GREATER_IS_BETTER)}")


def score(df: DataFrame, metric: str, *, label: str = "y", prediction: str = "prediction",
          probability: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """(group..., value) of one metric, in its own units and direction."""
    if metric == "roc_auc":
        return roc_auc(df, label, probability, group)
    value = _plain(metric, label, prediction, probability).alias("value")
    return df.groupBy(*group).agg(value) if group else df.agg(value)


# ---------------------------------------------------------------- multiclass


def macro_f1(df: DataFrame, label: str = "y", prediction: str = "prediction",
             group: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of per-class F1 over labels that occur as truth or prediction."""
    group = list(group)
    counts = df.groupBy(*group, F.col(label).cast("string").alias("t"),
                        F.col(prediction).cast("string").alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(*group, "n", F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.lit(True).alias("truth")),
        F.struct(F.col("p").alias("c"), F.lit(False).alias("truth")))).alias("s"),
        (F.col("t") == F.col("p")).alias("hit"))
    per_class = sides.groupBy(*group, "s.c").agg(
        F.sum(F.when(F.col("s.truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("both"))
    value = F.avg(2 * F.col("tp") / F.col("both")).alias("value")
    return per_class.groupBy(*group).agg(value) if group else per_class.agg(value)


def auc_ovr(df: DataFrame, label: str, scores: str, classes: Sequence[str]) -> DataFrame:
    """Mean one-vs-rest AUC; ``scores`` is an array with one score per class in that order."""
    rows = df.select(F.posexplode(F.col(scores)).alias("at", "score"), F.col(label).alias("t"))
    names = F.array(*[F.lit(c) for c in classes])
    binary = rows.select(
        "at", "score", (F.col("t") == F.get(names, F.col("at"))).cast("int").alias("y"))
    per_class = roc_auc(binary, "y", "score", ["at"])
    return per_class.agg(F.avg("value").alias("value"))


def multiclass_log_loss(df: DataFrame, label: str, scores: str,
                        classes: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    p = F.get(F.col(scores), F.array_position(names, F.col(label)).cast("int") - 1)
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return df.agg((-F.avg(F.log(q))).alias("value"))


# ---------------------------------------------------------------- choosing a candidate


def best_candidate(candidates: DataFrame, metric: str, group: Sequence[str] = ()) -> DataFrame:
    """Best by ``cv_mean`` in the metric's direction; the first by ``position`` wins a tie."""
    sign = 1.0 if vocab.GREATER_IS_BETTER[metric] else -1.0
    ranked = candidates.filter(F.col("cv_mean").isNotNull())
    # min_by over a struct: smallest negated score, then earliest position.
    key = F.struct((-F.lit(sign) * F.col("cv_mean")).alias("k"), F.col("position").alias("p"))
    best = F.min_by("name", key).alias("best")
    return ranked.groupBy(*group).agg(best) if group else ranked.agg(best)


def resolve_choice(candidates: DataFrame, choices: DataFrame, metric: str) -> DataFrame:
    """(run_id, chosen, note): a chosen name must be a scored candidate, else the best by CV."""
    scored = candidates.filter(F.col("cv_mean").isNotNull())
    best = best_candidate(candidates, metric, ["run_id"])
    runs = candidates.select("run_id").distinct()
    valid = choices.join(scored.select("run_id", F.col("name").alias("choice")),
                         ["run_id", "choice"], "left_semi").select(
        "run_id", F.col("choice").alias("valid"))
    return (
        runs.join(choices, "run_id", "left").join(valid, "run_id", "left")
        .join(best, "run_id", "left")
        .select("run_id", F.coalesce("valid", "best").alias("chosen"),
                F.when(F.col("best").isNull(), "no candidate was scored")
                .when(F.col("valid").isNull() & F.col("choice").isNotNull(),
                      "choice is not a scored candidate")
                .when(F.col("valid").isNull(), "no choice given").alias("note")))


# ---------------------------------------------------------------- importance shape


def top_importances(importances: DataFrame, group: Sequence[str] = (),
                    k: int = vocab.TOP_IMPORTANCES) -> DataFrame:
    """The ``k`` largest means per group with their 1-based rank, ties in column order."""
    order = Window.partitionBy(*group).orderBy(F.col("mean").desc(), "column")
    return importances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def importance_shape(top: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of the first column in the positive mass, and columns needed for 80 % of it.

    ``top`` holds at most 15 ranked columns per group.
    """
    positive = F.when(F.col("mean") > 0, F.col("mean"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = top.select("*", F.sum(positive).over(whole).alias("__mass"),
                        F.sum(positive).over(upto).alias("__upto"))
    reached = F.min(F.when(
        F.col("__upto") >= F.lit(vocab.IMPORTANCE_MASS) * F.col("__mass"), F.col("rank")))
    n_positive = F.count_if(F.col("mean") > 0)
    aggregates = [
        F.when(n_positive > 0, F.max(F.when(F.col("rank") == 1, F.col("mean")))
               / F.max("__mass")).alias("top_importance_share"),
        F.when(n_positive > 0, F.coalesce(reached, n_positive)).cast("bigint").alias(
            "top_importance_n80"),
        F.when(F.count("*") == 0, "no_importances")
        .when(n_positive == 0, "no_positive_importance").otherwise("ok").alias(
            "top_importance_status")]
    return walked.groupBy(*group).agg(*aggregates) if group else walked.agg(*aggregates)


def importance_shape_of(array: Column) -> tuple[Column, Column, Column]:
    """The same three figures from an array<struct<column, mean>> sorted by mean descending."""
    means = F.transform(array, lambda s: s["mean"])
    positive = F.filter(means, lambda m: m > 0)
    zero = F.lit(0.0)
    mass = F.aggregate(positive, zero, lambda a, m: a + m)
    # Running sum carried beside the first position that reaches the threshold.
    start = F.struct(zero.alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, m: Column) -> Column:
        total = acc["sum"] + m
        return F.struct(
            total.alias("sum"),
            F.when(acc["done"], acc["n"]).otherwise(acc["n"] + 1).alias("n"),
            (acc["done"] | (total >= F.lit(vocab.IMPORTANCE_MASS) * mass)).alias("done"))

    n80 = F.aggregate(positive, start, step, lambda acc: acc["n"])
    empty = array.isNull() | (F.size(array) == 0)
    status = (F.when(empty, "no_importances").when(F.size(positive) == 0, "no_positive_importance")
              .otherwise("ok"))
    ok = ~empty & (F.size(positive) > 0)
    return (F.when(ok, F.element_at(means, 1) / mass), F.when(ok, n80.cast("bigint")), status)


# ---------------------------------------------------------------- the yardstick


def zero_point(train: DataFrame, scored: DataFrame, task: str, y: str = "y") -> DataFrame:
    """``scored`` with the constant prediction of a class prior (or mean) fitted on ``train``."""
    if task == "binary":
        prior = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
        return scored.withColumn("score", F.lit(prior)).withColumn(
            "prediction", F.lit(1 if prior > 0.5 else 0))
    if task == "regression":
        mean = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
        return scored.withColumn("score", F.lit(mean)).withColumn("prediction", F.lit(mean))
    counts = train.groupBy(F.col(y).cast("string").alias("c")).agg(F.count("*").alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "c"))["c"]).first()[0]
    return scored.withColumn("prediction", F.lit(top)).withColumn("score", F.lit(None).cast(
        T.DoubleType()))


def separation(zero: Column, unit: Column, metric: Column) -> Column:
    """Length of the scale from the constant predictor to the forest, positive when it helps."""
    return (unit - zero) * signed(metric)


def normalised(verified: Column, zero: Column, unit: Column, metric: Column,
               planted: Column) -> Column:
    """Position on that scale; NULL on a planted leak or a scale without length."""
    span = separation(zero, unit, metric)
    return F.when(~planted & (span > F.lit(vocab.MIN_SEPARATION)),
                  (verified - zero) * signed(metric) / span)


def claim_gap(claimed: Column, verified: Column, metric: Column) -> Column:
    """Positive: the claim overstates the score, whichever way the metric runs."""
    return (claimed - verified) * signed(metric)
