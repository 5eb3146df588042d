import math
import random
import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from auditspark.operators import metrics as M
from auditspark.operators import ranking
from auditspark.operators import transform as X
from auditspark.operators.profile import column_profile


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["u", "v", None]), f"name{i}", None if i % 7 == 0 else rng.gauss(3, 2),
             i % 2 == 0, str(rng.randint(1, 9)) if i % 3 else "bad", i % 2) for i in range(400)]
    return rows, spark.createDataFrame(
        rows, "row_id bigint, c string, wide string, x double, b boolean, t string, y int")


def test_fit_and_apply(spark, train):
    rows, df = train
    fit = X.fit_transform(df, "y", small_group=50)
    assert fit.skipped == ["wide"] and fit.numeric == ["x", "b"]
    assert fit.medians["x"] == pytest.approx(statistics.median(r[3] for r in rows if r[3]))
    assert fit.levels["c"] == ["u", "v"] and "c=u" in fit.feature_order
    matrix = fit.transform(df, ["row_id"])
    assert matrix.columns == ["row_id", *fit.feature_order]
    X.check_matrix(matrix, fit.feature_order)
    unseen = spark.createDataFrame([(1, "zzz", None)], "row_id bigint, c string, x double")
    row = fit.transform(unseen, ["row_id"]).first()
    assert row["c=u"] == row["c=v"] == 0.0
    assert row["x"] == fit.medians["x"] and row["b"] == fit.medians["b"]


def test_all_missing_column_fills_zero(spark):
    df = spark.createDataFrame([(1, None), (0, None)], "y int, e double")
    fit = X.fit_transform(df.withColumn("row_id", F.lit(1)), "y")
    assert fit.medians == {"e": 0.0}


def test_ordinal_codes_unseen_and_missing(spark, train):
    _, df = train
    fit = X.fit_ordinal(df.select("row_id", "c", "x", "y"), "y")
    codes = {r.level: r.code for r in fit.codes.collect()}
    assert codes == {"__missing__": 0, "u": 1, "v": 2}
    new = spark.createDataFrame([("u", 1.0), ("q", None), (None, 2.0)], "c string, x double")
    got = [tuple(r) for r in fit.transform(new).collect()]
    assert sorted(got) == sorted([(1.0, 1.0), (fit.medians["x"], -1.0), (2.0, 0.0)])
    OrdinalFit = X.OrdinalFit(fit.medians, fit.categorical, fit.codes, {"c": 10**9})
    assert sorted(tuple(r) for r in OrdinalFit.transform(new).collect()) == sorted(got)


def test_scaling_uses_population_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    assert [tuple(r) for r in X.fit_scaling(df, ["a", "k"]).transform(df).collect()] == [
        (-1.0, 0.0), (1.0, 0.0)]


def test_drops(spark, train):
    _, df = train
    profile = column_profile(df.drop("row_id"))
    binding = spark.createDataFrame([("x",), ("wide",), ("x",)], "column string")
    forced = {r["column"]: r.reason for r in X.forced_drops(profile, "y", binding).collect()}
    assert forced == {"y": "target", "wide": "identifier", "x": "leakage"}
    proposed = spark.createDataFrame([("x",), ("c",), ("ghost",)], "column string")
    kept = spark.createDataFrame([("b",), ("c",)], "column string")
    merged = {r["column"]: r.decision for r in X.merge_drops(
        profile, X.forced_drops(profile, "y", binding), proposed, kept).collect()}
    assert merged == {"y": "forced", "wide": "forced", "x": "forced", "c": "proposed", "b": "kept"}


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), 0.5 if rng.random() < 0.4 else rng.random()) for _ in
            range(2500)]
    return rows, spark.createDataFrame(rows, "y int, score double").repartition(5)


def test_auc_with_heavy_ties(predictions, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_GROUP", 100)
    rows, df = predictions
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for buckets in (2, 37):
        assert M.roc_auc(df, "y", "score", buckets=buckets).first().value == pytest.approx(brute)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="y", numBins=0)
    assert evaluator.evaluate(df.withColumn("y", F.col("y").cast("double"))) == pytest.approx(brute)
    assert M.roc_auc(df.filter("y = 1"), "y", "score").first().value is None


def test_other_metrics(spark, predictions):
    rows, df = predictions
    p = df.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    n = len(rows)
    value = lambda m: M.score(p, m).first().value
    assert value("accuracy") == pytest.approx(sum(y == (s > 0.5) for y, s in rows) / n)
    assert value("log_loss") == pytest.approx(
        -sum(math.log(s if y else 1 - s) for y, s in rows) / n)
    tp = sum(y and s > 0.5 for y, s in rows)
    assert value("f1") == pytest.approx(2 * tp / (2 * tp + sum(y != (s > 0.5) for y, s in rows)))
    r = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, prediction double")
    r = r.withColumn("score", F.lit(0.0))
    assert M.score(r, "rmse").first().value == pytest.approx(math.sqrt(2 / 3))
    assert M.score(r, "mae").first().value == pytest.approx(2 / 3)
    assert M.score(r, "r2").first().value == pytest.approx(1 - 2 / (14 / 3))
    with pytest.raises(ValueError):
        M.score(r, "nope")


def test_multiclass(spark):
    df = spark.createDataFrame(
        [("a", "a", [0.8, 0.1, 0.1]), ("b", "a", [0.5, 0.4, 0.1]), ("c", "c", [0.1, 0.1, 0.8]),
         ("b", "b", [0.2, 0.7, 0.1])], "y string, prediction string, scores array<double>")
    assert M.macro_f1(df).first().value == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)
    assert M.auc_ovr(df, "y", "scores", ["a", "b", "c"]).first().value == pytest.approx(1.0)


def test_importance_shape(spark):
    df = spark.createDataFrame(
        [("a", 0.5), ("b", 0.3), ("c", 0.1), ("d", 0.1), ("e", -0.2)], "column string, mean double")
    row = M.importance_shape(M.top_importances(df)).first()
    assert (row.top_importance_share, row.top_importance_n80) == (0.5, 2)
    flat = spark.createDataFrame([("a", -0.1), ("b", 0.0)], "column string, mean double")
    assert M.importance_shape(M.top_importances(flat)).first()[2] == "no_positive_importance"
    assert M.importance_shape(M.top_importances(df.limit(0))).first()[2] == "no_importances"
    arr = df.groupBy().agg(F.collect_list(F.struct("column", "mean")).alias("a")).select(
        F.expr("sort_array(a, false)").alias("a"))
    arr = arr.select(F.expr(
        "array_sort(a, (l, r) -> case when l.mean > r.mean then -1 else 1 end)").alias("a"))
    assert tuple(arr.select(*M.importance_shape_of(F.col("a"))).first()) == (0.5, 2, "ok")


def test_gap_sign_and_scale(spark):
    df = spark.createDataFrame(
        [("roc_auc", 0.9, 0.8, 0.5, 0.9), ("rmse", 0.3, 0.4, 1.0, 0.5), ("r2", 0.5, 0.5, 0.5, 0.5)],
        "metric string, claimed double, verified double, zero double, unit double")
    c = F.col
    out = df.select(
        M.claim_gap(c("claimed"), c("verified"), c("metric")).alias("gap"),
        M.separation(c("zero"), c("unit"), c("metric")).alias("sep"),
        M.normalised(c("verified"), c("zero"), c("unit"), c("metric"), F.lit(False)).alias("norm"),
    ).collect()
    assert out[0].gap == pytest.approx(0.1) and out[1].gap == pytest.approx(0.1)
    assert out[0].norm == pytest.approx(0.75) and out[1].norm == pytest.approx(1.2)
    assert out[2].sep == 0 and out[2].norm is None
    assert df.select(M.normalised(c("verified"), c("zero"), c("unit"), c("metric"),
                                  F.lit(True)).alias("n")).first().n is None


def test_choice(spark):
    cand = spark.createDataFrame(
        [("r1", "a", 0.3, 0), ("r1", "b", 0.3, 1), ("r2", "a", None, 0), ("r3", "a", 0.2, 0),
         ("r3", "b", 0.1, 1)], "run_id string, name string, cv_mean double, position int")
    choice = spark.createDataFrame([("r1", "b"), ("r3", "ghost")], "run_id string, choice string")
    got = {r.run_id: (r.chosen, r.note) for r in M.resolve_choice(cand, choice, "rmse").collect()}
    assert got["r1"] == ("b", None)
    assert got["r2"] == (None, "no candidate was scored")
    assert got["r3"] == ("b", "choice is not a scored candidate")
    assert M.best_candidate(cand, "roc_auc", ["run_id"]).filter("run_id = 'r1'").first().best == "a"
