import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from auditspark.operators import grading, inject, models
from auditspark.operators.grading import Task
from auditspark.operators.models import TrainingFacts
from auditspark.operators.runs import attach_grades
from auditspark.plans.audit import audit

QUICK = {"binary": {"logistic_l2": models._logistic,
                    "hist_gbdt": lambda f, s: GBTClassifier(maxIter=5, seed=s)}}
def FOREST():
    return RandomForestClassifier(numTrees=10, seed=1)


def _vectors(spark, X, y):
    rows = [(float(v), [float(a) for a in r]) for r, v in zip(X, y, strict=True)]
    df = spark.createDataFrame(rows, "label double, f array<double>")
    return df.select("label", models.array_to_vector("f").alias("features"))


def test_regularisation_matches_closed_forms(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3)) * [1, 5, 0.1] + 2
    Z = (X - X.mean(0)) / X.std(0)
    y = X @ [1.0, 0.3, 5.0] + rng.normal(size=200)
    w = np.linalg.solve(Z.T @ Z + np.eye(3), Z.T @ (y - y.mean()))
    fitted = models._ridge(TrainingFacts(200, float(y.std())), 0).fit(_vectors(spark, X, y))
    assert np.allclose(fitted.coefficients.toArray() * X.std(0), w, rtol=1e-6)

    t = (y > y.mean()).astype(float)
    beta, b = np.zeros(3), 0.0
    for _ in range(50):  # Newton on the penalised likelihood, C = 1
        p = 1 / (1 + np.exp(-(Z @ beta + b)))
        A = np.c_[Z, np.ones(200)]
        g = A.T @ (p - t) + np.r_[beta, 0]
        H = (A * (p * (1 - p))[:, None]).T @ A + np.diag([1, 1, 1, 0])
        step = np.linalg.solve(H, g)
        beta, b = beta - step[:3], b - step[3]
    fitted = models._logistic(TrainingFacts(200, 1.0), 0).fit(_vectors(spark, X, t))
    assert np.allclose(fitted.coefficients.toArray() * X.std(0), beta, atol=1e-4)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        s = rng.normal()
        y = int(s + rng.normal() * 0.7 > 0.3)
        rows.append((i, y, float(s), float(rng.normal()), "abc"[i % 3], f"id{i}"))
    return spark.createDataFrame(
        rows, "row_id bigint, y int, signal double, noise double, region string, ident string")


@pytest.fixture(scope="module")
def run(table):
    leaky = inject.noisy_copy(table, "y", "1", flip=0.05)
    return audit(leaky, Task("y"), specs=QUICK["binary"], forest=FOREST, repeats=3)


def test_audit_end_to_end(run):
    assert run.drops == ["ident"] and run.chosen in QUICK["binary"]
    assert all(e.fit_error is None and len(e.cv_scores) == 5 for e in run.candidates)
    assert run.grade.rescore_status == "ok" and run.grade.verified > 0.9
    assert abs(run.grade.refit_claim_gap) <= 1e-6
    assert run.grade.baseline_status == "ok" and run.grade.zero == 0.5
    assert run.grade.unit > 0.8
    ranked = [r["column"] for r in run.importances.orderBy(F.desc("mean")).collect()]
    assert ranked[0] == "status_code" and set(ranked) == {"status_code", "signal", "noise",
                                                           "region"}
    top = run.evidence().orderBy(F.desc("nmi")).limit(2).collect()
    assert "status_code" in {r["column"] for r in top}


def test_dropping_the_leak_lowers_the_score(table, run):
    leaky = inject.noisy_copy(table, "y", "1", flip=0.05)
    honest = audit(leaky, Task("y"), drops=("status_code",), specs={
        "logistic_l2": models._logistic}, forest=FOREST, importances=False)
    assert "status_code" in honest.drops
    assert honest.grade.verified < run.grade.verified


def test_failures_are_statuses(spark, table):
    def broken(facts, seed):
        raise RuntimeError("nope")

    bad = audit(table, Task("y"), specs={"broken": broken, "logistic_l2": models._logistic},
                forest=FOREST, importances=False)
    assert bad.candidates[0].fit_error == "RuntimeError: nope" and bad.chosen == "logistic_l2"
    none = audit(table, Task("y"), withheld_fraction=0, specs=QUICK["binary"], importances=False)
    assert none.grade.rescore_status == none.grade.baseline_status == "no_withheld_holdout"
    grade = grading.rescore(bad.prepared.agent, bad.prepared.withheld, bad.assignment, Task("y"),
                            bad.fit, "ghost", 0.5)
    assert grade.rescore_status == "unknown_model_spec"
    grade = grading.rescore(bad.prepared.agent, bad.prepared.withheld, bad.assignment, Task("y"),
                            bad.fit, "logistic_l2", 0.123)
    assert grade.rescore_status == "refit_mismatch" and grade.verified is not None
    one = bad.prepared.withheld.filter("y = 1")
    grade = grading.rescore(bad.prepared.agent, one, bad.assignment, Task("y"), bad.fit,
                            "logistic_l2", 0.5)
    assert grade.rescore_status == "single_class_holdout" and grade.verified is None
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    rows = {r.run_id: r.rescore_status for r in attach_grades(runs, grade.row(spark, "a")).collect()}
    assert rows == {"a": "single_class_holdout", "b": "not_attempted"}


def test_regression_and_multiclass(table):
    df = table.withColumn("target", F.round(
        F.col("signal") * 2 + F.col("noise") * 0.1, 1))
    out = audit(df.drop("y"), Task("target", "regression", "rmse"), drops=("ident",),
                specs={"ridge": models._ridge}, importances=True, repeats=2,
                forest=lambda: models.RandomForestRegressor(numTrees=5, seed=1))
    assert out.grade.rescore_status == "ok" and out.grade.verified < 0.25
    assert out.grade.zero > out.grade.unit
    multi = table.withColumn("cls", F.when(F.col("signal") > 0.5, "hi").when(
        F.col("signal") < -0.5, "lo").otherwise("mid")).drop("y")
    for metric, explain in (("roc_auc", True), ("f1", False), ("log_loss", True)):
        out = audit(multi, Task("cls", "multiclass", metric), drops=("ident",), repeats=2,
                    specs={"logistic_l2": models._logistic}, forest=FOREST, importances=explain)
        assert out.grade.rescore_status == "ok", out.grade
        assert out.grade.baseline_status == "ok", out.grade
        if explain:
            assert out.importances.orderBy(F.desc("mean")).first()["column"] == "signal"
    boosted = audit(multi, Task("cls", "multiclass"), drops=("ident",), importances=False, specs={
        "hist_gbdt": lambda f, s: models.OneVsRest(classifier=GBTClassifier(maxIter=3, seed=s))},
        forest=FOREST)
    assert boosted.grade.rescore_status == "ok" and boosted.grade.verified > 0.9


def test_ridge_from_part_sums_equals_fold_fits(spark, monkeypatch):
    """Far-off means, a constant column and one constant outside a single fold change nothing."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        part = "h" if i % 5 == 4 else str(i % 3)
        x = [float(rng.normal()), 1e6 + float(rng.normal()) * 0.5, 3.25, float(part == "0" and i % 2), float(i % 4)]
        rows.append((i, part, float(2 * x[0] - x[1] + 1e6 + x[4] + rng.normal()), x))
    features = spark.createDataFrame(rows, "row_id bigint, part string, y double, x array<double>").select(
        "row_id", "part", "y", models.array_to_vector("x").alias("features")).persist()
    spec = {"ridge": models._ridge}
    summed = models.cross_validate(features, "regression", "rmse", 3, spec)[0]
    assert summed.fit_error is None

    part, y, X = (np.array([r[k] for r in rows]) for k in (1, 2, 3))

    def by_hand(inside, outside):
        mean, std = X[inside].mean(0), X[inside].std(0)
        scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)
        Z = (X[inside] - mean) * scale
        w = np.linalg.solve(Z.T @ Z + np.eye(5), Z.T @ (y[inside] - y[inside].mean()))
        guess = y[inside].mean() + (X[outside] - mean) * scale @ w
        return np.sqrt(np.mean((y[outside] - guess) ** 2))

    train = part != "h"
    expected = [by_hand(train & (part != str(k)), part == str(k)) for k in range(3)]
    assert np.allclose(summed.cv_scores, expected, rtol=1e-9)
    assert np.isclose(summed.holdout_score, by_hand(train, ~train), rtol=1e-9)

    monkeypatch.setattr(models, "SUMMED_WIDTH", 0)  # the fits keep fewer digits of far-off means
    fitted = models.cross_validate(features, "regression", "rmse", 3, spec)[0]
    assert np.allclose(summed.cv_scores, fitted.cv_scores, rtol=1e-4)
    assert np.allclose(summed.model.fitted.coefficients.toArray(), fitted.model.fitted.coefficients.toArray())
    monkeypatch.setattr(models, "SUMMED_WIDTH", 64)
    monkeypatch.setattr(models, "_SUMS_PER_JOB", 4)  # several jobs give the same sums
    again = models.cross_validate(features, "regression", "rmse", 3, spec, keep_models=False)[0]
    assert np.allclose(again.cv_scores, summed.cv_scores) and again.model is None
    features.unpersist()


def test_equal_rows_are_boosted_as_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [([float(a), float(b)], float(rng.random() < 0.2 + 0.15 * a + 0.1 * b))
            for a, b in rng.integers(0, 3, (4000, 2))]
    df = spark.createDataFrame(rows, "x array<double>, y double").select(
        models.array_to_vector("x").alias("features"), "y")
    fitted_on = []
    plain = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: (
        fitted_on.append(data.count()), plain(self, data))[1])

    def boosted(facts, seed):
        return GBTClassifier(maxIter=8, seed=seed)

    model = models.fit_model(boosted, df, "binary", [])
    assert fitted_on == [len({(tuple(x), y) for x, y in rows})]
    whole = plain(boosted(None, 42), df.withColumnRenamed("y", "label"))
    probe = df.select("features").distinct()
    mine, expected = (sorted((r.features.toArray().tolist(), r.probability[1]) for r in m.transform(
        probe).collect()) for m in (model.fitted, whole))
    assert [f for f, _ in mine] == [f for f, _ in expected]
    assert np.allclose([p for _, p in mine], [p for _, p in expected], rtol=1e-9)


def test_a_forest_in_groups_is_one_forest(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 3))
    rows = _vectors(spark, X, (X[:, 0] + rng.normal(size=300) > 0).astype(float))
    for recipe, task in ((RandomForestClassifier(numTrees=60, seed=3, maxDepth=6), "binary"),
                         (models.RandomForestRegressor(numTrees=60, seed=3, maxDepth=6), "regression")):
        data = rows.withColumnRenamed("label", "y")
        forest = models.fit_model(lambda f, s, r=recipe: r, data, task, []).fitted
        assert [m.getNumTrees for m in forest.members] == [25, 25, 10]
        assert all(m.getOrDefault("cacheNodeIds") for m in forest.members)
        out = forest.transform(rows).collect()
        apart = [[r.probability[1] if task == "binary" else r.prediction for r in m.transform(rows).collect()]
                 for m in forest.members]
        want = np.average(apart, axis=0, weights=[25, 25, 10])
        assert np.allclose([r.probability[1] if task == "binary" else r.prediction for r in out], want)
        assert not np.allclose(apart[0], apart[1])
        if task == "binary":
            assert [r.prediction for r in out] == [float(p > 0.5) for p in want]
        again = models.fit_model(lambda f, s, r=recipe: r, data.orderBy("y"), task, []).fitted.transform(rows).collect()
        assert out == again
