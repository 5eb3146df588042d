import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from auditspark.operators import forest, models


def _table(spark, X, y):
    rows = [([float(a) for a in r], float(v)) for r, v in zip(X, y, strict=True)]
    return spark.createDataFrame(rows, "x array<double>, y double").select(
        models.array_to_vector("x").alias("features"), "y")


def _noisy(n, seed=5):
    rng = np.random.default_rng(seed)
    X = np.c_[rng.normal(size=n), rng.normal(size=n) * 100, rng.integers(0, 4, n)]
    return X, (X[:, 0] + (X[:, 2] > 1) + rng.normal(size=n) * 0.5 > 0.5).astype(float)


def _scores(model, probe):
    return np.array([r.p for r in model.predict(probe.withColumn("at", F.monotonically_increasing_id())).orderBy(
        "at").select(F.col("score").alias("p")).collect()])


def _auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def test_a_long_table_is_grown_without_rounds_of_spark_ml(spark, monkeypatch):
    X, y = _noisy(1500)
    inside, outside = _table(spark, X[:1000], y[:1000]), _table(spark, X[1000:], y[1000:])

    def recipe(facts, seed):
        return RandomForestClassifier(numTrees=40, seed=3, maxDepth=30, maxBins=255, featureSubsetStrategy="sqrt")

    whole = _scores(models.fit_model(recipe, inside, "binary", []), outside)
    monkeypatch.setattr(models, "GROWN_ABOVE", 500)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("rounds over all rows"))
    model = models.fit_model(recipe, inside, "binary", [])
    score = _scores(model, outside)
    assert abs(_auc(score, y[1000:]) - _auc(whole, y[1000:])) < 0.02
    assert np.corrcoef(score, whole)[0, 1] > 0.95
    monkeypatch.setattr(forest, "GROUP_ROWS", 200)  # nodes above are divided by counts over all rows
    tops = models.fit_model(recipe, inside, "binary", [])
    assert max(len(f) for f, _, _ in tops.fitted.fitted.tops) > 3
    assert np.corrcoef(_scores(tops, outside), whole)[0, 1] > 0.95
    again = models.fit_model(recipe, inside.repartition(7), "binary", [])
    assert np.array_equal(_scores(again, outside), _scores(tops, outside))


def test_tops_by_counts_change_no_tree(spark, monkeypatch):
    """With every feature looked at by every node a tree is fixed by its draws."""
    rng = np.random.default_rng(2)
    X = rng.integers(0, 200, (4000, 3))
    for classes, y in ((2, rng.random(4000) < 0.2 + 0.6 * (X[:, 0] > 90) * (X[:, 1] < 120)),
                       (3, (X[:, 0] // 70 + rng.integers(0, 2, 4000)) % 3), (0, X[:, 0] * 0.5 + rng.normal(size=4000))):
        rows = _table(spark, X, y).withColumnRenamed("y", "label")
        recipe = forest.Recipe(7, 3, 4, 11, classes)
        found = []
        for most in (10_000, 900):
            monkeypatch.setattr(forest, "GROUP_ROWS", most)
            model = forest.grow_forest(rows, recipe, 200, spark)
            out = model.transform(rows.select("features").distinct())
            kept = F.col("prediction") if classes == 0 else models.vector_to_array("probability")
            found.append({tuple(r.f): r.p for r in out.select(
                models.vector_to_array("features").alias("f"), kept.alias("p")).collect()})
        assert found[0].keys() == found[1].keys() == {tuple(map(float, r)) for r in X}
        alike = [np.allclose(found[0][k], found[1][k]) for k in found[0]]
        assert np.mean(alike) > 0.99  # nodes of a few rows may have equal gains, of which the draw picks one
        assert len({str(v) for v in found[0].values()}) > 7


def _by_hand(x, y, w, depth):
    total, sums = w.sum(), (w * y).sum()
    best = (0.0, None, None)
    if depth and y.min() < y.max():
        for j in range(x.shape[1]):
            for b in range(int(x[:, j].max())):
                left = x[:, j] <= b
                inside = w[left].sum()
                if 0 < inside < total:
                    d = (w * y)[left].sum() * total - sums * inside
                    best = max(best, (d * d / (total * inside * (total - inside)), -j, -b), key=lambda c: c[0])
    if best[1] is None:
        return sums / total
    left = x[:, -best[1]] <= -best[2]
    a, b = _by_hand(x[left], y[left], w[left], depth - 1), _by_hand(x[~left], y[~left], w[~left], depth - 1)
    if not isinstance(a, tuple) and not isinstance(b, tuple) and (a > 0.5) == (b > 0.5):
        return sums / total
    return (-best[1], -best[2], a, b)


def _fall(tree, row):
    while isinstance(tree, tuple):
        j, b, left, right = tree
        tree = left if row[j] <= b else right
    return tree


def test_grown_trees_equal_trees_by_hand():
    rng = np.random.default_rng(4)
    for depth in (1, 3, 5):
        x = rng.integers(0, 250, (900, 4)).astype(np.uint16)
        y = (rng.random(900) < 0.2 + 0.6 * (x[:, 1] > 100)).astype(np.uint16)
        w = rng.integers(1, 4, 900)
        tree = forest.grown(x, y, w, forest.Recipe(1, 4, depth, 0, 2), depth, np.random.default_rng(0))
        mine = tree[3][forest.walked(x, *tree[:3]), 0]
        hand = _by_hand(x.astype(int), y.astype(float), w.astype(float), depth)
        assert np.allclose(mine, [_fall(hand, r) for r in x.astype(int)])


def test_equal_rows_are_drawn_as_often_as_apart():
    h = np.random.default_rng(0).integers(-2**63, 2**63, 100_000)
    for n in (1, 3, forest.DRAWN_AT_ONCE):
        w = forest.drawn(h, np.full(len(h), n), 4, 42)
        assert abs(w.mean() - n) < 0.03 * n and abs(w.var() - n) < 0.03 * n
        assert abs((w == 0).mean() - np.exp(-n)) < 0.005
    assert abs(np.corrcoef(forest.drawn(h, np.ones(len(h), int), 1, 42),
                           forest.drawn(h, np.ones(len(h), int), 2, 42))[0, 1]) < 0.02


def test_a_copied_row_counts_as_often_as_it_stands(spark):
    """A few rows, each many times: more copies than one draw stands for."""
    cells = [((0.0, 0.0), 0.0, 300), ((0.0, 0.0), 1.0, 100), ((1.0, 0.0), 1.0, 256), ((1.0, 0.0), 0.0, 65)]
    rows = spark.createDataFrame([([*x], y) for x, y, n in cells for _ in range(n)], "x array<double>, label double")
    model = forest.grow_forest(rows.select(models.array_to_vector("x").alias("features"), "label"),
                               forest.Recipe(60, 2, 30, 1, 2), 2, spark)
    out = model.transform(rows.distinct().select(models.array_to_vector("x").alias("features")).distinct())
    got = {r.features[0]: r.probability[1] for r in out.collect()}
    assert abs(got[0.0] - 100 / 400) < 0.02 and abs(got[1.0] - 256 / 321) < 0.02
    assert {r.features[0]: r.prediction for r in out.collect()} == {0.0: 0.0, 1.0: 1.0}


def test_a_number_is_grown_too(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(1200, 2))
    rows = _table(spark, X, 3 * X[:, 0] + rng.normal(size=1200) * 0.1)
    monkeypatch.setattr(models, "GROWN_ABOVE", 500)
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda *a: pytest.fail("rounds over all rows"))
    model = models.fit_model(lambda f, s: RandomForestRegressor(
        numTrees=30, seed=3, maxDepth=30, maxBins=255, featureSubsetStrategy="sqrt"), rows, "regression", [])
    out = model.predict(rows).select("y", "prediction").collect()
    y, p = (np.array([r[k] for r in out]) for k in (0, 1))
    assert len(out) == 1200 and 1 - ((y - p) ** 2).mean() / y.var() > 0.97


def test_columns_of_one_value_and_seeds_below_zero(spark, monkeypatch):
    X, y = _noisy(600)
    rows = _table(spark, np.c_[np.full(600, 7.5), X[:, 2], np.full(600, -1.0)], y)
    monkeypatch.setattr(models, "GROWN_ABOVE", 500)

    def recipe(facts, seed):
        return RandomForestClassifier(numTrees=20, seed=-3, maxBins=255, featureSubsetStrategy="sqrt")

    monkeypatch.setattr(forest, "SCORED_ROWS", 2)
    score = _scores(models.fit_model(recipe, rows, "binary", []), rows)
    assert len(score) == 600 and _auc(score, y) > 0.6
    alone = _table(spark, np.full((600, 1), 3.0), y)
    for most in (10_000, 5):
        monkeypatch.setattr(forest, "GROUP_ROWS", most)
        assert abs(_scores(models.fit_model(recipe, alone, "binary", []), alone) - y.mean()).max() < 0.03
