"""Profile and association against independent computations."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditspark.operators import profile as P


def _bins(values):
    present = sorted((v, i) for i, v in enumerate(values) if v is not None)
    m = len(present)
    out = ["<MISSING>"] * len(values)
    for r, (_, i) in enumerate(present, start=1):
        out[i] = str(max(0, ((r - 1) * 10 + (m - 2)) // (m - 1) - 1))
    return out


def _nmi(a, b):
    n = len(a)
    pa, pb, pab = Counter(a), Counter(b), Counter(zip(a, b, strict=True))
    mi = sum(c / n * math.log(c * n / (pa[x] * pb[y])) for (x, y), c in pab.items())
    h = [-sum(c / n * math.log(c / n) for c in p.values()) for p in (pa, pb)]
    return 1.0 if h == [0, 0] else 0.0 if mi <= 2.3e-16 else round(mi / (sum(h) / 2), 4)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        y = rng.random() < 0.3
        rows.append((
            i, int(y), rng.choice("abc"), None if rng.random() < 0.1 else rng.gauss(y, 1),
            rng.randint(0, 20) // 2 if rng.random() < 0.5 else 4, rng.random() < 0.5, f"id{i}",
            float("nan") if i % 50 == 0 else float(i % 3)))
    schema = "row_id bigint, y int, c string, x double, k int, b boolean, ident string, f double"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("limit", [None, 100])
def test_association_matches_direct_counting(table, limit):
    rows, df = table
    got = {r["column"]: r.nmi for r in P.association(df, "y", small_group=limit).collect()}
    y = [str(r[1]) for r in rows]
    assert got["c"] == _nmi(y, [r[2] for r in rows])
    assert got["x"] == pytest.approx(_nmi(y, _bins([r[3] for r in rows])), abs=1e-4)
    assert got["k"] == _nmi(y, [str(r[4]) for r in rows])  # 11 distinct values: not binned
    assert got["ident"] == _nmi(y, [r[6] for r in rows])
    assert got["f"] == _nmi(y, [str(r[7]) for r in rows])


def test_heavy_ties_are_split_by_row_order(spark):
    rng = random.Random(9)
    values = [7.0 if rng.random() < 0.4 else float(rng.randint(0, 30)) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, v double").repartition(4)
    for limit in (None, 50):
        got = {r.row_id: r.v for r in P.discretize(df, ["v"], small_group=limit).collect()}
        assert [got[i] for i in range(900)] == _bins(values)


def test_profile_counts(table):
    rows, df = table
    got = {r["column"]: r for r in P.column_profile(df).collect()}
    assert got["x"].n_unique == len({r[3] for r in rows if r[3] is not None})
    assert got["x"].missing_fraction == pytest.approx(sum(r[3] is None for r in rows) / 1500)
    assert got["f"].n_unique == 3 and got["f"].missing_fraction == pytest.approx(30 / 1500)
    assert got["b"].dtype == "bool" and got["k"].dtype == "int64"
    approx = {r["column"]: r for r in P.column_profile(df, approx=0.02).collect()}
    assert approx["ident"].n_unique == pytest.approx(1500, rel=0.1)


def test_nullable_integer_reads_as_float(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert P.column_profile(df).first().dtype == "float64"


def test_classify_columns_and_positive(spark):
    df = spark.createDataFrame(
        [(i, f"u{i}", "ab"[i % 2], i % 2 == 0, None) for i in range(50)],
        "n int, u string, s string, b boolean, e string")
    kinds = P.classify_columns(df, "n")
    assert kinds == {"numeric": ["b", "e"], "categorical": ["s"], "skipped": ["u"]}
    assert P.classify_columns(df, "n", cap=None)["categorical"] == ["u", "s"]
    assert P.resolve_positive(df, "s", "zz").first().asDict() == {"used": "b", "mismatch": True}
    assert P.resolve_positive(df, "s", "a").first().asDict() == {"used": "a", "mismatch": False}


def test_guards_and_minority(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)] * 3 + [("",)], "y string")
    assert P.class_guard(df, "y").first().refused is None
    assert P.class_guard(df.filter("y = 'a'"), "y").first().refused == "fewer than two classes"
    assert P.class_guard(df.limit(10).filter("true"), "y", 50).first().refused is not None
    assert P.minority_class(df.filter("y <> ''"), "y").first().positive_rate == 0.25
    assert {r.label: r.share for r in P.target_balance(df, "y").collect()}["a"] == round(9 / 13, 4)
    wide = spark.range(30).select(F.col("id").cast("string").alias("y"))
    assert P.target_balance(wide, "y").count() == 30
    assert P.target_balance(wide, "y", max_classes=20).count() == 0
    assert P.measure_table(wide.crossJoin(spark.range(40)).select("y", "id"), "y").first().n_classes == 30
