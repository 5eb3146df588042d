"""The ordering primitives against brute force, with the large-group path forced."""

import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import ranking
from auditspark.operators.ranking import dense_index, order_statistics, running_totals


def _rows(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(3000):
        data.append(("hot", 5.0 if rng.random() < 0.6 else rng.gauss(0, 10), i))
        if i < 700:
            data.append(("ties", float(rng.randint(0, 3)), i))
        if i < 40:
            data.append(("tiny", rng.random(), i))
    return data, spark.createDataFrame(data, "grp string, key double, tie bigint").repartition(7)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_order_statistics_equal_sorting(spark, limit):
    data, df = _rows(spark, limit)
    groups = {}
    for g, k, t in data:
        groups.setdefault(g, []).append((k, t))
    ranks = {g: sorted({1, 2, 3, len(v) // 3, len(v) // 2, len(v) // 2 + 1, len(v) // 2 + 9,
                        len(v) - 1, len(v)}) for g, v in groups.items()}
    sizes = {g: len(v) for g, v in groups.items()}
    cuts = order_statistics(df, ranks, sizes, small_group=limit)
    assert len(cuts) == sum(len(r) for r in ranks.values())
    for c in cuts:
        ordered = sorted(groups[c.group])
        assert ordered[c.rank - 1][0] == c.key
        reached = [p for p in ordered if p[0] < c.key or
                   (p[0] == c.key and (c.tie is None or p[1] <= c.tie))]
        assert len(reached) == c.rank


@pytest.mark.parametrize("seed", [1, 2])
def test_close_ranks_share_disjoint_intervals(spark, seed):
    """Neighbouring ranks whose pivots overlap, in several narrowing rounds."""
    rng = random.Random(seed)
    keys = sorted(rng.gauss(0, 1) for _ in range(4000))
    df = spark.createDataFrame([("g", k) for k in keys], "grp string, key double").repartition(5)
    ranks = [r for c in (700, 1990, 2000, 2010, 3900) for r in range(c, c + 25, 3)]
    cuts = order_statistics(df, {"g": ranks}, {"g": 4000}, with_tie=False, small_group=4)
    assert {c.rank: c.key for c in cuts} == {r: keys[r - 1] for r in ranks}


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_running_totals_equal_accumulation(spark, buckets, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_GROUP", 100)
    rng = random.Random(3)
    data = [(g, i * 7 % 997, rng.randint(0, 9)) for g in "ab" for i in range(500)]
    df = spark.createDataFrame(data, "g string, o bigint, v bigint").repartition(5)
    out = running_totals(df, "o", {"upto": F.col("v")}, ["g"], buckets=max(2, buckets)).collect()
    expected = {}
    for g in "ab":
        total = 0
        for _, o, v in sorted(d for d in data if d[0] == g):
            total += v
            expected[(g, o)] = total
    assert {(r.g, r.o): r.upto for r in out} == expected
    whole = running_totals(df.filter("g = 'a'"), "o", {"upto": F.col("v")}, buckets=8).collect()
    assert {("a", r.o): r.upto for r in whole} == {k: v for k, v in expected.items()
                                                   if k[0] == "a"}


def test_dense_index_follows_order_and_is_dense(spark):
    df = spark.range(1000).withColumn("x", F.hash("id")).repartition(6)
    out = dense_index(df, ["x", "id"]).collect()
    assert [r.row_id for r in sorted(out, key=lambda r: (r.x, r.id))] == list(range(1000))
    unordered = dense_index(df).collect()
    assert sorted(r.row_id for r in unordered) == list(range(1000))
