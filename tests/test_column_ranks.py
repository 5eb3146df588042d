"""Ranks of a table's columns by counts alone."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import profile
from auditspark.operators.ranking import column_statistics


@pytest.mark.parametrize("cells", [None, 70])
def test_column_ranks_equal_sorting(spark, cells):
    rng = random.Random(5)
    n = 3000
    columns = {
        "even": [float(i) for i in range(n)],
        "skewed": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(n)],
        "endless": [rng.choice([-math.inf, math.inf, 0.0, -0.0, rng.random()]) for _ in range(n)],
        "crowded": [1e9 if i == 0 else rng.choice([3.0, 3.0 + 1e-9 * rng.randrange(50)]) for i in range(n)],
        "gaps": [None if rng.random() < 0.4 else float(rng.randrange(40)) for _ in range(n)],
        "same": [7.0] * n, "none": [None] * n}
    ties = rng.sample(range(-2 ** 62, 2 ** 62, 2 ** 40 + 7), n)
    names = list(columns)
    df = spark.createDataFrame([(t, *row) for t, *row in zip(ties, *columns.values(), strict=True)],
                               "tie bigint, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    sorted_ = {c: sorted((v, t) for v, t in zip(columns[c], ties, strict=True) if v is not None) for c in names}
    ranks = {c: sorted({1 + b * (len(s) - 1) // 10 for b in range(11)}) if s else [] for c, s in sorted_.items()}
    cuts = column_statistics(df, {c: F.col(c) for c in names}, ranks, F.col("tie"), cells)
    assert len(cuts) == sum(map(len, ranks.values()))
    for cut in cuts:
        key, tie = sorted_[cut.group][cut.rank - 1]
        assert cut.key == key
        assert sum(v < key or (v == key and (cut.tie is None or t <= cut.tie))
                   for v, t in sorted_[cut.group]) == cut.rank


def test_cuts_of_long_columns_join_nothing_and_read_the_table_few_times(spark):
    rows = spark.range(60_000).select(F.col("id").alias("row_id"), *[
        (F.col("id") * 7919 % m).cast("double").alias(f"c{m}") for m in (59_999, 30_011, 997, 50)])
    spark.sparkContext.setJobGroup("cuts", "cuts")
    try:
        cuts = profile.bin_cuts(rows, rows.columns[1:], "row_id", 1000)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(c) for c in cuts.values()] == [9] * 4
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cuts")) <= 20
