"""Identifiers beyond 2^53, repeated and negative ones, and cells of ordinary CSV files."""

import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import profile, ranking, split
from auditspark.sources.fingerprint import table_fingerprint
from auditspark.sources.tables import read_table


@pytest.mark.parametrize("limit", [50, 100_000])
@pytest.mark.parametrize("base", [2**60, -(2**61), 0])
def test_ranks_of_large_ties_are_exact_on_both_routes(spark, limit, base):
    rows = spark.range(3000).select(
        F.lit("g").alias("grp"), F.lit(1.0).alias("key"), (F.col("id") + F.lit(base)).alias("tie"))
    cuts = ranking.order_statistics(rows, {"g": [100, 1500, 3000]}, {"g": 3000}, small_group=limit)
    for cut in cuts:
        reached = rows.where(cut.reached(F.col("key"), F.col("tie"))).count()
        assert reached == cut.rank


def test_ties_that_differ_in_the_high_half_only(spark):
    rows = spark.range(2000).select(
        F.lit("g").alias("grp"), (F.col("id") % 2).cast("double").alias("key"),
        (F.col("id") * F.lit(2**33) + F.lit(7)).alias("tie"))
    for cut in ranking.order_statistics(rows, {"g": [1, 700, 1999]}, {"g": 2000}, small_group=30):
        assert rows.where(cut.reached(F.col("key"), F.col("tie"))).count() == cut.rank


def test_repeated_assignment_is_an_error_and_negative_ids_have_a_digest(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "row_id long, v string")
    twice = spark.createDataFrame([(1, "h"), (1, "0"), (2, "0")], "row_id long, part string")
    with pytest.raises(Exception, match="more than once"):
        split.attach(rows, twice).collect()
    once = spark.createDataFrame([(1, "h"), (2, "0")], "row_id long, part string")
    assert split.attach(rows, once).count() == 3
    for gone in (1, 2, None):
        lacking = rows.unionByName(rows.select(F.lit(gone).cast("long").alias("row_id"), "v"))
        some = once.where(F.col("row_id") != F.lit(gone)) if gone else once
        with pytest.raises(Exception, match="without an assignment"):
            split.attach(lacking, some).where("part <> 'h'").collect()
    assert {r.part for r in split.attach(rows, once).where("part <> 'h'").collect()} == {"0"}


@pytest.mark.parametrize("small", [None, 40])
@pytest.mark.parametrize("base", [0, 2 ** 60, -2 ** 62, 2 ** 63 - 400])
def test_integers_bin_in_their_own_order_and_ties_by_row(spark, small, base):
    rng = random.Random(base + 1)
    values = [base + rng.randrange(390) for _ in range(300)] + [base + 7] * 200
    rows = list(enumerate(values)) + [(900, None)]
    df = spark.createDataFrame([(i, v, v) for i, v in rows], "row_id long, v long, d long").select(
        "row_id", "v", (F.col("d").cast("decimal(19,0)") / 100).cast("decimal(18,2)").alias("d") if abs(base) < 2 ** 59
        else F.col("d"))
    got = {r.row_id: (r.v, r.d) for r in profile.discretize(df, ["v", "d"], small_group=small).collect()}
    m = len(values)
    want = {900: "<MISSING>"}
    for rank, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1):
        want[i] = str(max(((rank - 1) * 10 + m - 2) // (m - 1) - 1, 0))
    assert {i: g[0] for i, g in got.items()} == want and {i: g[1] for i, g in got.items()} == want


def test_csv_without_line_ends_in_fields_is_split_and_dealt(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,text\n" + "".join(f'{i},"a ""b"" {i}"\n' for i in range(500)))
    got = read_table(spark, str(tmp_path / "t.csv"), multi_line=False, partitions=3)
    assert got.rdd.getNumPartitions() == 3
    assert got.agg(F.sum("id")).first()[0] == 500 * 499 // 2 and got.where("text = 'a \"b\" 7'").count() == 1
    negative = spark.createDataFrame([(-1, "h"), (0, "0"), (1, "1")], "row_id long, part string")
    assert len(split.assignment_digest(negative)) == 64


def test_csv_quotes_line_ends_and_long_integers(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'id,text\n1234567890123456789,"he said ""hi"", ok"\n1234567890123456790,"two\nlines"\n')
    got = read_table(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes)["id"] == "bigint"
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1234567890123456789, 'he said "hi", ok'), (1234567890123456790, "two\nlines")]


def test_fingerprint_does_not_depend_on_order_and_handles_none(spark):
    rows = spark.range(100).select("id", (F.col("id") * 7).alias("v"))
    a = table_fingerprint(rows).first()
    assert a == table_fingerprint(rows.orderBy(F.desc("id")).repartition(5)).first()
    assert tuple(table_fingerprint(rows.limit(0)).first()) == (0, 0, 0)
