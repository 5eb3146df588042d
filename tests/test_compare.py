import pytest
from pyspark.sql import functions as F

from auditspark.functions.exprs import wilson
from auditspark.operators import compare as C

KEYS = ["arm", "loop_cap"]


def _rows(spark, rows):
    return spark.createDataFrame(
        rows, "arm string, loop_cap int, replicate int, leakage_caught boolean, halted_at string, "
        "cost_usd double")


def test_wilson_hand_values(spark):
    df = spark.createDataFrame([(9, 10), (5, 10), (0, 0), (10, 10)], "s bigint, n bigint")
    got = [(round(r[0], 4), round(r[1], 4)) for r in
           df.select(*wilson(F.col("s"), F.col("n"))).collect()]
    assert got[:3] == [(0.5958, 0.9821), (0.2366, 0.7634), (0.0, 1.0)]
    assert got[3][1] == 1.0


def test_null_is_excluded_and_predicates_count_everything(spark):
    df = _rows(spark, [("a", 3, 1, True, None, 1.0), ("a", 3, 2, None, "x", 1.0),
                       ("a", 3, 2, False, None, None)])
    got = {r.metric: r for r in C.tally(
        df, ["leakage_caught", "halted_at:notnull", "ghost", "halted_at"], KEYS).collect()}
    assert (got["leakage_caught"].successes, got["leakage_caught"].n,
            got["leakage_caught"].excluded) == (1, 2, 1)
    assert (got["halted_at:notnull"].successes, got["halted_at:notnull"].n) == (1, 3)
    assert (got["ghost"].n, got["ghost"].excluded, got["ghost"].replicates) == (0, 3, 0)
    assert (got["halted_at"].successes, got["halted_at"].n) == (1, 1)
    assert [tuple(p) for p in got["leakage_caught"].per_replicate] == [(1, 1), (0, 1)]
    with pytest.raises(ValueError, match="unknown predicate"):
        C.tally(df, ["halted_at:notnul"], KEYS)


def test_replicate_buckets(spark):
    df = _rows(spark, [("a", 3, None, True, None, 1.0), ("a", 3, 2, True, None, 1.0),
                       ("b", 3, None, True, None, 1.0)])
    got = {r.arm: r for r in C.tally(df, ["leakage_caught"], KEYS).collect()}
    assert got["a"].replicates == 2 and got["b"].replicates == 0
    assert [tuple(p) for p in got["a"].per_replicate] == [(1, 1), (1, 1)]


def test_verdict_order_null_keys_and_one_sided_cells(spark):
    def block(arm, cap, rep, value, k):
        return [(arm, cap, rep, value, None, 1.0)] * k

    before = _rows(spark, block("u", None, 1, False, 10) + block("s", 3, 1, False, 10)
                   + block("s", 3, 2, False, 10) + block("gone", 1, 1, True, 1)
                   + block("e", 1, 1, True, 5) + block("e", 1, 2, False, 5))
    after = _rows(spark, block("u", None, 1, True, 10) + block("s", 3, 1, True, 10)
                  + block("s", 3, 2, True, 10) + block("new", 1, 1, True, 1)
                  + block("e", 1, 1, True, 5) + block("e", 1, 2, False, 5))
    out = {r.arm: r for r in C.compare(before, after, ["leakage_caught"], KEYS).collect()}
    assert out["u"].verdict == "underpowered" and out["u"].flipped
    assert out["s"].verdict == "separates" and out["s"].flipped
    assert out["e"].verdict == "not separating" and not out["e"].flipped
    assert out["gone"].verdict == "only in before" and out["gone"].only_in == "before"
    assert out["new"].verdict == "only in after" and out["new"].after.n == 1
    text = {r.cell: r for r in C.rendered(
        C.compare(before, after, ["leakage_caught"], KEYS), KEYS).collect()}
    assert text["arm=s loop_cap=3"].verdict == "separates at this n"
    assert text["arm=u"].before == "0/10 [0.000, 0.278] -- 1 replicates: 0/10"
    means = {r.arm: r for r in C.compare_means(before, after, ["cost_usd"], KEYS).collect()}
    assert means["new"].before is None and means["new"].after == 1.0


def test_order_puts_missing_first_and_compares_strings(spark):
    df = spark.createDataFrame([("10",), ("9",), (None,)], "loop_cap string")
    assert [r.loop_cap for r in C.in_cell_order(df, ["loop_cap"]).collect()] == [None, "10", "9"]
