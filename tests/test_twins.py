"""Queries beside their SQL on values that the test tables lack."""

import random

import duckdb
import pytest

import __spark_entry__ as entry_points
from oracle_check import compare


def agree(spark, folder, name, table, rows, schema):
    path = str(folder / f"{table}.parquet")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return compare(entry_points.queries()[name](spark, str(folder)), con, entry_points.oracle_sql()[name])


@pytest.mark.parametrize("name", ["fingerprint_customer", "withheld_partition_customer"])
def test_digests_of_odd_doubles(spark, tmp_path, name):
    balances = [0.0, -0.0, 0.01, -999.99, 0.00025, -1.5e-7, 1e7, 12345678.25, -3e21, float("nan"),
                float("inf"), None, 0.001, 9999999.5]
    rows = [(i, f"c{i}", i % 3 if i % 4 else None, v, None if i == 5 else "AB"[i % 2])
            for i, v in enumerate(balances)]
    assert agree(spark, tmp_path, name, "customer", rows, "c_custkey bigint, c_name string, "
                 "c_nationkey int, c_acctbal double, c_mktsegment string") is None


def test_metrics_of_certain_scores(spark, tmp_path):
    rows = [(k, v) for k in ("purchase", "view", None) for v in (0.0, 500.0, 620.0, -3.0, 120.0, 7.5, None)]
    assert agree(spark, tmp_path, "classification_metrics_events", "events", rows,
                 "event_type string, value double") is None


def test_prices_that_add_up_to_a_whole(spark, tmp_path):
    # every customer's sum is a multiple of 25, which sums of doubles miss on either side
    rng, rows = random.Random(3), []
    for c in range(400):
        cents = [rng.randrange(10**6, 5 * 10**7) for _ in range(19)]
        rows += [(c, v / 100) for v in [*cents, 2500 * 10**5 - sum(cents) % 2500]]
    assert agree(spark, tmp_path, "exclusions_orders", "orders", rows,
                 "o_custkey bigint, o_totalprice double") is None
    got = entry_points.queries()["exclusions_orders"](spark, str(tmp_path))
    cents = {f"D{c}": sum(round(p * 100) for k, p in rows if k == c) for c in range(400)}
    assert all(r.n_rows == cents[r["name"]] // 2500 for r in got.collect())


def test_ridge_over_equal_lines(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1, 1, 1, float(rng.randint(1, 50)), rng.random() * 1000, 0.05, 0.02, "ANR"[i % 3], "O", "1996-09-13")
            for i in range(200)]
    spark.createDataFrame(rows + rows[:40], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                          "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag "
                          "string, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry_points.queries()["ridge_lineitem"](spark, str(tmp_path)).first()
    assert got.fit_error is None and len(got.cv_scores) == 5 and all(0 < s < 1000 for s in got.cv_scores)
