import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import ranking
from auditspark.operators import report as Q
from auditspark.operators import runplan as H
from auditspark.operators import runs as L


@pytest.fixture(scope="module")
def facts(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("r1", True, True, ["x"], ["a", "b"], "m1", "roc_auc", t0, t0 + dt.timedelta(seconds=9)),
         ("r2", False, False, [], None, None, "rmse", t0, None)],
        "run_id string, reviewer_enabled boolean, profiled boolean, planted array<string>, "
        "final_features array<string>, chosen_model string, metric string, started_at timestamp, "
        "ended_at timestamp")
    extra = {c: F.lit(None).cast("string") for c in (
        "dataset_id", "arm", "default_model", "reviewer_model", "reviewer_prompt", "naming",
        "objection_closure", "commit", "dataset_source", "dataset_hash")}
    runs = runs.withColumns({
        **extra, "reviewer_sees_code": F.lit(True), "loop_cap": F.lit(3),
        "objection_routing": F.lit("by_category"), "forced_drop_release": F.lit("withdrawn_only"),
        "random_seed": F.lit(1), "holdout_fraction": F.lit(0.2),
        "skipped_high_cardinality": F.array(F.lit("w")),
        "top_importances": F.expr("array(named_struct('column','a','mean',0.5D),"
                                  "named_struct('column','b','mean',0.5D))"),
        "review_verdict": F.lit("pass"), "review_loops": F.lit(1)})
    objections = spark.createDataFrame(
        [("r1", "o1", "leakage", "modeler", ["x", "a"], 0)],
        "run_id string, objection_id string, category string, target_node string, "
        "columns array<string>, raised_at_iteration int")
    passes = spark.createDataFrame(
        [("r1", 1, "pass", "reporter", {"o1": "resolved"}, ["o1"])],
        "run_id string, iteration int, claim string, routed_to string, "
        "dispositions map<string,string>, new_objection_ids array<string>")
    candidates = spark.createDataFrame(
        [("r1", "m1", [0.7, 0.9], 0.9, None), ("r1", "m2", [], None, "ValueError:  no\nfit")],
        "run_id string, name string, cv_scores array<double>, claimed_holdout_score double, "
        "fit_error string")
    nominations = spark.createDataFrame([("r1", "x"), ("r1", "b")], "run_id string, column string")
    events = spark.createDataFrame(
        [("r1", "modeler", t0, t0 + dt.timedelta(seconds=2), 10, 5, 0.25, "real"),
         ("r1", "modeler", t0, t0 + dt.timedelta(seconds=3), 1, 1, 0.5, "real"),
         ("r1", "reviewer", t0, None, 1, 1, 0.0, "real")],
        "run_id string, node string, started timestamp, ended timestamp, input_tokens bigint, "
        "output_tokens bigint, cost_usd double, model string")
    errors = spark.createDataFrame(
        [("r2", 1, "intake", "m" * 600, False)],
        "run_id string, seq int, node string, message string, recoverable boolean")
    grades = spark.createDataFrame(
        [("r1", 0.8, "ok", "", 0.0, 40, 0.5, 0.9, "ok", "", "rf-v1", 1.0, 2.0)],
        "run_id string, verified_holdout_score double, rescore_status string, rescore_detail "
        "string, refit_claim_gap double, n_withheld_rows bigint, baseline_zero_score double, "
        "baseline_unit_score double, baseline_status string, baseline_detail string, "
        "baseline_recipe string, rescore_seconds double, baseline_seconds double")
    return runs, objections, passes, candidates, nominations, events, errors, grades


def test_wide_row(facts):
    out = L.results_rows(*facts)
    rows = {r.run_id: r for r in out.collect()}
    a, b = rows["r1"], rows["r2"]
    assert len(out.columns) == 81
    assert a.leakage_graded and a.leakage_caught and a.leakage_remediated
    assert (a.leakage_recall, a.leakage_precision, a.false_alarm_columns) == (1.0, 0.5, ["a"])
    assert a.leakage_flagged_standing == [] and a.false_alarm_standing == 0
    assert a.holdout_claim_gap == pytest.approx(0.1)
    assert a.baseline_normalised_score is None  # planted leak
    assert a.baseline_separation == pytest.approx(0.4)
    assert (a.profiler_recall, a.profiler_false_alarm) == (1.0, 1)
    assert (a.objections_resolved, a.objections_withdrawn, a.objections_falsely_resolved) == (
        1, 0, 1)
    assert a.objections_rerouted == 1 and a.objections_by_target_node["feature_eng"] == 0
    assert a.objected_columns_unremediated == ["a"]
    assert a.node_seconds == {"modeler": 5.0} and a.cost_usd == 0.75 and a.wall_seconds == 9.0
    assert a.candidates_failed_to_fit == ["m2"] and a.n_candidates == 2
    assert (a.top_importance_share, a.top_importance_n80) == (0.5, 2)
    assert not a.errored and a.errors == []
    for name in ("leakage_caught", "leakage_recall", "leakage_remediated", "profiler_nominated",
                 "reviewer_nominated", "objections_resolved", "false_alarm", "n_final_features",
                 "wall_seconds", "verified_holdout_score", "objected_columns_unremediated"):
        assert b[name] is None, name
    assert b.rescore_status == "not_attempted" and b.errored and b.halted_at == "intake"
    assert len(b.errors[0].message) == 500
    assert b.objections_raised == 0 and b.route_sequence == [] and b.cost_usd == 0.0


def test_publishable_and_pricing(spark, facts):
    runs, _, _, candidates, _, events, _, _ = facts
    gate = {r.run_id: (r.publishable, r.reason) for r in L.publishable(
        runs, events.unionByName(events.withColumns(
            {"run_id": F.lit("r3"), "model": F.lit("stub")}))).collect()}
    assert gate == {"r1": (True, None), "r2": (False, "empty trace")}
    prices = spark.createDataFrame(
        [("model-large", 3.0, 15.0, 3.75, 0.3)],
        "model string, input double, output double, cache_write double, cache_read double")
    aliases = spark.createDataFrame([("large", "model-large")], "alias string, model string")
    usage = spark.createDataFrame([("large", 1_000_000, 100_000)],
                                  "model string, input_tokens bigint, output_tokens bigint")
    assert L.priced(usage, prices, aliases).first().cost_usd == pytest.approx(4.5)
    with pytest.raises(Exception, match="no price for model"):
        L.priced(usage.withColumn("model", F.lit("ghost")), prices, aliases).collect()
    table = {r.name: r for r in L.candidate_table(candidates).collect()}
    assert table["m2"].note == "ValueError: no fit" and table["m1"].cv_mean == pytest.approx(0.8)
    totals = [r for r in L.trace_totals(events).collect() if r.is_total]
    assert totals[0].input_tokens == 12


def test_plan_is_replicate_major(spark):
    cells = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.2)],
                                  "cell string, ord int, est_cost_usd double")
    out = [(r.cell, r.replicate, r.run_index) for r in H.plan(cells, 2, 2).orderBy("seq").collect()]
    assert out == [(c, r, i) for r in (1, 2) for c in "ab" for i in (0, 1)]
    assert H.plan_estimate(H.plan(cells, 2, 2)).first().estimated_usd == pytest.approx(1.2)


@pytest.mark.parametrize("cap,seed", [(5.0, 1), (1e9, 2), (40.0, 3), (200.0, 4)])
def test_replay_matches_a_loop(spark, monkeypatch, cap, seed):
    monkeypatch.setattr(H, "_SPAN", 16)
    monkeypatch.setattr(ranking, "SMALL_GROUP", 50)
    rng = random.Random(seed)
    runs = [(i, 0.5, rng.random(), rng.random() < 0.18) for i in range(600)]
    spend, streak, expected = 0.0, 0, (None, len(runs))
    for i, est, cost, failed in runs:
        if spend + est > cap:
            expected = ("cost cap", i)
            break
        spend += est if failed else cost
        streak = streak + 1 if failed else 0
        if streak >= 3:
            expected = ("consecutive failures", i + 1)
            break
    df = spark.createDataFrame(
        runs, "seq bigint, est_cost_usd double, cost_usd double, failed boolean").repartition(6)
    got = H.stop_reason(df, cap)
    assert (got["stopped_early"], got["ran"]) == expected


def test_cell_tally_keeps_silent_cells(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell string")
    out = spark.createDataFrame(
        [("a", False, True, 0.2, 0.1, True, False), ("a", True, False, None, 0.1, None, False),
         ("a", False, False, 0.3, 0.1, True, True)],
        "cell string, failed boolean, publishable boolean, cost_usd double, est_cost_usd double, "
        "leakage_remediated boolean, errored boolean")
    got = {r.cell: r for r in H.cell_tally(cells, out).collect()}
    assert (got["a"].rows_written, got["a"].rows_refused, got["a"].runs_failed) == (1, 1, 1)
    assert got["a"].spend_usd == pytest.approx(0.6) and got["a"].leakage_remediated == 1
    assert got["b"].rows_written == 0 and got["b"].spend_usd == 0.0


def test_selection(spark):
    rows = [(f"d{i:02d}", f"D{i}", 1000 + i, 10, 6, None) for i in range(17)]
    rows += [("big", "Big", 200_000, 5, 5, None), ("wide", "Wide", 10, 300, 9, None),
             ("cells", "Cells", 90_000, 100, 9, None), ("thin", "Thin", 10, 9, 4, None),
             ("net", "Net", None, None, None, "fetch_failed")]
    df = spark.createDataFrame(
        rows, "dataset_id string, name string, n_rows bigint, n_features bigint, "
        "n_usable_features bigint, failed string")
    out = {r.dataset_id: r.failed for r in H.select_datasets(df).collect()}
    assert [k for k, v in sorted(out.items()) if v is None] == [f"d{i:02d}" for i in range(15)]
    assert out["d15"] == out["d16"] == "target_count"
    assert {k: out[k] for k in ("big", "wide", "cells", "thin", "net")} == {
        "big": "max_rows", "wide": "max_features", "cells": "max_cells",
        "thin": "min_usable_features", "net": "fetch_failed"}
    assert [r.name for r in H.exclusions(H.select_datasets(df)).collect()][0] == "Net"
    assert not H.count_warning(H.select_datasets(df)).first().outside_target


def test_cost_model_and_price(spark):
    rng = random.Random(0)
    rows = [(x, z, 0.01 + 0.002 * x + 0.3 * z) for x, z in
            ((float(rng.randint(1, 50)), rng.random()) for _ in range(60))]
    fit = H.cost_model(spark.createDataFrame(rows, "f double, r double, c double"), "c", "f", "r")
    got = fit.first()
    assert (got.a, got.b, got.c) == (pytest.approx(0.01), pytest.approx(0.002), pytest.approx(0.3))
    assert got.residual_sd == pytest.approx(0.0, abs=1e-6)
    df = spark.createDataFrame([("x", 0.0101), ("x", 0.0103), ("y", 0.02)],
                               "cell string, cost_usd double")
    assert {r.cell: r.est_cost_usd for r in H.price_per_cell(df).collect()} == {
        "x": 0.011, "y": 0.02}
    with pytest.raises(ValueError):
        H.annotate(df, "s", "Bad Name")


def test_report(spark):
    lines = spark.createDataFrame(
        [("f1", '{"a": 1, "b": null}'), ("f1", ""), ("f1", '{"a": 2, "z": 3}'), ("f2", '{"c": 1}')],
        "file string, value string")
    got = {r.file: r for r in Q.schema_drift(lines, ["a", "b", "c"]).collect()}
    assert (got["f1"].n_rows, got["f1"].n_columns, got["f1"].n_missing, got["f1"].extra) == (
        2, 3, 1, ["z"])
    rows = spark.createDataFrame(
        [("d", 1, 1.0), ("d", 1, 3.0), ("d", 2, 6.0), ("e", 2, 9.0)],
        "dataset_id string, review_loops int, cost_usd double")
    got = {r.review_loops: (r.n, r.multiplier) for r in Q.loop_multiplier(rows).collect()}
    assert got == {1: (2, 1.0), 2: (1, 3.0)}
    member = spark.createDataFrame([(["x"], ["y"]), (None, ["x", "y"])],
                                   "nom array<string>, fl array<string>")
    got = {r["column"]: (r.nom, r.fl, r.n) for r in Q.membership_rates(
        member, ["x", "y"], ["nom", "fl"]).collect()}
    assert got == {"x": (1, 1, 2), "y": (0, 2, 2)}
    gaps = spark.createDataFrame([(0.01,), (-0.05,), (None,), (0.03,)], "holdout_claim_gap double")
    g = Q.gap_stats(gaps).first()
    assert (g.median, g.max, g.min, g.wide, g.n) == (0.01, 0.03, -0.05, 2, 3)
