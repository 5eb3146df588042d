"""Queries over review logs, run grading, comparisons, plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.functions import exprs, vocab
from auditspark.operators import compare, naming, report, reviewlog, runplan, runs, transform
from auditspark.queries.common import (
    DISPOSITIONS, EVENT_ROWS, LATEST, OBJECTIONS, REVIEW, RUNS, dispositions_of, event_rows, load,
    objections_of, runs_of,
)
from auditspark.sources import results

SCOPED = "('leakage', 'contamination', 'implausible_importance')"


def _log(spark, sf):
    acting = reviewlog.with_acting_node(objections_of(spark, sf), runs_of(spark, sf))
    return acting, reviewlog.latest_dispositions(dispositions_of(spark, sf))


# ---------------------------------------------------------------- review log


def latest_dispositions_orders(spark, sf):
    return reviewlog.latest_dispositions(dispositions_of(spark, sf)).withColumn(
        "iteration", F.col("iteration").cast("bigint"))


def _turns(spark, sf):
    """Conversation = run and objection, turn = pass, role = what was said."""
    said = (F.when(F.col("role") == "user", "still_open").when(
        F.col("role") == "assistant", "resolved").otherwise("not_reviewed"))
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("conv_id").alias("objection_id"),
        F.col("turn").alias("iteration"), said.alias("disposition"))


def latest_role_conversations(spark, sf):
    return reviewlog.latest_dispositions(_turns(spark, sf))


def open_conversations(spark, sf):
    convs = _turns(spark, sf).groupBy("run_id", "objection_id").agg(F.count("*").alias("turns"))
    return reviewlog.open_objections(convs, reviewlog.latest_dispositions(_turns(spark, sf)))


def verdict_conversations(spark, sf):
    """Every turn is a pass: the user blocks, the assistant passes, the system says nothing."""
    claim = F.when(F.col("role") == "user", "block").when(F.col("role") == "assistant", "pass")
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", reviewlog.verdict(claim, F.col("turn"), F.lit(3)).alias("verdict"))


def open_objections_orders(spark, sf):
    acting, latest = _log(spark, sf)
    return reviewlog.open_objections(acting, latest).groupBy("acting_node", "category").agg(
        F.count("*").alias("n"))


def binding_objections_orders(spark, sf):
    acting, latest = _log(spark, sf)
    return reviewlog.binding_objections(acting, latest, "feature_eng").groupBy(
        "category", "forced_drop_release").agg(F.count("*").alias("n"))


def binding_columns_orders(spark, sf):
    acting, latest = _log(spark, sf)
    return reviewlog.binding_columns(reviewlog.binding_objections(acting, latest)).groupBy(
        "column").agg(F.count("*").alias("runs"))


def dispositions_with_default_orders(spark, sf):
    acting, latest = _log(spark, sf)
    early = latest.filter(F.col("iteration") <= 5)
    return reviewlog.with_disposition(acting, early).groupBy("disposition").agg(
        F.count("*").alias("n"))


def projected_open_orders(spark, sf):
    """Open set once the last line of every order is applied and returns are added."""
    acting, latest = _log(spark, sf)
    first = latest.filter(F.col("iteration") < 6)
    pending = latest.filter(F.col("iteration") >= 6)
    adding = acting.filter(F.col("category") == "other").withColumn(
        "objection_id", -F.col("objection_id") - 1)
    return reviewlog.would_be_open(
        reviewlog.open_objections(acting, first), adding, pending, "modeler").groupBy(
            "category").agg(F.count("*").alias("n"))


def adjudicated_orders(spark, sf):
    judged = reviewlog.adjudicate(objections_of(spark, sf), ["price_mid", "status_O", "other"])
    return judged.groupBy("category", "rejected").agg(
        F.count("*").alias("n"), F.sum(F.size("columns")).alias("kept"),
        F.sum(F.size("dropped")).alias("dropped"))


def adjudication_report_orders(spark, sf):
    judged = reviewlog.adjudicate(objections_of(spark, sf), ["price_mid", "status_O"])
    return reviewlog.adjudication_report(judged).select(
        "run_id", "proposals", "rejected", F.array_join("dropped", ",").alias("dropped"))


def defaulted_dispositions_orders(spark, sf):
    acting, latest = _log(spark, sf)
    open_now = reviewlog.open_objections(acting, latest)
    updates = latest.filter(F.col("disposition") != "not_reviewed").withColumn(
        "disposition", F.lit("still_open"))
    return reviewlog.default_dispositions(open_now, updates).groupBy("disposition").agg(
        F.count("*").alias("n"))


def _claims(spark, sf):
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "pass").when(
            F.col("c_mktsegment") != "MACHINERY", "block").alias("claim"),
        (F.col("c_nationkey") % 4).alias("iterations"), F.lit(3).alias("loop_cap"))


def routed_customers(spark, sf):
    acting, latest = _log(spark, sf)
    urgent = reviewlog.open_objections(acting, latest).filter(F.col("category") == "leakage")
    return reviewlog.route(_claims(spark, sf), urgent).select(
        "run_id", "verdict", "routed_to", "dead_end")


def dead_ends_customers(spark, sf):
    acting, latest = _log(spark, sf)
    urgent = reviewlog.open_objections(acting, latest).filter(F.col("category") == "leakage")
    return reviewlog.nothing_to_act_on(_claims(spark, sf), urgent).select("run_id")


def new_objections_orders(spark, sf):
    """Year of the order is the pass that raised it; passes are the years a customer ordered."""
    o = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("objection_id"),
        (F.year("o_orderdate") - 1993).alias("raised_at_iteration"))
    passes = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("run_id"), (F.year("o_orderdate") - 1992).alias(
            "iteration")).distinct()
    return reviewlog.new_objections(o, passes).groupBy("run_id", "iteration").agg(
        F.count("*").alias("n")).withColumn("iteration", F.col("iteration").cast("bigint"))


def objected_columns_orders(spark, sf):
    acting, latest = _log(spark, sf)
    standing = reviewlog.open_objections(acting, latest)
    ever = reviewlog.objected_columns(acting).withColumnRenamed("columns", "ever")
    still = reviewlog.objected_columns(standing, vocab.LEAK_CATEGORIES).withColumnRenamed(
        "columns", "still")
    return ever.join(still, "run_id", "left").select(
        "run_id", F.array_join("ever", ",").alias("ever"), F.array_join("still", ",").alias(
            "still"))


def category_counts_orders(spark, sf):
    counts = reviewlog.category_counts(objections_of(spark, sf))
    return counts.select("run_id", *[
        F.col("objections_by_category")[c].alias(c) for c in vocab.CATEGORIES])


def category_counts_events(spark, sf):
    return reviewlog.zero_filled_wide(
        load(spark, sf, "events").withColumnRenamed("user_id", "run_id"), "event_type",
        ["view", "click", "purchase", "signup", "error", "refund"])


def rerouted_orders(spark, sf):
    acting, _ = _log(spark, sf)
    targets = reviewlog.target_counts(acting)
    return reviewlog.rerouted(acting).join(targets, "run_id").select(
        "run_id", "objections_rerouted",
        F.col("objections_by_target_node")["modeler"].alias("modeler"),
        F.col("objections_by_target_node")["feature_eng"].alias("feature_eng"))


def _finals(spark, sf):
    wide = F.when(F.col("c_mktsegment") == "MACHINERY", F.array().cast("array<string>")).when(
        F.col("c_mktsegment") == "BUILDING", F.array(F.lit("price_low"), F.lit("status_F")))
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        wide.otherwise(F.array(F.lit("price_mid"), F.lit("status_O"))).alias("final_features"))


def closure_counts_orders(spark, sf):
    acting, latest = _log(spark, sf)
    return reviewlog.closure_counts(acting, latest, _finals(spark, sf))


def unremediated_orders(spark, sf):
    out = reviewlog.unremediated(reviewlog.objected_columns(objections_of(spark, sf)),
                                 _finals(spark, sf))
    return out.select("run_id", F.array_join(
        "objected_columns_unremediated", ",").alias("unremediated"))


def route_sequence_customers(spark, sf):
    """Per-pass arrays in pass order: one pass per year a customer ordered in."""
    o = load(spark, sf, "orders")
    passes = o.groupBy(F.col("o_custkey").alias("run_id"), F.year("o_orderdate").alias(
        "iteration")).agg(F.min("o_orderstatus").alias("routed_to"),
                          F.count_distinct("o_orderpriority").alias("k"))
    passes = passes.withColumn("new_objection_ids", F.transform(
        F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: i.cast("string")))
    return reviewlog.route_sequences(passes).select(
        "run_id", F.array_join("route_sequence", ",").alias("route_sequence"),
        F.array_join(F.transform("new_objections_per_pass", lambda n: n.cast("string")),
                     ",").alias("new_per_pass"))


def halted_events(spark, sf):
    errors = load(spark, sf, "events").filter(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").alias("node"),
        (~((F.col("event_type") == "error") & (F.col("value") > 60))).alias("recoverable"))
    return reviewlog.halts(errors)


# ---------------------------------------------------------------- grading


def _graded_runs(spark, sf):
    acting, latest = _log(spark, sf)
    flagged = reviewlog.objected_columns(acting, vocab.LEAK_CATEGORIES)
    standing = reviewlog.objected_columns(
        reviewlog.open_objections(acting, latest), vocab.LEAK_CATEGORIES)
    planted = F.when(F.col("c_acctbal") > 1000, F.array(
        F.lit("price_high"), F.lit("status_F"))).otherwise(F.array().cast("array<string>"))
    base = runs_of(spark, sf).select("run_id", planted.alias("planted"))
    return (base.join(_finals(spark, sf), "run_id")
            .join(flagged.withColumnRenamed("columns", "flagged"), "run_id", "left")
            .join(standing.withColumnRenamed("columns", "standing"), "run_id", "left"))


def leakage_rates_orders(spark, sf):
    c = F.col
    cols = runs.leakage_columns(c("planted"), c("flagged"), c("standing"), c("final_features"))
    text = {"leakage_planted", "leakage_flagged", "false_alarm_columns",
            "leakage_flagged_standing"}
    return _graded_runs(spark, sf).select("run_id", *[
        (F.array_join(e, ",") if n in text else F.round(e, 6) if n in (
            "leakage_recall", "leakage_precision") else e).alias(n) for n, e in cols.items()])


def detector_rates_orders(spark, sf):
    """NULL where the detector never ran, zeros where it looked and declined."""
    c = F.col
    ran = _graded_runs(spark, sf).join(runs_of(spark, sf).select("run_id", "c_mktsegment"),
                                       "run_id")
    named = F.when(c("c_mktsegment") != "FURNITURE", F.coalesce(
        c("flagged"), F.array().cast("array<string>")))
    cols = runs.detector_columns("profiler", named, c("planted"))
    return ran.select("run_id", *[
        (F.array_join(e, ",") if n.endswith("nominated") else F.round(e, 6) if n.endswith(
            "recall") else e).alias(n) for n, e in cols.items()])


def known_columns_missing(spark, sf):
    from auditspark.operators.profile import column_profile

    known = load(spark, sf, "nation").select(F.when(
        F.col("n_regionkey") < 2, "c_acctbal").otherwise(F.concat(
            F.lit("ghost_"), "n_name")).alias("column"))
    return runs.missing_known(known, column_profile(load(spark, sf, "customer")))


def publishable_events(spark, sf):
    """Users as runs, event types as models: signups are placeholders, clicks leave no trace."""
    e = load(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.when(
            (F.col("event_type") == "signup") & (F.col("value") > 150), "stub").otherwise(
                F.col("event_type")).alias("model"))
    users = load(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return runs.publishable(users, e)


def _usage(spark, sf):
    return load(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("model"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        (F.col("value") * 10).cast("bigint").alias("output_tokens"), "event_id")


def _prices(spark):
    prices = spark.createDataFrame(
        [("m-view", 1.0, 5.0, 1.25, 0.1), ("click", 3.0, 15.0, 3.75, 0.3),
         ("purchase", 5.0, 25.0, 6.25, 0.5)],
        "model string, input double, output double, cache_write double, cache_read double")
    aliases = spark.createDataFrame(
        [("view", "m-view"), ("signup", "m-view"), ("error", "purchase")],
        "alias string, model string")
    return prices, aliases


def run_cost_events(spark, sf):
    return runs.run_costs(runs.priced(_usage(spark, sf), *_prices(spark))).withColumn(
        "cost_usd", F.round("cost_usd", 9))


def _visits(spark, sf):
    """Events as node visits lasting their value in seconds; every error never ended."""
    e = load(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("node"),
        F.col("ts").alias("started"), F.when(F.col("event_type") != "error", F.timestamp_micros(
            F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor(F.col("value") * 100) * 10000).cast("bigint"))).alias(
                "ended"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.col("event_id").alias("output_tokens"), F.col("value").alias("cost_usd"),
        F.col("event_id").alias("seq"), F.dayofmonth("ts").cast("bigint").alias("visit"),
        F.get_json_object("props", "$.k").alias("model"))


def node_seconds_events(spark, sf):
    return runs.node_seconds_long(_visits(spark, sf))


def node_seconds_map_events(spark, sf):
    m = runs.node_seconds(_visits(spark, sf))
    return m.select("run_id", F.size("node_seconds").cast("bigint").alias("nodes"),
                    F.col("node_seconds")["click"].alias("click"))


def wall_seconds_events(spark, sf):
    v = load(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.min("ts").alias("started_at"),
        F.when(F.max("value") < 300, F.max("ts")).alias("ended_at"))
    return v.select("run_id", F.round(runs.wall_seconds(), 3).alias("wall_seconds"))


def trace_total_events(spark, sf):
    return runs.trace_totals(_visits(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 4))


def stage_usage_events(spark, sf):
    return runs.stage_usage(_visits(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 4))


def loop_exhausted_customers(spark, sf):
    return _claims(spark, sf).select("run_id", runs.loop_exhausted(
        F.col("iterations"), F.col("loop_cap")).alias("exhausted"))


def _candidates(spark, sf):
    return load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("run_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.array(
            F.col("s_acctbal"), F.col("s_acctbal") / 2)).otherwise(
                F.array().cast("array<double>")).alias("cv_scores"),
        F.col("s_acctbal").alias("claimed_holdout_score"),
        F.when(F.col("s_acctbal") <= 0, F.concat(F.lit("ValueError:  \n balance "), F.col(
            "s_acctbal").cast("string"))).alias("fit_error"))


def candidate_table_suppliers(spark, sf):
    return runs.candidate_table(_candidates(spark, sf)).select(
        "run_id", "name", F.round("cv_mean", 6).alias("cv_mean"), "claimed_holdout_score", "note")


def candidate_summary_suppliers(spark, sf):
    return runs.candidate_summary(_candidates(spark, sf)).withColumn(
        "candidates_failed_to_fit", F.array_join("candidates_failed_to_fit", ","))


def results_row_customers(spark, sf):
    """The whole wide row from fact tables bound to customers, orders, lines and events."""
    base = runs_of(spark, sf)
    null = F.lit(None).cast("string")
    r = base.join(_finals(spark, sf), "run_id").withColumns({
        "run_id": F.col("run_id"), "dataset_id": F.col("c_mktsegment"), "arm": F.lit("team"),
        "reviewer_enabled": F.col("c_mktsegment") != "HOUSEHOLD",
        **{c: null for c in ("default_model", "reviewer_model", "reviewer_prompt",
                             "objection_closure", "commit", "dataset_source", "dataset_hash")},
        "reviewer_sees_code": F.lit(True), "naming": F.lit("opaque"), "loop_cap": F.lit(3),
        "random_seed": F.lit(vocab.DEFAULT_SEED), "holdout_fraction": F.lit(0.2),
        "metric": F.when(F.col("c_acctbal") > 0, "roc_auc").otherwise("rmse"),
        "profiled": F.col("c_acctbal") > -500,
        "planted": F.when(F.col("c_acctbal") > 1000, F.array(
            F.lit("price_high"), F.lit("status_F"))).otherwise(F.array().cast("array<string>")),
        "skipped_high_cardinality": F.array().cast("array<string>"),
        "top_importances": F.array(
            F.struct(F.lit("a").alias("column"), F.lit(0.6).alias("mean")),
            F.struct(F.lit("b").alias("column"), F.lit(0.3).alias("mean")),
            F.struct(F.lit("c").alias("column"), F.lit(-0.1).alias("mean"))),
        "chosen_model": F.lit("m0"), "review_verdict": F.lit("pass"), "review_loops": F.lit(1),
        "started_at": F.lit("2024-01-01").cast("timestamp"),
        "ended_at": F.lit("2024-01-02").cast("timestamp")}).drop("c_mktsegment", "c_acctbal")
    objections = objections_of(spark, sf)
    said = reviewlog.latest_dispositions(dispositions_of(spark, sf))
    passes = said.withColumn("objection_id", F.col("objection_id").cast("string")).groupBy(
        "run_id", "iteration").agg(F.map_from_entries(F.collect_list(F.struct(
            "objection_id", "disposition"))).alias("dispositions")).withColumns({
                "claim": F.lit("block"), "routed_to": F.lit("modeler"),
                "new_objection_ids": F.array().cast("array<string>")})
    objections = objections.withColumn("objection_id", F.col("objection_id").cast("string"))
    candidates = base.select("run_id", F.lit("m0").alias("name"), F.array(F.lit(0.7)).alias(
        "cv_scores"), (F.col("c_acctbal") / 10000).alias("claimed_holdout_score"),
        null.alias("fit_error"))
    nominations = objections.filter(F.col("category") == "other").select(
        "run_id", F.col("columns")[0].alias("column"))
    events = _visits(spark, sf)
    errors = load(spark, sf, "events").filter((F.col("event_type") == "error") & (
        F.col("value") > 150)).select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
            F.col("event_type").alias("node"), F.lit("boom").alias("message"),
            (F.col("value") < 200).alias("recoverable"))
    grades = base.select(
        "run_id", (F.col("c_acctbal") / 20000).alias("verified_holdout_score"),
        F.lit("ok").alias("rescore_status"), F.lit("").alias("rescore_detail"),
        F.lit(0.0).alias("refit_claim_gap"), F.lit(10).alias("n_withheld_rows"),
        F.lit(0.25).alias("baseline_zero_score"), F.lit(0.75).alias("baseline_unit_score"),
        F.lit("ok").alias("baseline_status"), F.lit("").alias("baseline_detail"),
        F.lit("rf-v1").alias("baseline_recipe"), F.lit(1.0).alias("rescore_seconds"),
        F.lit(1.0).alias("baseline_seconds"))
    wide = runs.results_rows(r, objections, passes, candidates, nominations, events, errors,
                             grades)
    flat = []
    for f in wide.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType,
                                                              T.StructType):
            c = F.size(c).cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, T.MapType):
            c = F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x.cast("double"))
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        if isinstance(f.dataType, (T.DoubleType, T.MapType)):
            c = F.round(c, 6)
        flat.append(c.alias(f.name))
    return wide.select(*flat)


# ---------------------------------------------------------------- comparisons

CELLS = ["dataset_id", "arm"]
SPECS = ["leakage_remediated", "leakage_caught", "errored", "halted_at:notnull"]


def tally_events(spark, sf):
    out = compare.with_interval(compare.tally(event_rows(spark, sf), SPECS, CELLS))
    reps = F.array_join(F.transform("per_replicate", lambda p: F.concat_ws(
        "/", p["successes"].cast("string"), p["n"].cast("string"))), " ")
    return out.select(*CELLS, "metric", "successes", "n", "excluded",
                      F.col("replicates").cast("bigint").alias("replicates"),
                      reps.alias("per_replicate"), F.round("low", 6).alias("low"),
                      F.round("high", 6).alias("high"))


def wilson_events(spark, sf):
    counts = load(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("s"), F.count("*").alias("n"))
    low, high = exprs.wilson(F.col("s"), F.col("n"))
    return counts.select("user_id", "s", "n", F.round(low, 6).alias("low"),
                         F.round(high, 6).alias("high"))


def _halves(spark, sf):
    rows = event_rows(spark, sf)
    first = F.dayofmonth("ts") <= 15
    quiet = (F.col("dataset_id") == "signup") & F.col("arm").isNull()
    return (rows.filter(first & ~quiet), rows.filter(
        ~first & ~((F.col("dataset_id") == "view") & F.col("arm").eqNullSafe("team"))))


def compare_events(spark, sf):
    out = compare.compare(*_halves(spark, sf), SPECS, CELLS)
    fields = []
    for side in ("before", "after"):
        for name in ("successes", "n", "excluded", "replicates"):
            fields.append(F.col(side)[name].cast("bigint").alias(f"{side}_{name}"))
        for name in ("low", "high"):
            fields.append(F.round(f"{side}_{name}", 6).alias(f"{side}_{name}"))
    return out.select(*CELLS, "metric", "only_in", "verdict", "flipped", *fields)


def flip_events(spark, sf):
    """Users as cells: which of the two headline metrics changed direction."""
    rows = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("dataset_id"), F.dayofmonth("ts").alias("d"),
        (F.dayofmonth("ts") % 7).alias("replicate"), (F.col("value") > 40).alias("leakage_caught"))
    out = compare.compare(rows.filter("d <= 15"), rows.filter("d > 15"), ["leakage_caught"],
                          ["dataset_id"])
    return out.select("dataset_id", "verdict", "flipped")


def compare_means_events(spark, sf):
    out = compare.compare_means(*_halves(spark, sf), ["cost_usd", "k"], CELLS)
    return out.select(*CELLS, "column", F.round("before", 6).alias("before"),
                      F.round("after", 6).alias("after"))


def rendered_events(spark, sf):
    return compare.rendered(compare.compare(*_halves(spark, sf), SPECS, CELLS), CELLS).select(
        "cell", "metric", "verdict", "flipped")


def cell_order_events(spark, sf):
    """Position of every cell: missing first, then by string form."""
    cells = event_rows(spark, sf).groupBy("arm", F.col("replicate").cast("string").alias(
        "replicate")).agg(F.count("*").alias("n"))
    from auditspark.operators.ranking import dense_index

    order = [F.col(k).asc_nulls_first() for k in ("arm", "replicate")]
    return dense_index(cells, order, "position")


# ---------------------------------------------------------------- plans


def plan_replicate_major(spark, sf):
    cells = load(spark, sf, "nation").select(
        F.col("n_name").alias("cell"), F.col("n_nationkey").cast("bigint").alias("ord"),
        (F.lit(0.01) + F.col("n_regionkey") / 100).alias("est_cost_usd"))
    out = runplan.plan(cells, 3, 4)
    return out.select("cell", F.col("replicate").cast("bigint").alias("replicate"),
                      F.col("run_index").cast("bigint").alias("run_index"), "seq")


def plan_estimate_customers(spark, sf):
    cells = load(spark, sf, "customer").select(
        F.col("c_name").alias("cell"), F.col("c_custkey").alias("ord"),
        (F.col("c_nationkey") / 1000).alias("est_cost_usd"))
    return runplan.plan_estimate(runplan.plan(cells, 2, 2)).withColumn(
        "estimated_usd", F.round("estimated_usd", 6))


def _outcomes(spark, sf):
    e = load(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.lit(60.0).alias("est_cost_usd"),
        F.col("value").alias("cost_usd"), (F.col("event_type") == "error").alias("failed"),
        F.col("user_id").cast("string").alias("cell"),
        (F.col("event_type") != "signup").alias("publishable"),
        F.when(F.col("value") > 20, F.col("value") > 50).alias("leakage_remediated"),
        (F.col("value") > 90).alias("errored"))


def spend_cap_events(spark, sf):
    frames = [runplan.first_cap_hit(_outcomes(spark, sf), cap).select(
        F.lit(cap).alias("cap"), "seq", F.round("spent", 4).alias("spent"))
        for cap in (1_000.0, 100_000.0, 1e12)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def consecutive_failures_events(spark, sf):
    frames = [runplan.first_failure_streak(_outcomes(spark, sf), k).select(
        F.lit(k).cast("bigint").alias("length"), "seq") for k in (2, 3, 4)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def stop_reason_events(spark, sf):
    rows = []
    for cap in (1_000.0, 100_000.0, 1e12):
        got = runplan.stop_reason(_outcomes(spark, sf), cap)
        rows.append((cap, got["stopped_early"], got["ran"]))
    return spark.createDataFrame(rows, "cap double, stopped_early string, ran bigint")


def cell_tally_events(spark, sf):
    cells = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cell"))
    out = runplan.cell_tally(cells, _outcomes(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("spend_usd", "charged_estimate_usd")})


def price_per_cell_events(spark, sf):
    rows = load(spark, sf, "events").select(
        F.col("event_type").alias("cell"), (F.col("value") / 1000).alias("cost_usd"))
    return runplan.price_per_cell(rows)


def cost_model_lineitem(spark, sf):
    rows = load(spark, sf, "lineitem")
    fit = runplan.cost_model(rows, "l_extendedprice", "l_quantity", "l_discount")
    return fit.select("n", *[F.round(c, 3).alias(c) for c in ("a", "b", "c", "residual_sd")])


def _measured(spark, sf):
    """Every customer's orders as one measured dataset; prices are added up in whole cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(cents).alias("cents")).select(
            F.concat(F.lit("d"), "o_custkey").alias("dataset_id"),
            F.concat(F.lit("D"), "o_custkey").alias("name"),
            F.expr("cents div 2500").alias("n_rows"),
            (F.col("n") * 14).alias("n_features"), F.col("n").alias("n_usable_features"),
            F.when(F.col("n") > 18, "task_type").alias("failed"))


RULE = {**vocab.SELECTION, "max_rows": 150_000, "max_cells": 8_000_000}


def select_datasets(spark, sf):
    return runplan.select_datasets(_measured(spark, sf), RULE).select("dataset_id", "failed")


def exclusions_orders(spark, sf):
    out = runplan.exclusions(runplan.select_datasets(_measured(spark, sf), RULE))
    return out.select("name", "failed", F.col("measured")["n_rows"].alias("n_rows"))


def published_best_lineitem(spark, sf):
    e = load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.col("l_orderkey").alias("run_id"),
        F.col("l_returnflag").alias("flow_name"),
        F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).alias("value"))
    return runplan.published_best(e)


def candidate_list_parts(spark, sf):
    s = load(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("task_id"))
    p = load(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias(
        "task_id"))
    return runplan.candidate_list(s, p)


# ---------------------------------------------------------------- reports


def schema_drift_events(spark, sf):
    lines = load(spark, sf, "events").select(
        F.col("event_type").alias("file"), F.when(F.col("value") > 200, F.replace(
            F.col("props"), F.lit('"k"'), F.lit('"big"'))).otherwise(F.col("props")).alias("value"))
    out = report.schema_drift(lines, ["k", "j"])
    return out.withColumn("extra", F.array_join("extra", ","))


def run_summary_events(spark, sf):
    rows = event_rows(spark, sf).withColumns({
        "wall_seconds": F.col("cost_usd") * 2, "commit": F.col("dataset_id")})
    return report.run_summary(rows, ["arm", "dataset_id"]).withColumns({
        "cost_usd": F.round("cost_usd", 4), "wall_minutes": F.round("wall_minutes", 4)})


def _dataset_rows(spark, sf):
    return event_rows(spark, sf).withColumns({
        "review_loops": (F.col("k") % 3 + 1), "objections_raised": F.col("k") % 2})


def dataset_means_events(spark, sf):
    out = report.dataset_means(_dataset_rows(spark, sf), ["cost_usd", "k"])
    return out.select("dataset_id", F.round("cost_usd", 6).alias("cost_usd"),
                      F.round("k", 6).alias("k"), "objecting_runs", "runs",
                      F.col("loops")[F.lit(1).cast("bigint")].alias("one_loop"))


def gap_stats_orders(spark, sf):
    rows = load(spark, sf, "orders").select(
        (F.col("o_totalprice") / 1e7 - 0.02).alias("holdout_claim_gap"))
    return report.gap_stats(rows).select(
        *[F.round(c, 9).alias(c) for c in ("mean", "median", "max", "min")], "wide", "n")


def node_share_events(spark, sf):
    out = report.node_share(runs.node_seconds_long(_visits(spark, sf)))
    return out.select("node", F.round("mean_seconds", 6).alias("mean_seconds"),
                      F.round("percent", 6).alias("percent"))


def arm_table_events(spark, sf):
    rows = event_rows(spark, sf).withColumns({
        "profiler_recall": F.when(F.col("k") > 10, F.col("k") / 100),
        "reviewer_caught": F.col("leakage_caught"), "claimed_holdout_score": F.col("cost_usd")})
    out = report.arm_table(rows, ["dataset_id", "arm"])
    return out.select("dataset_id", "arm", "n", F.round("profiler_recall", 6).alias(
        "profiler_recall"), "reviewer_caught", "leakage_remediated",
        F.round("cost_usd", 6).alias("cost_usd"))


def loop_multiplier_events(spark, sf):
    return report.loop_multiplier(_dataset_rows(spark, sf)).withColumn(
        "multiplier", F.round("multiplier", 6))


def objection_summary_events(spark, sf):
    return report.objection_summary(_dataset_rows(spark, sf).withColumn(
        "n_candidates_failed_to_fit", F.col("k") % 5))


def fired_categories_orders(spark, sf):
    rows = reviewlog.category_counts(objections_of(spark, sf)).join(
        _finals(spark, sf).select("run_id", F.col("final_features").alias(
            "objected_columns_unremediated")), "run_id").withColumns({
                "dataset_id": F.lit("d"), "review_verdict": F.lit("pass"),
                "review_loops": F.lit(1), "errored": F.lit(False)})
    return report.fired_categories(rows).select("run_id", F.array_join(F.array_sort(
        F.map_keys("fired")), ",").alias("fired"))


def membership_rates_orders(spark, sf):
    rows = objections_of(spark, sf).withColumn("only", F.when(
        F.col("target_node") == "modeler", F.col("columns")))
    return report.membership_rates(rows, ["price_low", "status_F", "ghost"], ["columns", "only"])


# ---------------------------------------------------------------- sinks, written and read back


def _folder(spark):
    import uuid

    from auditspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"


def _result_rows(spark, sf):
    rows = load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("dataset_id"),
        F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal") > 5000).alias("leakage_caught"),
        F.array("c_mktsegment", F.lit("b")).alias("leakage_planted"),
        F.create_map(F.lit("modeler"), F.col("c_custkey")).alias("objections_by_target_node"))
    return rows, load(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("run_id"), (F.col("c_nationkey") % 3 > 0).alias("publishable"))


def results_written_customers(spark, sf):
    """Results appended behind the gate and read back, beside the counts that the write observed."""
    rows, gate = _result_rows(spark, sf)
    path = f"{_folder(spark)}/results"
    counts = results.append_results(rows, gate, path)
    return results.read_results(spark, path).groupBy("dataset_id").agg(
        F.count("*").alias("n"), F.count_if("leakage_caught").alias("caught"),
        F.count_if(F.col("leakage_caught").isNull()).alias("ungraded"),
        F.sum(F.col("objections_by_target_node")["modeler"]).alias("keys"),
        F.count_if(F.array_contains("leakage_planted", "b") & F.col("commit").isNull()).alias("typed")).withColumns(
            {k: F.lit(v).cast("bigint") for k, v in counts.items()})


def results_committed_customers(spark, sf):
    """Two annotated batches, the first committed twice; a repeated commit adds no row."""
    rows, gate = _result_rows(spark, sf)
    key = F.col("run_id").cast("bigint")
    plan = rows.select("run_id", F.concat_ws("/", "dataset_id", F.lit("team")).alias("cell"),
                       (key % 4).alias("replicate"), key.alias("run_index"))
    path = f"{_folder(spark)}/dated"
    named = runplan.annotate(rows, "all", "nightly", plan)
    for batch in ("b0", "b1", "b0"):
        results.commit_results(named.where(key % 2 == int(batch[1])), gate, path, day="2024-01-31", batch=batch)
    return results.read_results(spark, path, T.StructType([
        *results.RESULTS, T.StructField("batch", T.StringType()), T.StructField("day", T.StringType())])).groupBy(
            "day", "eval_name", "batch", "cell", "replicate").agg(
            F.count("*").alias("n"), F.sum("run_index").alias("index_sum"))


def metrics_logged_events(spark, sf):
    """Metrics appended in two parts and read as a stream: the newest value's count and sum a name."""
    from auditspark.streaming import logs

    e = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("name"), "value", "event_id")
    folder = _folder(spark)
    for part in (0, 1):
        results.append_metrics(e.where(F.col("event_id") % 2 == part), f"{folder}/metrics")
    live = results.stream_metrics(spark, f"{folder}/metrics").groupBy("run_id", "name").agg(
        F.count("*").alias("n"), F.max("value").alias("largest"))
    logs.write_versions(live, f"{folder}/out", f"{folder}/state", ["run_id", "name"]).awaitTermination()
    return logs.latest_versions(spark, f"{folder}/out", ["run_id", "name"])


def renamed_copy_customers(spark, sf):
    """The opaque copy as written, with only its source columns that are not dropped."""
    df = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = f"{_folder(spark)}/renamed"
    mapping = naming.materialize(df, "c_mktsegment", "opaque", path)
    kept = transform.source_columns(df, "c_mktsegment", ["c_nationkey"], row_id="none")
    return spark.read.parquet(path).select("c_mktsegment", *[mapping[c] for c in kept])


# ---------------------------------------------------------------- streams (rows only)


def stream_tally_events(spark, sf):
    """The events file replayed as a stream; equals the batch tally of the same rows."""
    from auditspark.streaming import logs

    schema = load(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    rows = e.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("dataset_id"),
        F.when(F.col("value") >= 5, F.col("value") >= 60).alias("leakage_caught"))
    live = logs.live_tally(rows, ["leakage_caught"], ["dataset_id"])
    return _replayed(spark, live, ["dataset_id", "metric"])


def stream_tally_within_events(spark, sf):
    """The same tally with every event reported twice and ids kept for a week of event time only."""
    from auditspark.streaming import logs

    e = spark.readStream.schema(load(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    rows = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("dataset_id"),
        F.timestamp_add("HOUR", F.col("again"), F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("value") >= 5, F.col("value") >= 60).alias("leakage_caught"))
    live = logs.live_tally(rows, ["leakage_caught"], ["dataset_id"], at="at")
    return _replayed(spark, live, ["dataset_id", "metric"])


def stream_latest_conversations(spark, sf):
    from auditspark.streaming import logs

    schema = load(spark, sf, "conversations").schema
    c = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parquet*")
    live = logs.live_dispositions(c.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("iteration"),
        F.col("role").alias("disposition")), ["run_id"])
    return _replayed(spark, live, ["run_id"])


def _replayed(spark, live, keys):
    from auditspark.streaming import logs

    folder = _folder(spark)
    logs.write_versions(live, f"{folder}/out", f"{folder}/state", keys).awaitTermination()
    return logs.latest_versions(spark, f"{folder}/out", keys)


QUERIES = {f.__name__: f for f in (
    latest_dispositions_orders, latest_role_conversations, open_conversations,
    verdict_conversations, open_objections_orders, binding_objections_orders,
    binding_columns_orders, dispositions_with_default_orders, projected_open_orders,
    adjudicated_orders, adjudication_report_orders, defaulted_dispositions_orders,
    routed_customers, dead_ends_customers, new_objections_orders, objected_columns_orders,
    category_counts_orders, category_counts_events, rerouted_orders, closure_counts_orders,
    unremediated_orders, route_sequence_customers, halted_events, leakage_rates_orders,
    detector_rates_orders, known_columns_missing, publishable_events, run_cost_events,
    node_seconds_events, node_seconds_map_events, wall_seconds_events, trace_total_events,
    stage_usage_events, loop_exhausted_customers, candidate_table_suppliers,
    candidate_summary_suppliers, results_row_customers, tally_events, wilson_events,
    compare_events, flip_events, compare_means_events, rendered_events, cell_order_events,
    plan_replicate_major, plan_estimate_customers, spend_cap_events, consecutive_failures_events,
    stop_reason_events, cell_tally_events, price_per_cell_events, cost_model_lineitem,
    select_datasets, exclusions_orders, published_best_lineitem, candidate_list_parts,
    schema_drift_events, run_summary_events, dataset_means_events, gap_stats_orders,
    node_share_events, arm_table_events, loop_multiplier_events, objection_summary_events,
    fired_categories_orders, membership_rates_orders, results_written_customers,
    results_committed_customers, metrics_logged_events, renamed_copy_customers, stream_tally_events,
    stream_tally_within_events,
    stream_latest_conversations)}

# ---------------------------------------------------------------- SQL twins

_OPEN = "disposition IS NULL OR disposition NOT IN ('resolved', 'withdrawn')"
_JOINED = f"""WITH {REVIEW}, j AS (SELECT a.*, l.disposition, l.iteration FROM acting a
  LEFT JOIN latest l ON a.run_id = l.run_id AND a.objection_id = l.objection_id)"""
_BOUND = """NOT coalesce(disposition = 'withdrawn' OR (disposition = 'resolved'
  AND forced_drop_release = 'resolved_or_withdrawn'), false)"""
_LONG = """SELECT run_id, objection_id, category, disposition, named AS c FROM j
  UNION ALL SELECT run_id, objection_id, category, disposition, status_name FROM j"""
_FINALS = """fin AS (SELECT c_custkey AS run_id, CASE c_mktsegment WHEN 'MACHINERY' THEN []
    WHEN 'BUILDING' THEN ['price_low', 'status_F'] ELSE ['price_mid', 'status_O'] END AS final
  FROM customer)"""
_CLAIMS = """cl AS (SELECT c_custkey AS run_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'pass'
    WHEN c_mktsegment <> 'MACHINERY' THEN 'block' END AS claim, c_nationkey % 4 AS it
  FROM customer)"""
_TURNS = """t AS (SELECT conv_id AS run_id, conv_id AS objection_id, turn AS iteration,
    CASE role WHEN 'user' THEN 'still_open' WHEN 'assistant' THEN 'resolved'
      ELSE 'not_reviewed' END AS disposition FROM conversations),
  lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id
    ORDER BY iteration DESC, disposition DESC) AS rn FROM t) WHERE rn = 1)"""
_VISITS = """v AS (SELECT user_id AS run_id, event_type AS node, event_id, value,
    CASE WHEN event_type <> 'error' THEN floor(value * 100) * 10000 / 1e6 END AS seconds,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(day(ts) AS BIGINT) AS visit
  FROM events)"""
_GRADED = f"""{_JOINED}, {_FINALS}, lo AS ({_LONG}),
  fl AS (SELECT run_id, list_sort(list(DISTINCT c)) AS flagged FROM lo
         WHERE category IN ('leakage', 'contamination') GROUP BY 1),
  sd AS (SELECT run_id, list_sort(list(DISTINCT c)) AS standing FROM lo
         WHERE category IN ('leakage', 'contamination') AND ({_OPEN}) GROUP BY 1),
  gr AS (SELECT r.run_id, CASE WHEN c_acctbal > 1000 THEN ['price_high', 'status_F'] ELSE [] END
           AS planted, final, flagged AS raw_flagged, coalesce(flagged, []) AS flagged,
           coalesce(standing, []) AS standing, c_mktsegment, c_acctbal
         FROM runs r JOIN fin ON r.run_id = fin.run_id LEFT JOIN fl ON r.run_id = fl.run_id
         LEFT JOIN sd ON r.run_id = sd.run_id)"""
_OUT = """oc AS (SELECT event_id AS seq, value AS cost, event_type = 'error' AS failed,
    user_id, event_type, CASE WHEN event_type = 'error' THEN 60.0 ELSE value END AS charge
  FROM events)"""


def _wilson_sql(s: str, n: str, bound: str) -> str:
    z = 1.96
    sign, edge, pick = ("-", "0.0", "greatest") if bound == "low" else ("+", "1.0", "least")
    return f"""CASE WHEN {n} > 0 THEN {pick}({edge}, ({s} / {n} + {z * z} / (2.0 * {n}) {sign}
      {z} * sqrt(({s} / {n}) * (1 - {s} / {n}) / {n} + {z * z} / (4.0 * {n} * {n})))
      / (1 + {z * z} / {n})) ELSE {edge} END"""


def _metric_union(rel: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset_id, arm, replicate, ts, '{m}' AS metric, {e} AS ok FROM {rel}"
        for m, e in (("leakage_remediated", "leakage_remediated"),
                     ("leakage_caught", "leakage_caught"), ("errored", "errored"),
                     ("halted_at:notnull", "halted_at IS NOT NULL")))


_COMPARED = f"""WITH {EVENT_ROWS}, m AS ({_metric_union('ev')}),
  sided AS (SELECT *, CASE WHEN day(ts) <= 15 THEN 'b' ELSE 'a' END AS side FROM m
    WHERE NOT (day(ts) <= 15 AND dataset_id = 'signup' AND arm IS NULL)
      AND NOT (day(ts) > 15 AND dataset_id = 'view' AND coalesce(arm, '') = 'team')),
  rep AS (SELECT dataset_id, arm, metric, side, replicate, count(*) FILTER (WHERE ok) AS s,
            count(ok) AS n, count(*) - count(ok) AS x FROM sided GROUP BY ALL),
  ct AS (SELECT dataset_id, arm, metric, side, CAST(sum(s) AS BIGINT) AS s,
           CAST(sum(n) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS x,
           count(*) FILTER (WHERE n > 0) AS r FROM rep GROUP BY ALL),
  k AS (SELECT DISTINCT dataset_id, arm, metric FROM ct),
  cmp AS (SELECT k.dataset_id, k.arm, k.metric, b.s AS bs, b.n AS bn, b.x AS bx, b.r AS br,
            a.s AS as_, a.n AS an, a.x AS ax, a.r AS ar,
            {_wilson_sql('b.s', 'b.n', 'low')} AS bl, {_wilson_sql('b.s', 'b.n', 'high')} AS bh,
            {_wilson_sql('a.s', 'a.n', 'low')} AS al, {_wilson_sql('a.s', 'a.n', 'high')} AS ah
          FROM k LEFT JOIN ct b ON b.dataset_id IS NOT DISTINCT FROM k.dataset_id
              AND b.arm IS NOT DISTINCT FROM k.arm AND b.metric = k.metric AND b.side = 'b'
            LEFT JOIN ct a ON a.dataset_id IS NOT DISTINCT FROM k.dataset_id
              AND a.arm IS NOT DISTINCT FROM k.arm AND a.metric = k.metric AND a.side = 'a'),
  vd AS (SELECT *, CASE WHEN bs IS NULL THEN 'after' WHEN as_ IS NULL THEN 'before' END AS only_in,
      CASE WHEN bs IS NULL THEN 'only in after' WHEN as_ IS NULL THEN 'only in before'
        WHEN br < 2 OR ar < 2 THEN 'underpowered' WHEN ah < bl OR bh < al THEN 'separates'
        ELSE 'not separating' END AS verdict,
      coalesce(metric IN ('leakage_remediated', 'leakage_caught') AND bn > 0 AND an > 0
        AND (2 * bs >= bn) <> (2 * as_ >= an), false) AS flipped FROM cmp)"""

_KEYED = "count(*) AS n"
ORACLES = {
    "latest_dispositions_orders": f"""WITH {DISPOSITIONS}, {LATEST}
      SELECT run_id, objection_id, disposition, CAST(iteration AS BIGINT) AS iteration
      FROM latest""",
    "latest_role_conversations": f"""WITH {_TURNS} SELECT run_id, objection_id, disposition,
      iteration FROM lt""",
    "open_conversations": f"""WITH {_TURNS} SELECT lt.run_id, lt.objection_id, turns FROM lt
      JOIN (SELECT run_id, count(*) AS turns FROM t GROUP BY 1) c ON lt.run_id = c.run_id
      WHERE disposition <> 'resolved'""",
    "verdict_conversations": """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'pending'
      WHEN role = 'assistant' THEN 'pass' WHEN turn + 1 >= 3 THEN 'exhausted' ELSE 'block' END
      AS verdict FROM conversations""",
    "open_objections_orders": f"""{_JOINED} SELECT acting_node, category, count(*) AS n FROM j
      WHERE {_OPEN} GROUP BY 1, 2""",
    "binding_objections_orders": f"""{_JOINED} SELECT category, forced_drop_release,
      count(*) AS n FROM j WHERE acting_node = 'feature_eng' AND {_BOUND} GROUP BY 1, 2""",
    "binding_columns_orders": f"""{_JOINED}, b AS (SELECT * FROM j WHERE {_BOUND}
        AND category IN {SCOPED}), c AS (SELECT DISTINCT run_id, named AS "column" FROM b
        UNION SELECT DISTINCT run_id, status_name FROM b)
      SELECT "column", count(*) AS runs FROM c GROUP BY 1""",
    "dispositions_with_default_orders": f"""{_JOINED} SELECT CASE WHEN iteration <= 5
        THEN disposition ELSE 'not_reviewed' END AS disposition, count(*) AS n FROM j GROUP BY 1""",
    "projected_open_orders": f"""{_JOINED}, o AS (SELECT category, acting_node FROM j
        WHERE disposition IS NULL OR disposition NOT IN ('resolved', 'withdrawn')
        UNION ALL SELECT category, acting_node FROM j WHERE category = 'other')
      SELECT category, count(*) AS n FROM o WHERE acting_node = 'modeler' GROUP BY 1""",
    "adjudicated_orders": f"""WITH {OBJECTIONS}, a AS (SELECT category,
        CASE WHEN named = 'price_mid' THEN 1 ELSE 0 END
          + CASE WHEN status_name = 'status_O' THEN 1 ELSE 0 END AS kept FROM objections)
      SELECT category, category IN {SCOPED} AND kept = 0 AS rejected, count(*) AS n,
        CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(2 - kept) AS BIGINT) AS dropped
      FROM a GROUP BY 1, 2""",
    "adjudication_report_orders": f"""WITH {OBJECTIONS}, d AS (
        SELECT run_id, named AS c FROM objections WHERE named <> 'price_mid'
        UNION SELECT run_id, status_name FROM objections WHERE status_name <> 'status_O')
      SELECT o.run_id, count(*) AS proposals, count(*) FILTER (WHERE category IN {SCOPED}
          AND named <> 'price_mid' AND status_name <> 'status_O') AS rejected,
        (SELECT string_agg(c, ',' ORDER BY c) FROM d WHERE d.run_id = o.run_id) AS dropped
      FROM objections o GROUP BY 1""",
    "defaulted_dispositions_orders": f"""{_JOINED} SELECT CASE WHEN disposition = 'still_open'
        THEN 'still_open' ELSE 'not_reviewed' END AS disposition, count(*) AS n FROM j
      WHERE {_OPEN} GROUP BY 1""",
    "routed_customers": f"""{_JOINED}, {_CLAIMS}, o AS (SELECT run_id,
        CASE WHEN bool_or(acting_node = 'feature_eng') THEN 'feature_eng' ELSE 'modeler' END AS d
        FROM j WHERE category = 'leakage' AND ({_OPEN}) GROUP BY 1),
      w AS (SELECT cl.run_id, d, CASE WHEN claim IS NULL THEN 'pending' WHEN claim = 'pass'
          THEN 'pass' WHEN it + 1 >= 3 THEN 'exhausted' ELSE 'block' END AS verdict
        FROM cl LEFT JOIN o ON cl.run_id = o.run_id)
      SELECT run_id, verdict, CASE WHEN verdict = 'block' THEN coalesce(d, 'reporter')
        ELSE 'reporter' END AS routed_to, verdict = 'block' AND d IS NULL AS dead_end FROM w""",
    "dead_ends_customers": f"""{_JOINED}, {_CLAIMS} SELECT run_id FROM cl WHERE claim = 'block'
      AND run_id NOT IN (SELECT run_id FROM j WHERE category = 'leakage' AND ({_OPEN}))""",
    "new_objections_orders": """SELECT o.o_custkey AS run_id,
        CAST(year(o.o_orderdate) - 1992 AS BIGINT) AS iteration, count(*) AS n
      FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey
        AND p.o_orderstatus = 'F' AND year(p.o_orderdate) = year(o.o_orderdate))
      GROUP BY 1, 2""",
    "objected_columns_orders": f"""{_JOINED}, lo AS ({_LONG}),
      ev AS (SELECT run_id, string_agg(DISTINCT c, ',' ORDER BY c) AS ever FROM lo
             WHERE category IN {SCOPED} GROUP BY 1),
      st AS (SELECT run_id, string_agg(DISTINCT c, ',' ORDER BY c) AS still FROM lo
             WHERE category IN ('leakage', 'contamination') AND ({_OPEN}) GROUP BY 1)
      SELECT ev.run_id, ever, still FROM ev LEFT JOIN st ON ev.run_id = st.run_id""",
    "category_counts_orders": f"WITH {OBJECTIONS} SELECT run_id, " + ", ".join(
        f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in vocab.CATEGORIES)
    + " FROM objections GROUP BY 1",
    "category_counts_events": "SELECT user_id AS run_id, " + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{c}') AS \"{c}\"" for c in (
            "view", "click", "purchase", "signup", "error", "refund")) + " FROM events GROUP BY 1",
    "rerouted_orders": f"""WITH {RUNS}, {OBJECTIONS}, acting AS (SELECT o.*,
        r.objection_routing = 'by_category' AND category IN {SCOPED}
          AND target_node <> 'feature_eng' AS moved
        FROM objections o LEFT JOIN runs r ON o.run_id = r.run_id)
      SELECT run_id, count(*) FILTER (WHERE moved) AS objections_rerouted,
        count(*) FILTER (WHERE target_node = 'modeler') AS modeler,
        count(*) FILTER (WHERE target_node = 'feature_eng') AS feature_eng
      FROM acting GROUP BY 1""",
    "closure_counts_orders": f"""{_JOINED}, {_FINALS}
      SELECT j.run_id, count(*) FILTER (WHERE disposition = 'resolved') AS objections_resolved,
        count(*) FILTER (WHERE disposition = 'withdrawn') AS objections_withdrawn,
        CASE WHEN bool_or(len(final) > 0) THEN count(*) FILTER (WHERE disposition = 'resolved'
          AND category IN {SCOPED} AND (list_contains(final, named)
          OR list_contains(final, status_name))) END AS objections_falsely_resolved
      FROM j LEFT JOIN fin ON j.run_id = fin.run_id WHERE disposition IS NOT NULL GROUP BY 1""",
    "unremediated_orders": f"""{_JOINED}, {_FINALS}, lo AS ({_LONG}), d AS (
        SELECT DISTINCT run_id, c FROM lo WHERE category IN {SCOPED})
      SELECT fin.run_id, CASE WHEN len(any_value(final)) > 0 THEN
        coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE list_contains(final, c)), '') END
        AS unremediated FROM fin LEFT JOIN d ON fin.run_id = d.run_id GROUP BY 1""",
    "route_sequence_customers": """WITH p AS (SELECT o_custkey AS run_id, year(o_orderdate) AS y,
        min(o_orderstatus) AS r, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1, 2)
      SELECT run_id, string_agg(r, ',' ORDER BY y) AS route_sequence,
        string_agg(CAST(k AS VARCHAR), ',' ORDER BY y) AS new_per_pass FROM p GROUP BY 1""",
    "halted_events": """WITH e AS (SELECT user_id AS run_id, event_id, json_extract_string(props,
        '$.k') AS node, event_type = 'error' AND value > 60 AS fatal FROM events
        WHERE event_type IN ('error', 'signup'))
      SELECT run_id, arg_min(node, event_id) FILTER (WHERE fatal) AS halted_at,
        bool_or(fatal) AS halted, true AS errored FROM e GROUP BY 1""",
    "leakage_rates_orders": f"""{_GRADED}, g AS (SELECT *, len(planted) > 0 AS ok,
        len(list_intersect(flagged, planted)) AS hit,
        list_sort(list_filter(flagged, lambda x: NOT list_contains(planted, x))) AS wrong FROM gr)
      SELECT run_id, ok AS leakage_graded, array_to_string(planted, ',') AS leakage_planted,
        array_to_string(flagged, ',') AS leakage_flagged,
        CASE WHEN ok THEN hit > 0 END AS leakage_caught,
        CASE WHEN ok AND len(final) > 0 THEN len(list_intersect(planted, final)) = 0 END
          AS leakage_remediated,
        CASE WHEN ok THEN round(hit / len(planted), 6) END AS leakage_recall,
        CASE WHEN ok AND len(flagged) > 0 THEN round(hit / len(flagged), 6) END
          AS leakage_precision,
        CASE WHEN ok THEN array_to_string(wrong, ',') END AS false_alarm_columns,
        CASE WHEN ok THEN CAST(len(wrong) AS BIGINT) END AS false_alarm,
        array_to_string(standing, ',') AS leakage_flagged_standing,
        CASE WHEN ok THEN CAST(len(list_filter(standing, lambda x: NOT list_contains(planted, x)))
          AS BIGINT) END AS false_alarm_standing FROM g""",
    "detector_rates_orders": f"""{_GRADED}, g AS (SELECT *, len(planted) > 0
          AND c_mktsegment <> 'FURNITURE' AS ok, c_mktsegment <> 'FURNITURE' AS ran,
        len(list_intersect(flagged, planted)) AS hit FROM gr)
      SELECT run_id, CASE WHEN ran THEN array_to_string(flagged, ',') END AS profiler_nominated,
        CASE WHEN ok THEN hit > 0 END AS profiler_caught,
        CASE WHEN ok THEN round(hit / len(planted), 6) END AS profiler_recall,
        CASE WHEN ok THEN CAST(len(list_filter(flagged, lambda x: NOT list_contains(planted, x)))
          AS BIGINT) END AS profiler_false_alarm FROM g""",
    "known_columns_missing": "SELECT 'ghost_' || n_name AS \"column\" FROM nation "
                             "WHERE n_regionkey >= 2",
    "publishable_events": """WITH t AS (SELECT user_id, bool_or(event_type = 'signup'
        AND value > 150) AS stubbed FROM events GROUP BY 1)
      SELECT c_custkey AS run_id, coalesce(NOT stubbed, false) AS publishable,
        CASE WHEN stubbed IS NULL THEN 'empty trace' WHEN stubbed
          THEN 'placeholder model in trace' END AS reason
      FROM customer LEFT JOIN t ON c_custkey = user_id""",
    "run_cost_events": """WITH u AS (SELECT user_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, trunc(value * 10) AS o,
        CASE event_type WHEN 'view' THEN 1.0 WHEN 'signup' THEN 1.0 WHEN 'click' THEN 3.0
          ELSE 5.0 END AS p FROM events)
      SELECT user_id AS run_id, CAST(round(sum((i * p + o * p * 5) / 1e6), 9) AS DOUBLE) AS cost_usd
      FROM u GROUP BY 1""",
    "node_seconds_events": f"""WITH {_VISITS} SELECT run_id, node, round(sum(seconds), 3)
      AS seconds FROM v WHERE seconds IS NOT NULL GROUP BY 1, 2""",
    "node_seconds_map_events": f"""WITH {_VISITS} SELECT run_id, count(DISTINCT node) AS nodes,
      round(sum(seconds) FILTER (WHERE node = 'click'), 3) AS click
      FROM v WHERE seconds IS NOT NULL GROUP BY 1""",
    "wall_seconds_events": """SELECT user_id AS run_id, CASE WHEN max(value) < 300 THEN
        round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) END AS wall_seconds
      FROM events GROUP BY 1""",
    "trace_total_events": f"""WITH {_VISITS} SELECT run_id, node, CAST(sum(k) AS BIGINT)
        AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens,
        round(sum(value), 4) AS cost_usd, node IS NULL AS is_total
      FROM v GROUP BY GROUPING SETS ((run_id, node), (run_id))""",
    "stage_usage_events": f"""WITH {_VISITS} SELECT run_id, node, visit, CAST(sum(k) AS BIGINT)
        AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens,
        round(sum(value), 4) AS cost_usd, CAST(arg_max(k, event_id) AS VARCHAR) AS model
      FROM v GROUP BY 1, 2, 3""",
    "loop_exhausted_customers": f"WITH {_CLAIMS} SELECT run_id, it >= 3 AS exhausted FROM cl",
    "candidate_table_suppliers": """SELECT s_nationkey AS run_id, s_name AS name,
      CASE WHEN s_acctbal > 0 THEN round((s_acctbal + s_acctbal / 2) / 2, 6) END AS cv_mean,
      s_acctbal AS claimed_holdout_score, CASE WHEN s_acctbal <= 0
        THEN 'ValueError: balance ' || CAST(s_acctbal AS VARCHAR) ELSE '' END AS note
      FROM supplier""",
    "candidate_summary_suppliers": """SELECT s_nationkey AS run_id, count(*) AS n_candidates,
      count(*) FILTER (WHERE s_acctbal <= 0) AS n_candidates_failed_to_fit,
      coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal <= 0), '')
        AS candidates_failed_to_fit FROM supplier GROUP BY 1""",
    "tally_events": f"""WITH {EVENT_ROWS}, m AS ({_metric_union('ev')}),
      rep AS (SELECT dataset_id, arm, metric, replicate, count(*) FILTER (WHERE ok) AS s,
        count(ok) AS n, count(*) - count(ok) AS x FROM m GROUP BY ALL),
      t AS (SELECT dataset_id, arm, metric, CAST(sum(s) AS BIGINT) AS successes,
        CAST(sum(n) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS excluded,
        count(*) FILTER (WHERE n > 0) AS replicates,
        coalesce(string_agg(s || '/' || n, ' ' ORDER BY replicate) FILTER (WHERE n > 0), '')
          AS per_replicate FROM rep GROUP BY ALL)
      SELECT *, round({_wilson_sql('successes', 'n', 'low')}, 6) AS low,
        round({_wilson_sql('successes', 'n', 'high')}, 6) AS high FROM t""",
    "wilson_events": f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase')
        AS s, count(*) AS n FROM events GROUP BY 1)
      SELECT user_id, s, n, round({_wilson_sql('s', 'n', 'low')}, 6) AS low,
        round({_wilson_sql('s', 'n', 'high')}, 6) AS high FROM c""",
    "compare_events": f"""{_COMPARED} SELECT dataset_id, arm, metric, only_in, verdict, flipped,
      bs AS before_successes, bn AS before_n, bx AS before_excluded, br AS before_replicates,
      as_ AS after_successes, an AS after_n, ax AS after_excluded, ar AS after_replicates,
      CASE WHEN bs IS NOT NULL THEN round(bl, 6) END AS before_low,
      CASE WHEN bs IS NOT NULL THEN round(bh, 6) END AS before_high,
      CASE WHEN as_ IS NOT NULL THEN round(al, 6) END AS after_low,
      CASE WHEN as_ IS NOT NULL THEN round(ah, 6) END AS after_high FROM vd""",
    "flip_events": f"""WITH e AS (SELECT user_id, day(ts) <= 15 AS b, day(ts) % 7 AS r,
        value > 40 AS ok FROM events),
      t AS (SELECT CAST(user_id AS VARCHAR) AS dataset_id,
        count(*) FILTER (WHERE b AND ok) AS bs, count(*) FILTER (WHERE b) AS bn,
        count(DISTINCT r) FILTER (WHERE b) AS br, count(*) FILTER (WHERE NOT b AND ok) AS as_,
        count(*) FILTER (WHERE NOT b) AS an, count(DISTINCT r) FILTER (WHERE NOT b) AS ar
        FROM e GROUP BY 1)
      SELECT dataset_id, CASE WHEN bn = 0 THEN 'only in after' WHEN an = 0 THEN 'only in before'
          WHEN br < 2 OR ar < 2 THEN 'underpowered'
          WHEN {_wilson_sql('as_', 'an', 'high')} < {_wilson_sql('bs', 'bn', 'low')}
            OR {_wilson_sql('bs', 'bn', 'high')} < {_wilson_sql('as_', 'an', 'low')}
          THEN 'separates' ELSE 'not separating' END AS verdict,
        bn > 0 AND an > 0 AND (2 * bs >= bn) <> (2 * as_ >= an) AS flipped FROM t""",
    "compare_means_events": f"""WITH {EVENT_ROWS}, s AS (SELECT *, day(ts) <= 15 AS b FROM ev
        WHERE NOT (day(ts) <= 15 AND dataset_id = 'signup' AND arm IS NULL)
          AND NOT (day(ts) > 15 AND dataset_id = 'view' AND coalesce(arm, '') = 'team'))
      SELECT dataset_id, arm, 'cost_usd' AS "column",
        round(avg(cost_usd) FILTER (WHERE b), 6) AS before,
        round(avg(cost_usd) FILTER (WHERE NOT b), 6) AS after FROM s GROUP BY 1, 2
      UNION ALL SELECT dataset_id, arm, 'k', round(avg(k) FILTER (WHERE b), 6),
        round(avg(k) FILTER (WHERE NOT b), 6) FROM s GROUP BY 1, 2""",
    "rendered_events": f"""{_COMPARED} SELECT concat_ws(' ', 'dataset_id=' || dataset_id,
        'arm=' || arm) AS cell, metric, CASE WHEN verdict = 'separates'
        THEN 'separates at this n' ELSE verdict END AS verdict, flipped FROM vd""",
    "cell_order_events": f"""WITH {EVENT_ROWS} SELECT arm, CAST(replicate AS VARCHAR) AS replicate,
      count(*) AS n, row_number() OVER (ORDER BY arm NULLS FIRST, CAST(replicate AS VARCHAR)
        NULLS FIRST) - 1 AS position FROM ev GROUP BY 1, 2""",
    "plan_replicate_major": """SELECT n_name AS cell, r AS replicate, i AS run_index,
      row_number() OVER (ORDER BY r, n_nationkey, i) - 1 AS seq
      FROM nation, (SELECT unnest(range(1, 4)) AS r), (SELECT unnest(range(4)) AS i)""",
    "plan_estimate_customers": """SELECT count(*) * 4 AS runs,
      round(4 * sum(c_nationkey / 1000), 6) AS estimated_usd FROM customer""",
    "spend_cap_events": f"""WITH {_OUT}, w AS (SELECT *, sum(charge) OVER (ORDER BY seq) - charge
        AS spent FROM oc)
      SELECT CAST(cap AS DOUBLE) AS cap, min(seq) FILTER (WHERE spent + 60 > cap) AS seq,
        round(arg_min(spent, seq) FILTER (WHERE spent + 60 > cap), 4) AS spent
      FROM w, (VALUES (1e3), (1e5), (1e12)) c(cap) GROUP BY cap""",
    "consecutive_failures_events": f"""WITH {_OUT}, g AS (SELECT *,
        seq - row_number() OVER (PARTITION BY failed ORDER BY seq) AS island FROM oc),
      p AS (SELECT seq, row_number() OVER (PARTITION BY island ORDER BY seq) AS nth FROM g
            WHERE failed)
      SELECT CAST(k AS BIGINT) AS length, min(seq) FILTER (WHERE nth >= k) AS seq
      FROM p, (VALUES (2), (3), (4)) v(k) GROUP BY k""",
    "stop_reason_events": f"""WITH {_OUT}, w AS (SELECT *, sum(charge) OVER (ORDER BY seq) - charge
          AS spent, seq - row_number() OVER (PARTITION BY failed ORDER BY seq) AS island FROM oc),
      f AS (SELECT min(seq) AS f FROM (SELECT seq, row_number() OVER (PARTITION BY island
              ORDER BY seq) AS nth FROM w WHERE failed) WHERE nth >= 3),
      c AS (SELECT cap, min(seq) FILTER (WHERE spent + 60 > cap) AS c
            FROM w, (VALUES (1e3), (1e5), (1e12)) v(cap) GROUP BY cap)
      SELECT CAST(cap AS DOUBLE) AS cap, CASE WHEN c IS NOT NULL AND (f IS NULL OR c <= f)
          THEN 'cost cap' WHEN f IS NOT NULL THEN 'consecutive failures' END AS stopped_early,
        CASE WHEN c IS NOT NULL AND (f IS NULL OR c <= f) THEN c WHEN f IS NOT NULL THEN f + 1
          ELSE (SELECT count(*) FROM oc) END AS ran FROM c, f""",
    "cell_tally_events": """SELECT CAST(c_custkey AS VARCHAR) AS cell,
        count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS rows_written,
        count(*) FILTER (WHERE event_type = 'signup') AS rows_refused,
        count(*) FILTER (WHERE event_type = 'error') AS runs_failed,
        CAST(round(coalesce(sum(CASE WHEN event_type = 'error' THEN 60.0 ELSE value END), 0), 4)
          AS DOUBLE) AS spend_usd,
        CAST(coalesce(sum(60.0) FILTER (WHERE event_type = 'error'), 0) AS DOUBLE)
          AS charged_estimate_usd,
        count(*) FILTER (WHERE event_type NOT IN ('error', 'signup') AND value > 50)
          AS leakage_remediated,
        count(*) FILTER (WHERE event_type NOT IN ('error', 'signup') AND value > 90) AS errored
      FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1""",
    "price_per_cell_events": """SELECT event_type AS cell,
      ceil(round(avg(value / 1000) * 1000, 6)) / 1000.0 AS est_cost_usd FROM events GROUP BY 1""",
    "cost_model_lineitem": """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my,
        avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS v1,
        var_pop(l_discount) AS v2, var_pop(l_extendedprice) AS vy,
        covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_quantity, l_extendedprice) AS c1y,
        covar_pop(l_discount, l_extendedprice) AS c2y FROM lineitem),
      f AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b,
        (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS c FROM s)
      SELECT n, round(my - b * m1 - c * m2, 3) AS a, round(b, 3) AS b, round(c, 3) AS c,
        round(sqrt((vy - b * c1y - c * c2y) * n / (n - 3)), 3) AS residual_sd FROM f""",
    "published_best_lineitem": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_partkey
        ORDER BY l_extendedprice DESC, l_orderkey, l_returnflag DESC) AS rn FROM lineitem
        WHERE l_quantity > 3)
      SELECT p.l_partkey AS task_id, e.l_orderkey AS run_id, e.l_returnflag AS flow_name,
        round(e.l_extendedprice, 6) AS value
      FROM (SELECT DISTINCT l_partkey FROM lineitem) p
      LEFT JOIN e ON p.l_partkey = e.l_partkey AND rn = 1""",
    "candidate_list_parts": """SELECT s_name AS name, s_suppkey AS task_id FROM supplier
      UNION ALL SELECT p_name, p_partkey FROM part""",
    "schema_drift_events": """WITH e AS (SELECT event_type AS file, CASE WHEN value > 200
        THEN 'big' ELSE 'k' END AS key FROM events)
      SELECT file, count(*) AS n_rows, count(DISTINCT key) AS n_columns,
        CAST(2 - count(DISTINCT key) FILTER (WHERE key = 'k') AS BIGINT) AS n_missing,
        CASE WHEN bool_or(key = 'big') THEN 'big' ELSE '' END AS extra FROM e GROUP BY 1""",
    "run_summary_events": f"""WITH {EVENT_ROWS} SELECT count(*) AS runs,
      round(sum(cost_usd), 4) AS cost_usd, round(sum(cost_usd * 2) / 60, 4) AS wall_minutes,
      count(DISTINCT dataset_id) AS commits,
      count(DISTINCT coalesce(arm, '') || '|' || dataset_id) AS configurations,
      count(halted_at) AS halted FROM ev""",
    "dataset_means_events": f"""WITH {EVENT_ROWS} SELECT dataset_id,
      round(avg(cost_usd), 6) AS cost_usd, round(avg(k), 6) AS k,
      count(*) FILTER (WHERE k % 2 > 0) AS objecting_runs, count(*) AS runs,
      count(*) FILTER (WHERE k % 3 = 0) AS one_loop FROM ev GROUP BY 1""",
    "gap_stats_orders": """WITH g AS (SELECT o_totalprice / 1e7 - 0.02 AS g FROM orders)
      SELECT round(avg(g), 9) AS mean, round(median(g), 9) AS median, round(max(g), 9) AS max,
        round(min(g), 9) AS min, count(*) FILTER (WHERE abs(g) > 0.02) AS wide, count(g) AS n
      FROM g""",
    "node_share_events": f"""WITH {_VISITS}, t AS (SELECT run_id, node, round(sum(seconds), 3) AS s
        FROM v WHERE seconds IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT node, avg(s) AS m FROM t GROUP BY 1)
      SELECT node, round(m, 6) AS mean_seconds, round(100 * m / sum(m) OVER (), 6) AS percent
      FROM m""",
    "arm_table_events": f"""WITH {EVENT_ROWS} SELECT dataset_id, arm, count(*) AS n,
      round(avg(CASE WHEN k > 10 THEN k / 100 END), 6) AS profiler_recall,
      count(*) FILTER (WHERE leakage_caught) AS reviewer_caught,
      count(*) FILTER (WHERE leakage_remediated) AS leakage_remediated,
      round(avg(cost_usd), 6) AS cost_usd FROM ev GROUP BY 1, 2""",
    "loop_multiplier_events": f"""WITH {EVENT_ROWS}, l AS (SELECT *, k % 3 + 1 AS loops FROM ev),
      r AS (SELECT loops, dataset_id, cost_usd / avg(CASE WHEN loops = 1 THEN cost_usd END)
              OVER (PARTITION BY dataset_id) AS mult FROM l)
      SELECT loops AS review_loops, count(*) AS n, round(avg(mult), 6) AS multiplier,
        count(DISTINCT dataset_id) AS datasets FROM r GROUP BY 1""",
    "objection_summary_events": f"""WITH {EVENT_ROWS} SELECT CAST(sum(k % 2) AS BIGINT)
        AS objections, count(*) FILTER (WHERE k % 2 > 0) AS objecting_runs, count(*) AS runs,
      count(DISTINCT dataset_id) FILTER (WHERE k % 2 > 0) AS datasets,
      count(*) FILTER (WHERE errored) AS errored,
      count(*) FILTER (WHERE k % 5 > 0) AS fit_failures FROM ev""",
    "fired_categories_orders": f"""WITH {OBJECTIONS}, {_FINALS} SELECT o.run_id,
      string_agg(DISTINCT category, ',' ORDER BY category) AS fired
      FROM objections o JOIN fin ON o.run_id = fin.run_id WHERE len(final) > 0 GROUP BY 1""",
    "membership_rates_orders": f"WITH {OBJECTIONS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE named = '{c}'
          OR status_name = '{c}') AS columns, count(*) FILTER (WHERE (named = '{c}'
          OR status_name = '{c}') AND target_node = 'modeler') AS only, {_KEYED}
          FROM objections""" for c in ("price_low", "status_F", "ghost")),
    "stream_latest_conversations": """SELECT conv_id AS run_id,
      arg_max(role, turn) AS disposition, max(turn) AS iteration FROM conversations GROUP BY 1""",
    "stream_tally_events": f"""WITH e AS (SELECT event_type AS dataset_id, 'leakage_caught'
        AS metric, count(*) FILTER (WHERE value >= 60) AS successes,
        count(*) FILTER (WHERE value >= 5) AS n, count(*) FILTER (WHERE NOT value >= 5)
          AS excluded FROM events GROUP BY 1)
      SELECT *, {_wilson_sql('successes', 'n', 'low')} AS low,
        {_wilson_sql('successes', 'n', 'high')} AS high FROM e""",
}

_PUBLISHED = """res AS (SELECT c_custkey AS run_id, c_mktsegment AS dataset_id,
    CASE WHEN c_acctbal > 1000 THEN c_acctbal > 5000 END AS caught FROM customer WHERE c_nationkey % 3 > 0)"""
ORACLES["results_written_customers"] = f"""WITH {_PUBLISHED} SELECT dataset_id, count(*) AS n,
    count(*) FILTER (WHERE caught) AS caught, count(*) FILTER (WHERE caught IS NULL) AS ungraded,
    CAST(sum(run_id) AS BIGINT) AS keys, count(*) AS typed, (SELECT count(*) FROM res) AS written,
    (SELECT count(*) FROM customer) - (SELECT count(*) FROM res) AS refused FROM res GROUP BY 1"""
ORACLES["results_committed_customers"] = f"""WITH {_PUBLISHED} SELECT '2024-01-31' AS day, 'nightly' AS eval_name,
    'b' || (run_id % 2) AS batch, dataset_id || '/team' AS cell, CAST(run_id % 4 AS BIGINT) AS replicate,
    count(*) AS n, CAST(sum(run_id) AS BIGINT) AS index_sum FROM res GROUP BY ALL"""
ORACLES["metrics_logged_events"] = """SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS name,
    count(*) AS n, CAST(max(value) AS DOUBLE) AS largest FROM events GROUP BY 1, 2"""
ORACLES["renamed_copy_customers"] = """SELECT c_mktsegment, c_custkey AS var_01, c_acctbal AS var_03 FROM customer"""
ORACLES["stream_tally_within_events"] = ORACLES["stream_tally_events"]

_SELECTED = """ms AS (SELECT 'd' || o_custkey AS dataset_id, 'D' || o_custkey AS name,
    CAST(floor(sum(o_totalprice) / 25) AS BIGINT) AS n_rows, count(*) * 14 AS n_features,
    count(*) AS usable FROM orders GROUP BY o_custkey),
  fr AS (SELECT *, CASE WHEN usable > 18 THEN 'task_type' WHEN n_rows > 150000 THEN 'max_rows'
      WHEN n_features > 200 THEN 'max_features' WHEN n_rows * n_features > 8000000 THEN 'max_cells'
      WHEN usable < 5 THEN 'min_usable_features' END AS rule FROM ms),
  sl AS (SELECT *, CASE WHEN rule IS NULL AND row_number() OVER (PARTITION BY rule
      ORDER BY n_rows * n_features, dataset_id) > 15 THEN 'target_count' ELSE rule END AS failed
    FROM fr)"""
ORACLES["select_datasets"] = f"WITH {_SELECTED} SELECT dataset_id, failed FROM sl"
_EXACT = _SELECTED.replace("floor(sum(o_totalprice) / 25)", "sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 2500")
ORACLES["exclusions_orders"] = (
    f"WITH {_EXACT} SELECT name, failed, n_rows FROM sl WHERE failed IS NOT NULL")
