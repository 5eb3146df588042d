"""Queries over splits, transforms, metrics, models and planted leaks."""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.operators import grading, inject, metrics, models, profile, split, transform
from auditspark.operators.grading import Task
from auditspark.operators.split import SplitSpec
from auditspark.queries.common import (
    CUSTOMERS, LABELLED, ORDERS, customers, labelled, load, orders, sql_double_text, sql_draw, sql_nmi,
)

# ---------------------------------------------------------------- splits


def withhold_labelled(spark, sf):
    return split.withhold(labelled(spark, sf), "quality", 0.2).select(
        "row_id", "quality", "withheld")


def withhold_orders_counts(spark, sf):
    flagged = split.withhold(orders(spark, sf), "o_orderpriority", 0.1)
    return flagged.groupBy("o_orderpriority", "withheld").agg(F.count("*").alias("n"))


def withheld_partition_customer(spark, sf):
    """Both sides of the carve are disjoint and together equal the source, value for value."""
    df = customers(spark, sf)
    agent, held = split.partition(split.withhold(df, "c_mktsegment", 0.2))
    from auditspark.sources.fingerprint import table_fingerprint

    both = table_fingerprint(agent.unionByName(held)).withColumn("part", F.lit("union"))
    shared = split.row_overlap(agent, held).agg(
        F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("xor_head"),
        F.lit(0).cast("bigint").alias("sum_tail")).withColumn("part", F.lit("shared"))
    return both.unionByName(shared)


def pin_split_orders(spark, sf):
    return split.pin_split(orders(spark, sf), "o_orderstatus")


def pin_split_random_labelled(spark, sf):
    return split.pin_split(labelled(spark, sf), "quality", SplitSpec(strategy="random"))


def _lines(spark, sf):
    """Line numbers of orders; returned ones share a label, of the others every order is one."""
    once = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("flag"))
    label = F.when(F.col("flag") == "R", "returned").otherwise(F.col("l_orderkey").cast("string"))
    return once.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), label.alias("label"))


def pin_split_many_classes(spark, sf):
    return split.pin_split(_lines(spark, sf), "label")


def withhold_many_classes(spark, sf):
    return split.withhold(_lines(spark, sf), "label", 0.3, small_group=10_000)


def fold_counts_customer(spark, sf):
    df = customers(spark, sf)
    return split.attach(df, split.pin_split(df, "c_mktsegment")).groupBy(
        "c_mktsegment", "part").agg(F.count("*").alias("n"))


def split_manifest_orders(spark, sf):
    spec = SplitSpec()
    manifest = split.split_manifest(
        split.pin_split(orders(spark, sf), "o_orderstatus", spec), spec, "o_orderstatus")
    return manifest.select("strategy", "target", "n_rows", F.col("n_folds").cast("bigint").alias(
        "n_folds"), F.col("counts")["h"].alias("n_holdout"), "digest")


def split_problems_orders(spark, sf):
    """A split checked against a frame that lost its urgent rows and gained nothing."""
    df = orders(spark, sf)
    assignment = split.pin_split(df, "o_orderstatus")
    return split.split_problems(df.filter(F.col("o_orderpriority") != "1-URGENT"), assignment)


def fold_expand_customer(spark, sf):
    df = customers(spark, sf)
    wide = split.expand_folds(split.pin_split(df, "c_mktsegment"), vocab.N_FOLDS)
    return wide.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.sum("row_id").alias("id_sum")).withColumn(
            "fold", F.col("fold").cast("bigint"))


def row_overlap_documents(spark, sf):
    """Documents whose text also occurs under another source, whatever their ids."""
    docs = load(spark, sf, "documents")
    a, b = (docs.filter(F.col("source") == "src0"), docs.filter(F.col("source") != "src0"))
    return split.row_overlap(a, b, ["text"]).select("doc_id")


def prepared_labelled(spark, sf):
    """Rename, carve, guard and fingerprint in one step."""
    prep = split.prepare(labelled(spark, sf), "quality", 0.2, naming="opaque")
    return prep.agent.agg(
        F.count("*").alias("n_rows"), F.sum("var_04").alias("chars"),
        F.count_distinct("var_02").alias("langs"))


# ---------------------------------------------------------------- transforms


def _constants(spark, values: dict[str, float]):
    return spark.createDataFrame(list(values.items()), "column string, median double")


def medians_orders(spark, sf):
    return _constants(spark, transform.medians(
        load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]))


def medians_lineitem(spark, sf):
    return _constants(spark, transform.medians(
        load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def levels_labelled(spark, sf):
    return transform.level_table(labelled(spark, sf), ["lang", "source", "toxic"])


def _train(df, target):
    assignment = split.pin_split(df, target)
    return split.attach(df, assignment).filter(F.col("part") != split.HOLDOUT).drop("part")


def onehot_labelled(spark, sf):
    """Fitted on the train rows, applied to every row: one projection."""
    df = labelled(spark, sf)
    fit = transform.fit_transform(_train(df, "quality"), "quality")
    long = fit.transform(df, ["row_id"])
    wanted = ["toxic", "n_chars", "n_spaces", "lang=de", "lang=en", "lang=es", "lang=fr",
              "source=src0", "source=src19"]
    return long.select("row_id", *[F.col(f"`{c}`").alias(c.replace("=", "_")) for c in wanted])


def feature_order_labelled(spark, sf):
    df = labelled(spark, sf)
    fit = transform.fit_transform(_train(df, "quality"), "quality")
    rows = [(i, f, fit.column_source[f]) for i, f in enumerate(fit.feature_order)]
    return spark.createDataFrame(rows, "position bigint, feature string, source string")


def matrix_nulls_labelled(spark, sf):
    df = labelled(spark, sf)
    fit = transform.fit_transform(_train(df, "quality"), "quality")
    return transform.matrix_nulls(fit.transform(df), fit.feature_order)


def ordinal_labelled(spark, sf):
    df = labelled(spark, sf)
    fit = transform.fit_ordinal(_train(df, "quality"), "quality")
    return fit.transform(df, ["row_id"])


def ordinal_names_customer(spark, sf):
    """As many levels as rows: names of odd balances seen in train only are known."""
    df = load(spark, sf, "customer").withColumnRenamed("c_custkey", "row_id")
    train = df.filter(F.col("c_acctbal") < 8000)
    fit = transform.fit_ordinal(train.select("row_id", "c_name", "c_mktsegment"), "c_mktsegment")
    return fit.transform(df, ["row_id"])


def scale_customer(spark, sf):
    df = load(spark, sf, "customer")
    scaling = transform.fit_scaling(df, ["c_acctbal", "c_nationkey"])
    return scaling.transform(df, ["c_custkey"]).select(
        "c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"),
        F.round("c_nationkey", 6).alias("c_nationkey"))


def fit_summary_customer(spark, sf):
    df = load(spark, sf, "customer").withColumnRenamed("c_custkey", "row_id")
    profiled = profile.column_profile(df)
    forced = transform.forced_drops(profiled, "c_mktsegment")
    gone = [r["column"] for r in forced.collect()]
    fit = transform.fit_transform(df, "c_mktsegment", gone)
    return transform.fit_summary(fit, profiled, forced)


# ---------------------------------------------------------------- metrics


def auc_labelled(spark, sf):
    rows = labelled(spark, sf)
    frames = [metrics.roc_auc(rows, y, s).select(
        F.lit(f"{s}->{y}").alias("pair"), F.round("value", 9).alias("auc"))
        for y, s in itertools.product(("quality", "toxic"), ("n_chars", "n_spaces"))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def auc_by_flag_lineitem(spark, sf):
    """Heavily tied scores in three groups: quantity as a score for an open line."""
    rows = load(spark, sf, "lineitem").withColumn(
        "y", (F.col("l_linestatus") == "O").cast("int"))
    return metrics.roc_auc(rows, "y", "l_quantity", ["l_returnflag"]).select(
        "l_returnflag", F.round("value", 9).alias("auc"))


def regression_metrics_lineitem(spark, sf):
    rows = load(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 3000.0).alias("prediction"),
        F.lit(0.0).alias("score"))
    frames = [metrics.score(rows, m).select(
        F.lit(m).alias("metric"), F.round("value", 4).alias("value"))
        for m in ("rmse", "mae", "r2")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def classification_metrics_events(spark, sf):
    rows = load(spark, sf, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") > 100).cast("int").alias("prediction"),
        (F.col("value") / 500).alias("score"))
    frames = [metrics.score(rows, m).select(
        F.lit(m).alias("metric"), F.round("value", 6).alias("value"))
        for m in ("accuracy", "f1", "log_loss")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def multiclass_f1_orders(spark, sf):
    rows = load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("y"),
        F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 350000, "O")
        .otherwise("P").alias("prediction"))
    return metrics.macro_f1(rows).select(F.round("value", 6).alias("value"))


def auc_ovr_orders(spark, sf):
    price = F.col("o_totalprice") / 500000
    rows = load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("y"),
        F.array(price, 1 - price, F.abs(price - 0.5)).alias("scores"))
    return metrics.auc_ovr(rows, "y", "scores", ["F", "O", "P"]).select(
        F.round("value", 9).alias("value"))


def zero_point_labelled(spark, sf):
    """A class prior fitted on train scores exactly 0.5 on the rest."""
    df = labelled(spark, sf).withColumn("y", F.col("quality"))
    assigned = split.attach(df, split.pin_split(df, "quality"))
    train = assigned.filter(F.col("part") != "h")
    scored = metrics.zero_point(train, assigned.filter(F.col("part") == "h"), "binary")
    auc = metrics.score(scored, "roc_auc").select(F.lit("roc_auc").alias("metric"), "value")
    prior = scored.agg(F.round(F.max("score"), 9).alias("value")).select(
        F.lit("prior").alias("metric"), "value")
    return auc.unionByName(prior)


def _importances(spark, sf):
    rows = load(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.round(F.avg("p_size") - 24, 6).alias("mean"))
    return rows.withColumnRenamed("p_type", "column")


def top_importances_part(spark, sf):
    top = metrics.top_importances(_importances(spark, sf), ["p_brand"], 3)
    return top.select("p_brand", "column", "mean", F.col("rank").cast("bigint").alias("rank"))


def importance_shape_part(spark, sf):
    shape = metrics.importance_shape(
        metrics.top_importances(_importances(spark, sf), ["p_brand"]), ["p_brand"])
    return shape.withColumn("top_importance_share", F.round("top_importance_share", 6))


def _graded_parts(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") < 25, "roc_auc").when(
            F.col("p_size") < 40, "rmse").otherwise("r2").alias("metric"),
        (F.col("p_retailprice") / 2000).alias("claimed"),
        (F.col("p_size") / 50).alias("verified"),
        F.when(F.col("p_type") == "PROMO", 0.5).otherwise(0.25).alias("zero"),
        F.when(F.col("p_brand") > "Brand#2", 0.5).otherwise(0.75).alias("unit"),
        (F.col("p_size") == 7).alias("planted"))


def normalised_score(spark, sf):
    c = F.col
    return _graded_parts(spark, sf).select(
        "p_partkey",
        F.round(metrics.claim_gap(c("claimed"), c("verified"), c("metric")), 9).alias("gap"),
        F.round(metrics.separation(c("zero"), c("unit"), c("metric")), 9).alias("separation"),
        F.round(metrics.normalised(c("verified"), c("zero"), c("unit"), c("metric"),
                                   c("planted")), 9).alias("normalised"))


def best_candidate_suppliers(spark, sf):
    """Nation = run, supplier = candidate, balance = cv mean; lower is better under rmse."""
    rows = load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("run_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cv_mean"),
        F.col("s_suppkey").alias("position"))
    high = metrics.best_candidate(rows, "roc_auc", ["run_id"]).withColumnRenamed("best", "auc_best")
    low = metrics.best_candidate(rows, "rmse", ["run_id"]).withColumnRenamed("best", "rmse_best")
    return high.join(low, "run_id")


def chosen_model_suppliers(spark, sf):
    rows = load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("run_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cv_mean"),
        F.col("s_suppkey").alias("position"))
    choice = load(spark, sf, "nation").join(
        rows.groupBy("run_id").agg(F.max("name").alias("last")),
        F.col("n_nationkey") == F.col("run_id")).filter(F.col("n_regionkey") < 3).select(
            "run_id", F.when(F.col("n_regionkey") == 0, "ghost").otherwise(F.col("last")).alias(
                "choice"))
    return metrics.resolve_choice(rows, choice, "roc_auc")


def rescore_status_suppliers(spark, sf):
    """Both status ladders over one row per supplier."""
    c = F.col
    rows = load(spark, sf, "supplier").select(
        "s_suppkey", (c("s_nationkey") != 0).alias("withheld"),
        (c("s_nationkey") != 1).alias("has_spec"), (c("s_nationkey") != 2).alias("has_model"),
        c("s_nationkey").alias("width"), (c("s_nationkey") != 4).alias("known"),
        (c("s_nationkey") == 5).alias("single"), (c("s_acctbal") / 10000).alias("refit"),
        F.when(c("s_acctbal") > 5000, c("s_acctbal") / 10000).when(
            c("s_acctbal") > 2000, c("s_acctbal") / 10000 + 0.01).alias("claimed"),
        F.when(c("s_acctbal") > 3000, c("s_acctbal")).alias("verified"),
        F.when(c("s_acctbal") > 4000, 0.5).alias("zero"),
        F.when(c("s_acctbal") > 6000, 0.9).alias("unit"))
    pre = grading.rescore_precondition(c("withheld"), c("has_spec"), c("has_model"),
                                       c("width") - 3, c("known"))
    return rows.select(
        "s_suppkey", grading.rescore_status(pre, c("single"), c("refit"), c("claimed")).alias(
            "rescore_status"),
        grading.baseline_status(c("withheld"), c("verified"), c("width"), c("single"), c("zero"),
                                c("unit")).alias("baseline_status"))


# ---------------------------------------------------------------- models (rows only)


def _modelled(spark, sf, df=None):
    df = labelled(spark, sf) if df is None else df
    prepared = split.prepare(df, "quality", 0.2)
    assignment = split.pin_split(prepared.agent, "quality")
    own, _, _, _ = grading.encoded(prepared.agent, None, Task("quality"))
    assigned = split.attach(own, assignment).persist(StorageLevel.MEMORY_AND_DISK)
    train = assigned.filter(F.col("part") != split.HOLDOUT).drop("part", "y")
    return prepared, assignment, assigned, transform.fit_transform(train, "quality")


LINEAR = {"logistic_l2": models.CANDIDATES["binary"]["logistic_l2"]}


def _cv_scores(spark, sf, name):
    _, _, assigned, fit = _modelled(spark, sf)
    features = models.prepared_features(assigned, fit)
    entries = models.cross_validate(
        features, "binary", "roc_auc", vocab.N_FOLDS,
        {name: models.CANDIDATES["binary"][name]}, keep_models=False)
    features.unpersist()
    assigned.unpersist()
    return models.candidate_rows(spark, "labelled", entries)


def cv_scores_labelled(spark, sf):
    """The linear candidate on five pinned folds and the holdout."""
    return _cv_scores(spark, sf, "logistic_l2")


def cv_scores_boosted_labelled(spark, sf):
    """The boosted candidate at its full recipe (200 rounds) on the same folds."""
    return _cv_scores(spark, sf, "hist_gbdt")


def perm_importance_labelled(spark, sf):
    _, _, assigned, fit = _modelled(spark, sf)
    features = models.prepared_features(assigned, fit)
    entry = models.cross_validate(features, "binary", "roc_auc", 2, LINEAR)[0]
    features.unpersist()
    held = assigned.filter(F.col("part") == split.HOLDOUT)
    return metrics.top_importances(
        models.permutation_importance(entry.model, fit, held, "roc_auc"))


def rescore_labelled(spark, sf):
    """Claim, refit, verified score and the scale from a constant to a forest."""
    table = labelled(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # texts are read for their sizes once
    prepared, assignment, assigned, fit = _modelled(spark, sf, table)
    features = models.prepared_features(assigned, fit)
    entry = models.cross_validate(features, "binary", "roc_auc", 2, LINEAR)[0]
    features.unpersist()
    task = Task("quality")
    grade = grading.rescore(prepared.agent, prepared.withheld, assignment, task, fit,
                            entry.name, entry.holdout_score)
    grade = grading.baseline(prepared.agent, prepared.withheld, assignment, task, grade)
    assigned.unpersist()
    table.unpersist()
    return grade.row(spark, "labelled")


def _planted(spark, sf):
    """Orders with one two-valued column and an outcome that follows it but for every fifth key.

    Any model that rises with the column ranks the rows alike, so its area is (TPR + TNR) / 2.
    """
    flag = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("bigint")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), flag.alias("flag"),
        F.when(F.col("o_orderkey") % 5 == 0, 1 - flag).otherwise(flag).alias("outcome"))


def _planted_model(spark, sf, name, own=None, assignment=None):
    df = _planted(spark, sf) if own is None else own
    assignment = split.pin_split(df, "outcome") if assignment is None else assignment
    rows, _, _, _ = grading.encoded(df, None, Task("outcome"))
    assigned = split.attach(rows, assignment).persist(StorageLevel.MEMORY_AND_DISK)
    train = assigned.filter(F.col("part") != split.HOLDOUT).drop("part", "y")
    fit = transform.fit_transform(train, "outcome")
    features = models.prepared_features(assigned, fit)
    entry = models.cross_validate(features, "binary", "roc_auc", vocab.N_FOLDS,
                                  {name: models.CANDIDATES["binary"][name]})[0]
    features.unpersist()
    return entry, fit, assigned


def _planted_scores(spark, sf, name):
    entry, _, assigned = _planted_model(spark, sf, name)
    assigned.unpersist()
    rows = models.candidate_rows(spark, "planted", [entry])
    parts = F.concat(F.col("cv_scores"), F.array("claimed_holdout_score", "cv_mean"))
    return rows.select("name", F.posexplode(parts).alias("at", "auc")).select(
        "name", F.when(F.col("at") < vocab.N_FOLDS, F.col("at").cast("string")).when(
            F.col("at") == vocab.N_FOLDS, split.HOLDOUT).otherwise("mean").alias("part"),
        F.round("auc", 9).alias("auc"))


def cv_scores_planted(spark, sf):
    """The linear candidate's area on each pinned fold, the holdout and in the mean."""
    return _planted_scores(spark, sf, "logistic_l2")


def cv_scores_boosted_planted(spark, sf):
    """The boosted candidate at its full recipe on the same folds."""
    return _planted_scores(spark, sf, "hist_gbdt")


def perm_importance_planted(spark, sf):
    """Loss of area when the planted column's values move on by each repeat's distance."""
    entry, fit, assigned = _planted_model(spark, sf, "logistic_l2")
    held = assigned.filter(F.col("part") == split.HOLDOUT)
    found = models.permutation_importance(entry.model, fit, held, "roc_auc")
    return found.select("column", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def rescore_planted(spark, sf):
    """Claim, refit, score on withheld rows, and the scale from a constant to the forest."""
    prepared = split.prepare(_planted(spark, sf), "outcome", 0.2)
    assignment = split.pin_split(prepared.agent, "outcome")
    entry, fit, assigned = _planted_model(spark, sf, "logistic_l2", prepared.agent, assignment)
    assigned.unpersist()
    task = Task("outcome")
    grade = grading.rescore(prepared.agent, prepared.withheld, assignment, task, fit,
                            entry.name, entry.holdout_score)
    row = grading.baseline(prepared.agent, prepared.withheld, assignment, task, grade).row(spark, "planted")
    scores = ["verified_holdout_score", "refit_claim_gap", "baseline_zero_score", "baseline_unit_score"]
    return row.select("rescore_status", "baseline_status", "n_withheld_rows", *[
        F.round(c, 9).alias(c) for c in scores], F.round(F.lit(entry.holdout_score), 9).alias("claimed"))


def ridge_lineitem(spark, sf):
    """Line price from quantity, discount and tax, graded on a withheld fifth by receipt flag.

    Lines that share an id, equal ones above all, are all used and share a part.
    """
    from auditspark.queries.profiling import lineitem_identified

    df = lineitem_identified(spark, sf).select(
        "row_id", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice").persist(
            StorageLevel.MEMORY_AND_DISK)
    ids = df.groupBy("row_id").agg(F.min("l_returnflag").alias("l_returnflag")).persist(
        StorageLevel.MEMORY_AND_DISK)
    assignment = split.pin_split(ids, "l_returnflag")
    own = df.withColumn("y", F.col("l_extendedprice"))
    assigned = split.attach(own, assignment).persist(StorageLevel.MEMORY_AND_DISK)
    train = assigned.filter(F.col("part") != split.HOLDOUT).drop("part", "y")
    fit = transform.fit_transform(train, "l_extendedprice")
    features = models.prepared_features(assigned, fit)
    entries = models.cross_validate(features, "regression", "rmse", vocab.N_FOLDS,
                                    {"ridge": models.CANDIDATES["regression"]["ridge"]}, keep_models=False)
    for kept in (features, assigned, ids, df):
        kept.unpersist()
    return models.candidate_rows(spark, "lineitem", entries)


# ---------------------------------------------------------------- planted leaks


def noisy_copy_labelled(spark, sf):
    return inject.noisy_copy(labelled(spark, sf), "quality", "1").select(
        "row_id", "quality", "status_code")


def rekeyed_id_orders(spark, sf):
    return inject.rekeyed_id(orders(spark, sf), "o_orderstatus", "F").select(
        "row_id", "member_number")


def inject_missing_customer(spark, sf):
    return inject.missing(customers(spark, sf), "c_acctbal", 0.07).select("row_id", "c_acctbal")


def post_label_orders(spark, sf):
    return inject.post_label(orders(spark, sf), "o_orderstatus", "F").groupBy(
        "o_orderstatus").agg(F.round(F.avg("days_to_close"), 3).alias("days"),
                             F.round(F.avg("adjuster_touches"), 3).alias("touches"))


def answer_key_labelled(spark, sf):
    planted = inject.noisy_copy(labelled(spark, sf), "quality", "1")
    return inject.answer_key(planted, "quality", "1", {"status_code": "noisy_copy"})


def planted_survive_orders(spark, sf):
    """Planted columns that a mechanical filter would drop anyway: must be none."""
    from auditspark.operators.runs import surviving_plants

    df = inject.rekeyed_id(inject.noisy_copy(orders(spark, sf), "o_orderstatus", "F"),
                           "o_orderstatus", "F")
    dropped = transform.forced_drops(profile.column_profile(df), "o_orderstatus")
    plants = spark.createDataFrame(
        [("status_code",), ("member_number",), ("row_id",)], "column string")
    return surviving_plants(plants, dropped)


QUERIES = {f.__name__: f for f in (
    withhold_labelled, withhold_orders_counts, withheld_partition_customer, pin_split_orders,
    pin_split_random_labelled, pin_split_many_classes, withhold_many_classes, fold_counts_customer,
    split_manifest_orders, split_problems_orders,
    fold_expand_customer, row_overlap_documents, prepared_labelled, medians_orders,
    medians_lineitem, levels_labelled, onehot_labelled, feature_order_labelled,
    matrix_nulls_labelled, ordinal_labelled, ordinal_names_customer, scale_customer,
    fit_summary_customer, auc_labelled, auc_by_flag_lineitem, regression_metrics_lineitem,
    classification_metrics_events, multiclass_f1_orders, auc_ovr_orders, zero_point_labelled,
    top_importances_part, importance_shape_part, normalised_score, best_candidate_suppliers,
    chosen_model_suppliers, rescore_status_suppliers, cv_scores_labelled,
    cv_scores_boosted_labelled,
    perm_importance_labelled, rescore_labelled, cv_scores_planted, cv_scores_boosted_planted,
    perm_importance_planted, rescore_planted, ridge_lineitem, noisy_copy_labelled,
    rekeyed_id_orders, inject_missing_customer, post_label_orders, answer_key_labelled,
    planted_survive_orders)}

# ---------------------------------------------------------------- SQL twins


def _withheld(rel: str, label: str, fraction: float) -> str:
    lab = f"coalesce(CAST({label} AS VARCHAR), '')"
    return f"""wh AS (SELECT *, row_number() OVER (PARTITION BY {lab}
          ORDER BY {sql_draw('row_id')}, row_id)
        <= least(greatest(1, floor({fraction} * count(*) OVER (PARTITION BY {lab}))),
                 count(*) OVER (PARTITION BY {lab}) - 1) AS withheld FROM {rel})"""


def _pinned(rel: str, label: str, stratified: bool = True, k: int = 5, f: float = 0.2) -> str:
    """asg(row_id, part): quotas by largest remainder, folds as consecutive draws of a class."""
    g = f"coalesce(CAST({label} AS VARCHAR), '')" if stratified else "''"
    sizes = (f"""CAST((n_train + {k} - 1 - ((i - start) % {k} + {k}) % {k}) // {k} AS BIGINT)"""
             if stratified else
             f"CAST(n_train // {k} + CASE WHEN i < n_train % {k} THEN 1 ELSE 0 END AS BIGINT)")
    return f"""
    st AS (SELECT {g} AS g, count(*) AS n, sum(count(*)) OVER () AS total FROM {rel} GROUP BY 1),
    ex AS (SELECT *, CAST(ceil({f} * total) AS DOUBLE) * n / total AS exact,
                  CAST(ceil({f} * total) AS BIGINT) AS n_test FROM st),
    fl AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base,
                  n_test - CAST(sum(floor(exact)) OVER () AS BIGINT) AS spare,
                  row_number() OVER (ORDER BY exact - floor(exact) DESC, g) AS rk FROM ex),
    qt AS (SELECT g, n, base + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS q FROM fl),
    tr AS (SELECT *, n - q AS n_train,
                  CAST(coalesce(sum(n - q) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING), 0) AS BIGINT) AS start FROM qt),
    fs AS (SELECT g, q, i, sum({sizes}) OVER (PARTITION BY g ORDER BY i) + q AS upto
           FROM tr, (SELECT unnest(range({k})) AS i)),
    rk AS (SELECT row_id, {g} AS g, row_number() OVER (PARTITION BY {g}
             ORDER BY {sql_draw('row_id')}, row_id) AS r FROM {rel}),
    asg AS (SELECT rk.row_id, CASE WHEN r <= min(q) THEN 'h'
              ELSE CAST(min(i) FILTER (WHERE r <= upto) AS VARCHAR) END AS part
            FROM rk JOIN fs ON rk.g = fs.g GROUP BY rk.row_id, r)"""


def _train_sql(rel: str, label: str) -> str:
    return f"""{_pinned(rel, label)},
    train AS (SELECT d.* FROM {rel} d JOIN asg ON d.row_id = asg.row_id WHERE part <> 'h')"""


def _auc(rel: str, label: str, score: str, digits: int = 9) -> str:
    """Mid-rank AUC."""
    return f"""SELECT round((sum(mid) FILTER (WHERE {label} = 1) - p * (p + 1) / 2.0) / (p * q),
        {digits}) AS auc FROM (
      SELECT {label}, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1)
        / 2.0 AS mid, CAST(sum({label}) OVER () AS DOUBLE) AS p,
        CAST(count(*) OVER () - sum({label}) OVER () AS DOUBLE) AS q FROM {rel}) GROUP BY p, q"""


_SCORED_PART = """gp AS (SELECT p_partkey, CASE WHEN p_size < 25 THEN 1.0 WHEN p_size < 40 THEN -1.0
    ELSE 1.0 END AS sign, p_retailprice / 2000 AS claimed, p_size / 50 AS verified,
    CASE WHEN p_type = 'PROMO' THEN 0.5 ELSE 0.25 END AS zero,
    CASE WHEN p_brand > 'Brand#2' THEN 0.5 ELSE 0.75 END AS unit, p_size = 7 AS planted FROM part)"""
_IMP = """imp AS (SELECT p_brand, p_type AS "column", round(avg(p_size) - 24, 6) AS mean
    FROM part GROUP BY 1, 2),
  top AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY mean DESC, "column") AS rank
          FROM imp)"""
_SUPP = """sup AS (SELECT s_nationkey AS run_id, s_name AS name,
    CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cv_mean, s_suppkey AS position FROM supplier)"""
_LINES = """lines AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE WHEN max(l_returnflag) = 'R'
    THEN 'returned' ELSE CAST(l_orderkey AS VARCHAR) END AS label
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_PLANTED = """planted AS (SELECT o_orderkey AS row_id,
    CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS BIGINT) AS flag,
    CASE WHEN o_orderkey % 5 = 0 THEN 1 - flag ELSE flag END AS outcome FROM orders)"""


def _two_valued_auc(flag: str = "flag", label: str = "outcome") -> str:
    """Mean of true positive and true negative rate of a two-valued score that rises with the label."""
    return (f"(count(*) FILTER ({label} = 1 AND {flag} = 1) / CAST(count(*) FILTER ({label} = 1) AS DOUBLE)"
            f" + count(*) FILTER ({label} = 0 AND {flag} = 0) / CAST(count(*) FILTER ({label} = 0) AS DOUBLE)) / 2")


def _planted_scores_sql(name: str) -> str:
    return f"""WITH {_PLANTED}, {_pinned('planted', 'outcome')},
      auc AS (SELECT part, {_two_valued_auc()} AS auc FROM planted JOIN asg USING (row_id) GROUP BY part)
      SELECT '{name}' AS name, part, round(auc, 9) AS auc FROM auc
      UNION ALL SELECT '{name}', 'mean', round(avg(auc), 9) FROM auc WHERE part <> 'h'"""


def _as_written(value: str, digits: int = 6) -> str:
    """``value`` rounded half up as its shortest decimal form reads, the rule of Spark's round."""
    return f"CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, {digits})) AS DOUBLE)"


_UNI = "({}) / 4503599627370496.0"

ORACLES = {
    "withhold_labelled": f"WITH {LABELLED}, {_withheld('labelled', 'quality', 0.2)} "
                         "SELECT row_id, quality, withheld FROM wh",
    "withhold_orders_counts": f"""WITH {ORDERS}, {_withheld('ord', 'o_orderpriority', 0.1)}
      SELECT o_orderpriority, withheld, count(*) AS n FROM wh GROUP BY 1, 2""",
    "withheld_partition_customer": f"""WITH {CUSTOMERS}, d AS (SELECT md5(concat_ws('|',
          coalesce(CAST(row_id AS VARCHAR), '\\N'), coalesce(CAST(c_nationkey AS VARCHAR), '\\N'),
          coalesce({sql_double_text('c_acctbal')}, '\\N'), coalesce(c_mktsegment, '\\N'))) AS h FROM cust)
      SELECT count(*) AS n_rows, bit_xor(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS xor_head,
        CAST(sum(CAST('0x' || substr(h, 13, 7) AS BIGINT)) AS BIGINT) AS sum_tail,
        'union' AS part FROM d
      UNION ALL SELECT 0, 0, 0, 'shared'""",
    "pin_split_orders": f"WITH {ORDERS}, {_pinned('ord', 'o_orderstatus')} SELECT * FROM asg",
    "pin_split_random_labelled": f"WITH {LABELLED}, {_pinned('labelled', 'quality', False)} "
                                 "SELECT * FROM asg",
    "pin_split_many_classes": f"WITH {_LINES}, {_pinned('lines', 'label')} SELECT * FROM asg",
    "withhold_many_classes": f"WITH {_LINES}, {_withheld('lines', 'label', 0.3)} "
                             "SELECT row_id, label, withheld FROM wh",
    "cv_scores_planted": _planted_scores_sql("logistic_l2"),
    "cv_scores_boosted_planted": _planted_scores_sql("hist_gbdt"),
    "perm_importance_planted": f"""WITH {_PLANTED}, {_pinned('planted', 'outcome')},
      held AS (SELECT outcome, flag, row_number() OVER (ORDER BY {sql_draw('row_id', ':order')}, row_id) - 1
          AS i, count(*) OVER () AS n FROM planted JOIN asg USING (row_id) WHERE part = 'h'),
      shares AS (SELECT r, n, r * (n - 1) // {vocab.PERMUTATION_REPEATS} AS low,
          (r + 1) * (n - 1) // {vocab.PERMUTATION_REPEATS} AS high
          FROM (SELECT DISTINCT n FROM held), (SELECT unnest(range({vocab.PERMUTATION_REPEATS})) AS r)),
      shifts AS (SELECT r, 1 + low + {sql_draw('r', ':shift')} % (high - low) AS d FROM shares),
      moved AS (SELECT r, a.outcome, b.flag FROM held a, shifts JOIN held b ON b.i = (a.i + d) % b.n),
      loss AS (SELECT r, (SELECT {_two_valued_auc()} FROM held) - {_two_valued_auc()} AS loss
          FROM moved GROUP BY r)
      SELECT 'flag' AS "column", round(avg(loss), 9) AS mean, round(stddev_pop(loss), 9) AS std FROM loss""",
    "rescore_planted": f"""WITH {_PLANTED}, {_withheld('planted', 'outcome', 0.2)},
      agent AS (SELECT row_id, flag, outcome FROM wh WHERE NOT withheld), {_pinned('agent', 'outcome')},
      claim AS (SELECT {_two_valued_auc()} AS auc FROM agent JOIN asg USING (row_id) WHERE part = 'h')
      SELECT 'ok' AS rescore_status, 'ok' AS baseline_status, count(*) AS n_withheld_rows,
        round({_two_valued_auc()}, 9) AS verified_holdout_score, CAST(0 AS DOUBLE) AS refit_claim_gap,
        CAST(0.5 AS DOUBLE) AS baseline_zero_score, round({_two_valued_auc()}, 9) AS baseline_unit_score,
        round((SELECT auc FROM claim), 9) AS claimed FROM wh WHERE withheld""",
    "fold_counts_customer": f"""WITH {CUSTOMERS}, {_pinned('cust', 'c_mktsegment')}
      SELECT c_mktsegment, part, count(*) AS n FROM cust JOIN asg ON cust.row_id = asg.row_id
      GROUP BY 1, 2""",
    "split_manifest_orders": f"""WITH {ORDERS}, {_pinned('ord', 'o_orderstatus')},
      l1 AS (SELECT row_id // 4096 AS pos, sha256(string_agg(part, '' ORDER BY row_id)) AS text
             FROM asg GROUP BY 1),
      l2 AS (SELECT pos // 4096 AS pos, sha256(string_agg(text, '' ORDER BY pos)) AS text
             FROM l1 GROUP BY 1)
      SELECT 'stratified' AS strategy, 'o_orderstatus' AS target, count(*) AS n_rows,
        CAST(5 AS BIGINT) AS n_folds, count(*) FILTER (WHERE part = 'h') AS n_holdout,
        (SELECT max(text) FROM (SELECT text FROM l1 WHERE (SELECT count(*) FROM l1) = 1
           UNION ALL SELECT text FROM l2 WHERE (SELECT count(*) FROM l1) > 1)) AS digest FROM asg""",
    "split_problems_orders": """SELECT 'not_in_frame' AS problem, count(*) AS n FROM orders
      WHERE o_orderpriority = '1-URGENT'""",
    "fold_expand_customer": f"""WITH {CUSTOMERS}, {_pinned('cust', 'c_mktsegment')}
      SELECT CAST(fold AS BIGINT) AS fold,
        CASE WHEN part = CAST(fold AS VARCHAR) THEN 'valid' ELSE 'train' END AS role,
        count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum
      FROM asg, (SELECT unnest(range(5)) AS fold) WHERE part <> 'h' GROUP BY 1, 2""",
    "row_overlap_documents": """SELECT doc_id FROM documents a WHERE source = 'src0'
      AND text IN (SELECT text FROM documents WHERE source <> 'src0')""",
    "prepared_labelled": f"""WITH {LABELLED}, {_withheld('labelled', 'quality', 0.2)}
      SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS chars,
        count(DISTINCT lang) AS langs FROM wh WHERE NOT withheld""",
    "medians_orders": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(median({c}) AS DOUBLE) AS median FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")),
    "medians_lineitem": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(median({c}) AS DOUBLE) AS median FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "levels_labelled": f"""WITH {LABELLED}
      SELECT DISTINCT 'lang' AS "column", lang AS level FROM labelled
      UNION ALL SELECT DISTINCT 'source', source FROM labelled
      UNION ALL SELECT DISTINCT 'toxic', CAST(toxic AS VARCHAR) FROM labelled""",
    "onehot_labelled": f"""WITH {LABELLED} SELECT row_id, CAST(toxic AS DOUBLE) AS toxic,
      CAST(n_chars AS DOUBLE) AS n_chars, CAST(n_spaces AS DOUBLE) AS n_spaces, """
    + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_{v}"
                for c, v in (("lang", "de"), ("lang", "en"), ("lang", "es"), ("lang", "fr"),
                             ("source", "src0"), ("source", "src19"))) + " FROM labelled",
    "feature_order_labelled": f"""WITH {LABELLED}, {_train_sql('labelled', 'quality')},
      f AS (SELECT 0 AS a, 'toxic' AS feature, 'toxic' AS source UNION ALL
            SELECT 1, 'n_chars', 'n_chars' UNION ALL SELECT 2, 'n_spaces', 'n_spaces' UNION ALL
            SELECT DISTINCT 3, 'lang=' || lang, 'lang' FROM train UNION ALL
            SELECT DISTINCT 4, 'source=' || source, 'source' FROM train)
      SELECT row_number() OVER (ORDER BY a, feature) - 1 AS position, feature, source FROM f""",
    "matrix_nulls_labelled": """SELECT CAST(0 AS BIGINT) AS n_missing, count(*) AS n_rows
      FROM labels""",
    "ordinal_labelled": f"""WITH {LABELLED}, {_train_sql('labelled', 'quality')},
      a AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code
            FROM (SELECT DISTINCT lang FROM train)),
      b AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code
            FROM (SELECT DISTINCT source FROM train))
      SELECT l.row_id, CAST(toxic AS DOUBLE) AS toxic, CAST(n_chars AS DOUBLE) AS n_chars,
        CAST(n_spaces AS DOUBLE) AS n_spaces, CAST(coalesce(a.code, -1) AS DOUBLE) AS lang,
        CAST(coalesce(b.code, -1) AS DOUBLE) AS source
      FROM labelled l LEFT JOIN a ON l.lang = a.lang LEFT JOIN b ON l.source = b.source""",
    "ordinal_names_customer": """WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1
        AS code FROM (SELECT DISTINCT c_name FROM customer WHERE c_acctbal < 8000))
      SELECT c_custkey AS row_id, CAST(coalesce(code, -1) AS DOUBLE) AS c_name
      FROM customer c LEFT JOIN a ON c.c_name = a.c_name""",
    "scale_customer": """SELECT c_custkey,
      round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal,
      round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6)
        AS c_nationkey FROM customer""",
    "fit_summary_customer": """SELECT 'c_mktsegment' AS "column", 'dropped' AS decision,
        'target' AS reason, '' AS detail
      UNION ALL SELECT 'row_id', 'dropped', 'identifier', ''
      UNION ALL SELECT 'c_name', 'dropped', 'identifier', ''
      UNION ALL SELECT 'c_acctbal', 'numeric', 'kept', 'median=' || CAST(median(c_acctbal)
        AS VARCHAR) FROM customer
      UNION ALL SELECT 'c_nationkey', 'numeric', 'kept', 'median=' || CAST(CAST(
        median(c_nationkey) AS DOUBLE) AS VARCHAR) FROM customer""",
    "auc_labelled": f"WITH {LABELLED} " + " UNION ALL ".join(
        f"SELECT '{s}->{y}' AS pair, auc FROM ({_auc('labelled', y, s)})"
        for y, s in itertools.product(("quality", "toxic"), ("n_chars", "n_spaces"))),
    "auc_by_flag_lineitem": "WITH l AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END "
    "AS y FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{f}' AS l_returnflag, auc FROM (" + _auc(
            f"(SELECT * FROM l WHERE l_returnflag = '{f}')", "y", "l_quantity") + ")"
        for f in "ANR"),
    "regression_metrics_lineitem": """WITH l AS (SELECT l_extendedprice AS y,
        l_quantity * 3000.0 AS p FROM lineitem)
      SELECT 'rmse' AS metric, round(sqrt(avg((y - p) * (y - p))), 4) AS value FROM l
      UNION ALL SELECT 'mae', round(avg(abs(y - p)), 4) FROM l
      UNION ALL SELECT 'r2', round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4)
        FROM l""",
    "classification_metrics_events": f"""WITH e AS (SELECT
        CAST(event_type = 'purchase' AS INTEGER) AS y, CAST(value > 100 AS INTEGER) AS p,
        least(greatest(value / 500, {metrics.EPS}), 1 - {metrics.EPS}) AS q FROM events)
      SELECT 'accuracy' AS metric, {_as_written('avg(CAST(CAST(y = p AS INTEGER) AS DOUBLE))')} AS value
      FROM e
      UNION ALL SELECT 'f1', CASE WHEN 2 * sum(y * p) + sum(abs(y - p)) > 0
          THEN {_as_written('2.0 * sum(y * p) / (2 * sum(y * p) + sum(abs(y - p)))')} ELSE 0.0 END FROM e
      UNION ALL SELECT 'log_loss', {_as_written('-avg(y * ln(q) + (1 - y) * ln(1 - q))')} FROM e""",
    "multiclass_f1_orders": """WITH o AS (SELECT o_orderstatus AS t, CASE
        WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'P' END AS p
        FROM orders),
      f AS (SELECT c, 2.0 * count(*) FILTER (WHERE t = c AND p = c)
              / (count(*) FILTER (WHERE t = c) + count(*) FILTER (WHERE p = c)) AS f1
            FROM o, (VALUES ('F'), ('O'), ('P')) v(c) GROUP BY c)
      SELECT round(avg(f1), 6) AS value FROM f""",
    "auc_ovr_orders": "WITH o AS (SELECT o_orderstatus AS t, o_totalprice / 500000 AS price "
    "FROM orders), a AS (" + " UNION ALL ".join(
        f"SELECT auc FROM ({_auc(rel, 'y', 's', 12)})" for rel in (
            f"(SELECT CASE WHEN t = '{c}' THEN 1 ELSE 0 END AS y, {s} AS s FROM o)"
            for c, s in (("F", "price"), ("O", "1 - price"), ("P", "abs(price - 0.5)"))))
    + ") SELECT round(avg(auc), 9) AS value FROM a",
    "zero_point_labelled": f"""WITH {LABELLED}, {_train_sql('labelled', 'quality')}
      SELECT 'roc_auc' AS metric, CAST(0.5 AS DOUBLE) AS value
      UNION ALL SELECT 'prior', round(avg(quality), 9) FROM train""",
    "top_importances_part": f"""WITH {_IMP} SELECT p_brand, "column", mean, rank FROM top
      WHERE rank <= 3""",
    "importance_shape_part": f"""WITH {_IMP}, w AS (SELECT *,
        sum(greatest(mean, 0)) OVER (PARTITION BY p_brand) AS mass,
        sum(greatest(mean, 0)) OVER (PARTITION BY p_brand ORDER BY rank) AS upto
        FROM top WHERE rank <= 15)
      SELECT p_brand, round(CASE WHEN max(mass) > 0 THEN max(mean) / max(mass) END, 6)
          AS top_importance_share,
        CASE WHEN max(mass) > 0 THEN min(rank) FILTER (WHERE upto >= 0.8 * mass) END
          AS top_importance_n80,
        CASE WHEN max(mass) > 0 THEN 'ok' ELSE 'no_positive_importance' END
          AS top_importance_status FROM w GROUP BY 1""",
    "normalised_score": f"""WITH {_SCORED_PART} SELECT p_partkey,
      CAST(round((claimed - verified) * sign, 9) AS DOUBLE) AS gap,
      CAST(round((unit - zero) * sign, 9) AS DOUBLE) AS separation,
      CAST(CASE WHEN NOT planted AND (unit - zero) * sign > 1e-9
        THEN round((verified - zero) * sign / ((unit - zero) * sign), 9) END AS DOUBLE)
        AS normalised FROM gp""",
    "best_candidate_suppliers": f"""WITH {_SUPP} SELECT run_id,
      arg_min(name, (-cv_mean, position)) AS auc_best,
      arg_min(name, (cv_mean, position)) AS rmse_best FROM sup WHERE cv_mean IS NOT NULL
      GROUP BY 1""",
    "chosen_model_suppliers": f"""WITH {_SUPP},
      best AS (SELECT run_id, arg_min(name, (-cv_mean, position)) AS best FROM sup
               WHERE cv_mean IS NOT NULL GROUP BY 1),
      ch AS (SELECT run_id, CASE WHEN n_regionkey = 0 THEN 'ghost' ELSE max(name) END AS choice
             FROM sup JOIN nation ON run_id = n_nationkey WHERE n_regionkey < 3
             GROUP BY run_id, n_regionkey),
      j AS (SELECT r.run_id, ch.choice, best.best, s.name AS valid
            FROM (SELECT DISTINCT run_id FROM sup) r LEFT JOIN ch ON r.run_id = ch.run_id
            LEFT JOIN best ON r.run_id = best.run_id
            LEFT JOIN sup s ON s.run_id = r.run_id AND s.name = ch.choice
              AND s.cv_mean IS NOT NULL)
      SELECT run_id, coalesce(valid, best) AS chosen,
        CASE WHEN best IS NULL THEN 'no candidate was scored'
             WHEN valid IS NULL AND choice IS NOT NULL THEN 'choice is not a scored candidate'
             WHEN valid IS NULL THEN 'no choice given' END AS note FROM j""",
    "rescore_status_suppliers": """WITH s AS (SELECT s_suppkey, s_nationkey AS k, s_acctbal AS b,
        s_acctbal / 10000 AS refit, CASE WHEN s_acctbal > 5000 THEN s_acctbal / 10000
          WHEN s_acctbal > 2000 THEN s_acctbal / 10000 + 0.01 END AS claimed FROM supplier)
      SELECT s_suppkey, CASE WHEN k = 0 THEN 'no_withheld_holdout' WHEN k = 1 THEN 'no_spec'
          WHEN k = 2 THEN 'no_model' WHEN k = 3 THEN 'empty_matrix'
          WHEN k = 4 THEN 'unknown_model_spec' WHEN k = 5 THEN 'single_class_holdout'
          WHEN claimed IS NULL OR abs(refit - claimed) > 1e-6 THEN 'refit_mismatch' ELSE 'ok' END
          AS rescore_status,
        CASE WHEN k = 0 THEN 'no_withheld_holdout' WHEN NOT b > 3000 THEN 'rescore_unavailable'
          WHEN k = 5 THEN 'single_class_train' WHEN NOT b > 6000 THEN 'unit_point_failed'
          ELSE 'ok' END AS baseline_status FROM s""",
    "noisy_copy_labelled": f"""WITH {LABELLED} SELECT row_id, quality,
      CASE WHEN (quality = 1) <> ({_UNI.format(sql_draw('row_id', ':status_code'))} < 0.06)
        THEN 'Z9' ELSE 'A1' END AS status_code FROM labelled""",
    "rekeyed_id_orders": f"""WITH {ORDERS} SELECT row_id, row_id
      - CASE WHEN {_UNI.format(sql_draw('row_id', ':member_number:repeat'))} < 0.06 THEN 1 ELSE 0 END
      + CASE WHEN {_UNI.format(sql_draw('row_id', ':member_number:block'))}
          < CASE WHEN o_orderstatus = 'F' THEN 0.8 ELSE 0.2 END THEN 700000 ELSE 0 END
      AS member_number FROM ord""",
    "inject_missing_customer": f"""WITH {CUSTOMERS} SELECT row_id, CASE WHEN row_number() OVER (
        ORDER BY {sql_draw('row_id', ':missing:c_acctbal')}, row_id)
        > CAST(floor(0.07 * count(*) OVER ()) AS BIGINT) THEN c_acctbal END AS c_acctbal
      FROM cust""",
    "post_label_orders": f"""WITH {ORDERS}, b AS (SELECT row_id, o_orderstatus,
        CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y,
        greatest({_UNI.format(sql_draw('row_id', ':days:u1'))}, pow(2, -52)) AS u1,
        {_UNI.format(sql_draw('row_id', ':days:u2'))} AS u2,
        {_UNI.format(sql_draw('row_id', ':touches'))} AS u3 FROM ord),
      pmf AS (SELECT y, k, exp(-(1.6 + 2.2 * y) + k * ln(1.6 + 2.2 * y) - lgamma(k + 1)) AS p
              FROM (VALUES (0.0), (1.0)) v(y), (SELECT unnest(range(41)) AS k)),
      cdf AS (SELECT y, k, sum(p) OVER (PARTITION BY y ORDER BY k) AS c FROM pmf),
      t AS (SELECT row_id, count(*) FILTER (WHERE c <= u3) AS touches
            FROM b JOIN cdf ON b.y = cdf.y GROUP BY 1)
      SELECT o_orderstatus, round(avg(round(exp(2.35 + 0.80 * b.y
          + 0.60 * (sqrt(-2 * ln(u1)) * cos(2 * pi() * u2))), 1)), 3) AS days,
        round(avg(touches), 3) AS touches FROM b JOIN t ON b.row_id = t.row_id GROUP BY 1""",
    "answer_key_labelled": f"""WITH {LABELLED}, pl AS (SELECT row_id, quality,
        CASE WHEN (quality = 1) <> ({_UNI.format(sql_draw('row_id', ':status_code'))} < 0.06)
          THEN 'Z9' ELSE 'A1' END AS status_code FROM labelled),
      {sql_nmi('pl', 'quality', [], ['status_code'])},
      v AS (SELECT status_code, sum(quality) AS pos, count(*) AS n FROM pl GROUP BY 1)
      SELECT 'status_code' AS "column", 'noisy_copy' AS kind,
        round(sum(greatest(pos, n - pos)) / sum(n), 4) AS agreement, (SELECT nmi FROM nmi) AS nmi
      FROM v""",
    "planted_survive_orders": "SELECT 'row_id' AS \"column\"",
}
