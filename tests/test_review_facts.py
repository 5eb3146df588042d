"""All that a results row says of its objections, beside the folds that give each figure alone."""

from functools import reduce

from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.operators import reviewlog
from auditspark.queries.grading import results_row_customers


def test_one_pass_gives_the_figures_of_each_fold(spark):
    objections = spark.createDataFrame([
        (1, "a", "leakage", "modeler", ["x", "y", None, "x"]), (1, "b", "overfit", "modeler", ["z"]),
        (1, "c", "contamination", "feature_eng", []), (1, "d", "implausible_importance", "modeler", ["y"]),
        (2, "a", "leakage", "modeler", ["x", "x"]), (2, "b", None, None, None), (3, "a", "other", "modeler", ["q"]),
        (9, "a", "leakage", "modeler", ["q"])],
        "run_id int, objection_id string, category string, target_node string, columns array<string>")
    latest = spark.createDataFrame([
        (1, "a", "resolved"), (1, "b", "withdrawn"), (1, "gone", "resolved"), (2, "a", "still_open"),
        (2, "b", "resolved"), (4, "a", "withdrawn")], "run_id int, objection_id string, disposition string")
    runs = spark.createDataFrame([
        (1, "by_category", ["y"]), (2, "as_addressed", None), (3, None, ["q"]), (4, "by_category", [])],
        "run_id int, objection_routing string, final_features array<string>").withColumn(
            "forced_drop_release", F.lit("withdrawn_only"))
    standing = reviewlog.open_objections(objections, latest)

    def named(df, name):
        return df.withColumnRenamed("columns", name)

    folds = [
        named(reviewlog.objected_columns(objections, vocab.LEAK_CATEGORIES), "__flagged"),
        named(reviewlog.objected_columns(standing, vocab.LEAK_CATEGORIES), "__standing"),
        named(reviewlog.objected_columns(objections), "__objected"),
        reviewlog.category_counts(objections), reviewlog.target_counts(objections),
        reviewlog.rerouted(reviewlog.with_acting_node(objections, runs)),
        objections.groupBy("run_id").agg(F.count("*").alias("objections_raised")),
        standing.groupBy("run_id").agg(F.count("*").alias("objections_open_at_end")),
        reviewlog.closure_counts(objections, latest, runs)]
    each = reduce(lambda a, b: a.join(b, "run_id", "full"), folds)
    whole = reviewlog.review_facts(objections, latest, runs)
    assert sorted(whole.columns) == sorted(each.columns)

    def rows(df):  # where a fold has no row, the one pass has zero or nothing
        return {r.run_id: {c: v for c, v in r.asDict().items() if v}
                for r in df.select("run_id", *[
                    F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.col(c)
                    for c, t in df.dtypes if c != "run_id" and not t.startswith("map")], *[
                        F.array_join(F.transform(F.map_values(c), lambda n: n.cast("string")), ",").alias(c)
                        for c, t in df.dtypes if t.startswith("map")]).collect()}

    assert rows(whole).keys() == rows(each).keys() == {1, 2, 3, 4, 9}
    got, want = rows(whole), rows(each)
    for run in got:
        plain = {c: v for c, v in want[run].items() if c.startswith("__") or isinstance(v, int)}
        assert {c: v for c, v in got[run].items() if c.startswith("__") or isinstance(v, int)} == plain
        for c in ("objections_by_category", "objections_by_target_node"):
            assert got[run][c] == want[run].get(c, got[run][c])


def test_the_wide_row_reads_passes_that_were_written_once(spark, sf0001):
    plan = results_row_customers(spark, sf0001)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan  # dispositions were folded into passes before
