import json
import random

import pytest
from pyspark.sql import functions as F

from auditspark.operators import inject as I
from auditspark.operators import runplan
from auditspark.operators.profile import association, column_profile, id_like
from auditspark.operators.runs import surviving_plants
from auditspark.operators.transform import forced_drops
from auditspark.sources import fingerprint, registry, results, tables


@pytest.fixture(scope="module")
def base(spark):
    rng = random.Random(4)
    return spark.createDataFrame(
        [(i, int(rng.random() < 0.3), rng.random()) for i in range(2000)],
        "row_id bigint, y int, noise double")


def test_planted_columns_are_found_and_survive_the_id_rule(base):
    df = I.noisy_copy(base, "y", "1")
    df = I.post_label(df, "y", "1")
    df = I.rekeyed_id(df, "y", "1")
    df = I.missing(df, "noise", 0.07)
    assert df.filter("noise is null").count() == 140
    nmi = {r["column"]: r.nmi for r in association(df, "y").collect()}
    planted = ["status_code", "days_to_close", "adjuster_touches", "member_number"]
    assert all(nmi[c] > 20 * max(nmi["noise"], 0.001) for c in planted)
    profile = column_profile(df.drop("row_id"))
    dropped = forced_drops(profile, "y")
    plants = df.sparkSession.createDataFrame([(c,) for c in planted], "column string")
    assert surviving_plants(plants, dropped).count() == 0
    share = {r["column"]: r.n_unique / r.n_rows for r in profile.collect()}
    assert 0.9 < share["member_number"] < 0.98
    assert profile.filter(id_like()).count() == 0
    key = {r["column"]: r for r in I.answer_key(
        df, "y", "1", {"status_code": "noisy_copy", "adjuster_touches": "post_label"}).collect()}
    assert key["status_code"].agreement == pytest.approx(0.94, abs=0.02)
    counts = df.groupBy("y").agg(F.avg("adjuster_touches").alias("m")).collect()
    means = {r.y: r.m for r in counts}
    assert means[0] == pytest.approx(1.6, abs=0.15) and means[1] == pytest.approx(3.8, abs=0.3)


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\n1,NA,x,True\n2,3.5,nan,False\n3,,N/A,true\n")
    df = tables.read_table(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, None, "x", True), (2, 3.5, None, False), (3, None, None, True)]
    again = tables.with_row_id(df)
    assert sorted(r.row_id for r in again.collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="unique"):
        tables.with_row_id(df.withColumn("k", F.lit(1)), key="k")


def test_canonical_writer_is_order_insensitive(spark, base, tmp_path):
    hashes = []
    for i, df in enumerate((base, base.repartition(9))):
        out = str(tmp_path / f"o{i}")
        tables.write_canonical(df.limit(2000), out, ["row_id"])
        files = fingerprint.file_fingerprints(spark, out + "/*.csv").collect()
        text = "".join(sorted(open(f.path.replace("file:", "")).read() for f in files))
        hashes.append(sorted(line for line in text.splitlines()))
    assert hashes[0] == hashes[1]
    a, b = (fingerprint.table_fingerprint(d).first() for d in (base, base.repartition(9)))
    assert a == b
    changed = base.withColumn("noise", F.when(F.col("row_id") == 5, 0.0).otherwise(F.col("noise")))
    assert fingerprint.table_fingerprint(changed).first() != a


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (None, "n", 1), (4, "d", 1),
                               (4, "d", 1)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "z", None), (3, "new", 1), (None, "n", 1)],
                              "k int, v string, w int")
    got = {r.k: (r.change, r.columns) for r in tables.table_diff(a, b, ["k"]).collect()}
    assert got == {2: ("changed", ["v", "w"]), 3: ("added", []), 4: ("duplicate", [])}


def test_validation(spark):
    df = spark.createDataFrame(
        [("leakage", "modeler", ["x"], 0), ("leakage", "modeler", [], 0),
         ("odd", "modeler", ["x"], 0), ("other", None, [], 0)],
        "category string, target_node string, columns array<string>, raised_at_iteration int")
    good, bad = tables.validate(df, tables.objection_rules())
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["category", "column_required",
                                                       "target_node"]
    arrays = spark.sql("select array(named_struct('mean', 2D), named_struct('mean', 1D)) a union "
                       "all select array(named_struct('mean', 1D), named_struct('mean', 2D))")
    assert sorted(r[0] for r in arrays.select(tables.sorted_descending(F.col("a"))).collect()) == [
        False, True]


def test_results_round_trip(spark, tmp_path):
    old = tmp_path / "old.jsonl"
    old.write_text('{"run_id": "o", "node_seconds": {"a": 1.5}}\n\n{"run_id": "p"}\n')
    rows = results.read_results(spark, str(old))
    assert rows.count() == 2 and rows.filter("commit is null").count() == 2
    assert rows.filter("run_id = 'o'").first().node_seconds == {"a": 1.5}
    gate = spark.createDataFrame([("o", True), ("p", False)], "run_id string, publishable boolean")
    out = str(tmp_path / "out")
    plain = rows.drop("source_file")
    assert results.append_results(plain, gate, out) == {"written": 1, "refused": 1}
    assert results.append_results(plain, gate, out) == {"written": 1, "refused": 1}
    assert results.read_results(spark, out).count() == 2
    metrics = spark.createDataFrame([("r", "auc", 0.5)], "run_id string, name string, value double")
    results.append_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.schema(results.METRICS).json(str(tmp_path / "m")).first().value == 0.5


def test_commits_can_be_repeated_and_a_divided_gate_refuses(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", 2.5), ("c", 3.5)], "run_id string, cost_usd double")
    plan = spark.createDataFrame([("a", "k/team", 0, 7)], "run_id string, cell string, replicate long, run_index long")
    gate = spark.createDataFrame([("a", True), ("b", True), ("b", True), ("c", True), ("c", False)],
                                 "run_id string, publishable boolean")
    named, out = runplan.annotate(rows, "core", "night-1", plan), str(tmp_path / "out")
    for _ in range(2):
        assert results.commit_results(named, gate, out, day="2024-02-03", batch="b1") == {
            "written": 2, "refused": 1}
    results.commit_results(named.where("run_id = 'a'"), gate, out, day="2024-02-04", batch="b1")
    got = sorted((r.run_id, r.cell, r.run_index, r.eval_subset, r.eval_name) for r in results.read_results(
        spark, out).collect())
    assert got == [("a", "k/team", 7, "core", "night-1")] * 2 + [("b", None, None, "core", "night-1")]
    assert (tmp_path / "out/day=2024-02-03/eval_name=night-1/batch=b1").is_dir()
    with pytest.raises(ValueError, match="batch"):
        results.commit_results(named, gate, out, day="2024-02-03", batch="../x")


def test_registry(spark, tmp_path):
    def write(name, ids):
        path = tmp_path / name
        path.write_text(json.dumps({"datasets": [
            {"dataset_id": i, "target": "y", "n_rows": n, "known_leakage": [
                {"column": "c", "kind": "k", "why": "w"}]} for i, n in ids], "excluded": []}))
        return registry.registry(spark, str(path))

    a, b = write("a.json", [("x", 1), ("w", 2)]), write("b.json", [("z", 3)])
    both = registry.combine(fixture=a, benchmark=b)
    assert [r.dataset_id for r in registry.listing(both).collect()] == ["w", "x", "z"]
    assert registry.known_leakage(both).count() == 3
    with pytest.raises(ValueError, match="more than one"):
        registry.combine(fixture=a, benchmark=write("c.json", [("x", 9)]))
    with pytest.raises(ValueError, match="unknown"):
        registry.find(both, "nope")
    got = {r.dataset_id: r.change for r in registry.drift(
        a, write("d.json", [("x", 5), ("n", 1)])).collect()}
    assert got == {"x": "changed", "w": "removed", "n": "added"}
