"""Split laws: quotas, completeness, determinism, and no leak between the sides."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditspark.operators import ranking
from auditspark.operators import split as S
from auditspark.operators.naming import opaque_names, rename_map, rename_names
from auditspark.sources.fingerprint import table_fingerprint


@pytest.fixture(scope="module")
def table(spark):
    labels = ["a"] * 500 + ["b"] * 120 + [None] * 10 + ["solo"] + ["two"] * 2
    return spark.createDataFrame(
        [(i, y, i * 0.5) for i, y in enumerate(labels)], "row_id bigint, y string, x double"
    ).repartition(6)


@pytest.mark.parametrize("limit", [None, 30])
def test_withheld_quota_per_class(table, limit):
    flagged = S.withhold(table, "y", 0.2, small_group=limit)
    taken = Counter(r.y for r in flagged.filter("withheld").collect())
    assert taken == {"a": 100, "b": 24, None: 2, "two": 1}
    same = S.withhold(table.repartition(2), "y", 0.2)
    ids = {r.row_id for r in flagged.filter("withheld").select("row_id").collect()}
    assert ids == {r.row_id for r in same.filter("withheld").select("row_id").collect()}


def test_partition_is_the_source(table):
    agent, held = S.partition(S.withhold(table, "y", 0.2))
    both = agent.unionByName(held)
    assert table_fingerprint(both).collect() == table_fingerprint(table).collect()
    assert S.row_overlap(agent, held).count() == 0
    assert S.row_overlap(held, table).count() == held.count()


@pytest.mark.parametrize("limit", [None, 40])
def test_pinned_split_quotas(table, limit):
    df = table.filter("y in ('a', 'b')")
    assignment = S.pin_split(df, "y", small_group=limit)
    S.verify_split(df, assignment)
    by = Counter((r.y, r.part) for r in S.attach(df, assignment).collect())
    n_test = math.ceil(0.2 * 620)
    assert by[("a", "h")] + by[("b", "h")] == n_test == 124
    assert by[("a", "h")] == 100 and by[("b", "h")] == 24
    for c in "ab":
        sizes = [by[(c, str(k))] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    per_fold = [by[("a", str(k))] + by[("b", str(k))] for k in range(5)]
    assert max(per_fold) - min(per_fold) <= 1


def test_quotas_hold_where_every_row_is_a_class(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("y"))
    parts = Counter(r.part for r in S.pin_split(df, "y").collect())
    assert parts["h"] == 21
    assert sorted((parts[str(k)] for k in range(5)), reverse=True) == [17, 17, 16, 16, 16]


def test_many_classes_are_stratified_and_the_applied_rule_is_recorded(spark):
    df = spark.range(2000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 25).alias("y"))
    spec = S.SplitSpec()
    assignment = S.pin_split(df, "y", spec)
    by = Counter((r.y, r.part) for r in S.attach(df, assignment).collect())
    assert {n for (_, part), n in by.items() if part == "h"} == {16}
    assert max(by.values()) - min(by.values()) <= 4  # folds of 12 or 13 beside holdouts of 16
    assert S.split_manifest(assignment, spec, "y").first().strategy == "stratified"
    narrow = S.SplitSpec(max_classes=20)
    drawn = S.pin_split(df, "y", narrow)
    assert drawn.filter("part = 'h'").count() == 400
    assert S.split_manifest(drawn, narrow, "y").first().strategy == "random"


@pytest.mark.parametrize("k", [2, 5])
def test_classes_as_a_table_are_dealt_like_classes_on_the_driver(spark, k):
    rng = random.Random(k)
    labels = ["hot"] * 700 + [f"c{rng.randrange(300)}" for _ in range(900)] + [None] * 3
    df = spark.createDataFrame([(i * 7 - 300, y) for i, y in enumerate(labels)], "row_id long, y string")
    spec = S.SplitSpec(folds=k)
    want = {r.row_id: r.part for r in S.pin_split(df, "y", spec).collect()}
    got = S.pin_split(df.repartition(5), "y", spec, driver_classes=10)
    assert {r.row_id: r.part for r in got.collect()} == want and len(want) == len(labels)
    assert S.split_manifest(got, spec, "y").first().strategy == "stratified"


def test_a_hundred_thousand_classes_are_stratified(spark):
    rows = spark.range(250_000)
    df = rows.select(F.col("id").alias("row_id"), F.when(F.col("id") < 50_000, "hot").otherwise(
        (F.col("id") % 100_000).cast("string")).alias("y"))
    assignment = S.pin_split(df, "y")
    S.verify_split(df, assignment)
    parts = {r.part: r.n for r in S.part_counts(assignment).collect()}
    assert parts["h"] == 50_000 and max(parts[str(i)] for i in range(5)) - min(
        parts[str(i)] for i in range(5)) <= 1
    hot = {r.part: r.n for r in S.part_counts(
        S.attach(df, assignment).where("y = 'hot'").select("row_id", "part")).collect()}
    assert hot == {"h": 10_000, **{str(i): 8_000 for i in range(5)}}
    flagged = S.withhold(df, "y", 0.2, small_group=1_000)
    per = flagged.groupBy("y").agg(F.count("*").alias("n"), F.count_if("withheld").alias("w"))
    assert per.where("w <> least(greatest(1, floor(0.2 * n)), n - 1)").count() == 0


def test_places_number_every_group_by_draw_and_tie(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.choice([0, 5, 2**51, 2**52 - 1, rng.randrange(2**52)]), i) for i in range(400)]
    got = ranking.draw_places(spark.createDataFrame(rows, "grp string, key long, tie long")).collect()
    for g in "ab":
        own = sorted((key, tie) for grp, key, tie in rows if grp == g)
        assert sorted((r.place, (r.key, r.tie)) for r in got if r.grp == g) == list(enumerate(own, 1))
        assert {r.size for r in got if r.grp == g} == {len(own)}


def test_manifest_and_refusals(table):
    spec = S.SplitSpec()
    assignment = S.pin_split(table, "y", spec)
    manifest = S.split_manifest(assignment, spec, "y")
    S.verify_split(table, assignment, manifest)
    again = S.split_manifest(assignment.repartition(3), spec, "y")
    assert manifest.first().digest == again.first().digest
    with pytest.raises(ValueError, match="not_in_frame"):
        S.verify_split(table.filter("row_id > 5"), assignment)
    with pytest.raises(ValueError, match="unassigned"):
        S.verify_split(table, assignment.filter("row_id > 5"))
    with pytest.raises(ValueError, match="assigned_twice"):
        S.verify_split(table, assignment.unionByName(assignment.filter("row_id = 3")))
    with pytest.raises(ValueError, match="count_mismatch"):
        moved = assignment.withColumn("part", F.when(F.col("row_id") == 1, "h").when(
            F.col("row_id") == 0, "h").otherwise(F.lit("1")))
        S.verify_split(table, moved, manifest)
    for strategy in ("temporal", "grouped"):
        with pytest.raises(ValueError, match="not supported"):
            S.SplitSpec(strategy=strategy)


def test_expand_folds_uses_the_complement(table):
    assignment = S.pin_split(table, "y")
    wide = S.expand_folds(assignment, 5)
    n_train = assignment.filter("part <> 'h'").count()
    assert wide.count() == 5 * n_train
    assert wide.filter("role = 'valid'").count() == n_train
    fold = S.fold_train(S.attach(table, assignment), 2)
    assert fold.filter("part in ('h', '2')").count() == 0


def test_renaming(spark, table):
    assert rename_map(["x", "y", "z"], "y") == {"x": "var_01", "z": "var_02", "y": "y"}
    renamed = opaque_names(table, "y", keep=["row_id"])
    assert renamed.columns == ["row_id", "y", "var_01"]
    with pytest.raises(ValueError, match="not a column"):
        rename_map(["x"], "y")
    names = spark.range(1).select(F.array(F.lit("x"), F.lit("q")).alias("n"))
    assert names.select(rename_names(F.col("n"), {"x": "var_01"})).first()[0] == ["var_01", "q"]


def test_rename_leaves_the_carve_unchanged(table):
    a = S.prepare(table, "y", 0.2)
    b = S.prepare(table, "y", 0.2, naming="opaque")
    assert {r.row_id for r in a.withheld.collect()} == {r.row_id for r in b.withheld.collect()}
    with pytest.raises(ValueError, match="fewer than two classes"):
        S.prepare(table.filter("y = 'a'"), "y", 0.2)
    assert S.prepare(table, "y", 0).withheld is None


def test_withholding_from_many_classes_gathers_no_hot_label(spark, monkeypatch):
    rows = [(i, "hot" if i % 2 else str(i // 6), i * 0.5) for i in range(3_000)] + [(-1, None, 0.0), (-2, "solo", 0.0)]
    df = spark.createDataFrame(rows, "row_id bigint, y string, x double")
    want = {tuple(r) for r in S.withhold(df, "y", 0.3).collect()}
    cuts = {tuple(r) for r in S.withhold(df, "y", 0.3, small_group=1_000).collect()}
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 100)
    many = S.withhold(df.repartition(5), "y", 0.3, small_group=1_000)
    assert many.columns == [*df.columns, "withheld"]
    # rows only meet by label and prefix of their draw, never by a label alone
    assert "hashpartitioning(__label" not in many._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in many.collect()]
    assert len(got) == len(rows) and set(got) == want == cuts


def test_classes_as_a_table_are_sorted_once_and_split_ties_by_label(spark, monkeypatch):
    # thirty classes of each of four sizes: those of one size tie, and more than a part is topped up
    labels = [f"c{c:03d}" for c in range(120) for _ in range((1, 4, 6, 9)[c % 4])]
    df = spark.createDataFrame(list(enumerate(labels)), "row_id long, y string")
    sorts, index = [], ranking.dense_index
    monkeypatch.setattr(ranking, "dense_index", lambda *a, **k: sorts.append(a) or index(*a, **k))
    for fraction in (0.2, 0.1, 0.37):
        spec = S.SplitSpec(fraction=fraction)
        want = {r.row_id: r.part for r in S.pin_split(df, "y", spec).collect()}
        sorts.clear()
        got = {r.row_id: r.part for r in S.pin_split(df, "y", spec, driver_classes=10).collect()}
        assert got == want and len(sorts) == 1
