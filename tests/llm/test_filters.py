import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from auditspark.llm import decontaminate, mixing, quality_rules, queries, simhash_pivots
from auditspark.llm import substring_dedup


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_statistics_and_base_rule_match_plain_python(spark, sf001):
    texts = dict(documents(spark, sf001))
    for r in queries.op7_quality_rules(spark, sf001).collect():
        want = brute.statistics(texts[r.doc_id])
        assert tuple(r[s] for s in quality_rules.STATISTICS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_verdict_follows_the_quality_labels(spark, sf001):
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    judged = queries.op7_quality_rules(spark, sf001).join(labels, "doc_id").where("NOT base_failed")
    rows = judged.select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.35


def test_votes_of_two_honest_rules_outweigh_a_noisy_one():
    patterns = [((1, 1, 1), 400), ((1, 1, -1), 390), ((-1, -1, 1), 100), ((-1, -1, -1), 110)]
    model = quality_rules.em(patterns, ["a", "b", "noise"])
    assert abs(model.prior - 0.79) < 0.02
    assert model.habits["a"][1][0] > 0.99 and abs(model.habits["noise"][1][0] - 0.5) < 0.05


def test_quality_rules_on_odd_rows(spark, odd_docs):
    got = quality_rules.judge(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(not r.kept for r in got if not r.n_words)
    assert quality_rules.judge(odd_docs.limit(0)).count() == 0


def test_simhash_components_match_all_pairs(spark, sf001):
    docs = documents(spark, sf001)
    fps = [(d, brute.fingerprint(t)) for d, t in docs]
    want = dict(zip([d for d, _ in docs], brute.component_ids(fps), strict=True))
    got = queries.op9_simhash(spark, sf001).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(fps)
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("block, finer", [(2000, 2), (60, 0), (60, 1)])
def test_dense_groups_link_as_all_pairs_do(spark, block, finer):
    import random

    rng = random.Random(5)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 400:  # a ball with a rim that only chains reach
        f = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 7, 9])):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    rows = list(enumerate(sorted(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    table = spark.createDataFrame(signed, "node long, fp long")
    joined = simhash_pivots.components(simhash_pivots.near_links(
        table, block=block, finer=finer))
    got = {r.node: r.component for r in joined.collect()}
    assert [got.get(i, i) for i, _ in rows] == brute.component_ids(rows)


def test_simhash_on_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [(r.doc_id, brute.fingerprint(r.text)) for r in rows]
    want = sorted(((d, c) for (d, _), c in zip(fps, brute.component_ids(fps), strict=True)), key=str)
    got = [(r.doc_id, r.component_id) for r in simhash_pivots.near_duplicates(odd_docs).collect()]
    assert sorted(got, key=str) == want
    assert simhash_pivots.near_duplicates(odd_docs.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substring_dedup_matches_plain_python(spark, sf001):
    docs = documents(spark, sf001)
    want = {d: (n, g, sha(t)) for (d, _), (n, g, t) in zip(docs, brute.substring(docs), strict=True)}
    got = queries.op10_substring_dedup(spark, sf001).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_branching_periodic_and_nested_repeats(spark, seed):
    import random

    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(20, 140))]
            for _ in range(6)] + [["x"] * 120, ["u", "v"] * 70]
    docs = [(i, " ".join(w for _ in range(rng.randint(1, 5)) for p in [rng.choice(pool)]
                         for w in p[rng.randint(0, 15):])) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (12, 50):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text)
               for r in substring_dedup.remove_repeats(frame, window).collect()}
        assert got == dict(zip([d for d, _ in docs], brute.substring(docs, window), strict=True))


def test_substring_dedup_on_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(
        rows, brute.substring([(r.doc_id, r.text) for r in rows]), strict=True))
    got = substring_dedup.remove_repeats(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in got)
    assert substring_dedup.remove_repeats(odd_docs.limit(0)).count() == 0


def test_decontamination_matches_plain_python(spark, sf001):
    docs = documents(spark, sf001)
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select(
        "item_id", "text").collect()]
    want = dict(zip([d for d, _ in docs], brute.contamination(docs, items), strict=True))
    got = queries.op4_decontamination(spark, sf001).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            for r in got} == want


def test_decontamination_of_short_common_and_odd_items(spark, odd_docs):
    items = spark.createDataFrame(
        [(1, "A, b c"), (2, ""), (None, "p1 p2 p3"), (4, None), (5, "X x x x X"), (5, "É 日本"),
         (6, " ".join(f"w{i}" for i in range(5, 40))), (7, "absent words")], "item_id long, text string")
    rows = odd_docs.collect()
    pairs = [(r.item_id if r.item_id is not None else "", r.text) for r in items.collect()]
    want = brute.contamination([(r.doc_id, r.text) for r in rows], pairs)
    got = decontaminate.decontaminate(odd_docs, items)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, len(r.item_ids), sha(",".join(r.item_ids)),
                   r.contaminated) for r in got.collect()) == sorted(
        (str(r.doc_id), *x) for r, x in zip(rows, want, strict=True))
    assert not [r for r in decontaminate.decontaminate(odd_docs, items.limit(0)).collect() if r.n_hit]
    assert decontaminate.decontaminate(odd_docs.limit(0), items).count() == 0


def test_proximity_finds_a_passage_with_words_put_in(spark):
    item = [f"k{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:8] + ["new"] + item[8:])),
                                  (3, " ".join(reversed(item)))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    near = decontaminate.proximity_matches(docs, items, slop=1)
    assert {r.doc_id for r in near.collect()} == {1, 2}


def test_mix_meets_every_target_exactly(spark, sf001):
    got = queries.op3_mixing(spark, sf001).join(
        spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "source"), "doc_id")
    rows = got.groupBy("source").agg(
        F.sum("size").alias("s"), F.max("source_size").alias("ss"), F.max("target").alias("t"),
        F.sum("taken").alias("k"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    want = brute.targets({r.source: r.s for r in rows})
    for r in rows:
        assert r.s == r.ss and abs(r.t - want[r.source]) < 1e-6 * max(1, r.t)
        assert r.k == int(r.t) and r.over <= 0


def test_mix_on_odd_rows(spark, odd_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute.targets(sizes)
    for source, target in want.items():
        rows = [r for r in got if r.source == source]
        assert abs(rows[0].target - target) < 1e-6 * max(1, target)
        assert sum(r.taken for r in rows) == int(rows[0].target)
    assert mixing.mix(odd_docs.limit(0)).count() == 0
