import hashlib

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from auditspark.llm import shingle_similarity
from auditspark.llm.common import stored


def shingle_set(text):
    w = brute.WORD.findall((text or "").translate(brute.FOLD))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs):
    """docs: (doc_id, text) rows; all pairs, the smallest id reachable of each."""
    found = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                if 5 * (both := len(a & b)) >= 4 * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def test_run_keeps_one_of_each_group_of_near_copies(spark, sf001):
    docs = stored(corpus_pipeline.quality(spark, spark.read.parquet(f"{sf001}/documents.parquet"), sf001))
    groups = components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in shingle_similarity.near_copies(docs).collect()}
    assert got == groups
    stay = {d for d, c in groups.items() if c == d}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf001).collect()} == stay


def test_run_is_the_stages_by_plain_python(spark, sf001):
    """Every stage but the first, whose verdict is fitted, redone by brute force on what it got."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    good = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.quality(spark, docs, sf001).collect()]
    groups = components([r[:2] for r in good])
    rows = [r for r in good if groups[r[0]] == r[0]]
    cut = brute.substring([r[:2] for r in rows])
    rows = [(d, kept if gone else t, s) for (d, t, s), (n, gone, kept) in zip(rows, cut, strict=True)
            if not gone or gone < n]
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, found in zip(rows, brute.contamination([r[:2] for r in rows], items), strict=True) if not found[4]]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want, taken, left = {}, {}, {s: int(t) for s, t in brute.targets(sizes).items()}
    for s in left:
        whole, left[s] = divmod(left[s], sizes[s]) if sizes[s] else (0, 0)
        taken[s] = whole
    for d, t, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        n = len(brute.WORD.findall(t or ""))
        part = min(n, left[s])
        left[s] -= part
        if n * taken[s] + part:
            want[d] = (t, n * taken[s] + part)
    got = {r.doc_id: (r.text, r.taken) for r in corpus_pipeline.run(spark, sf001).collect()}
    assert got == want and len(got) > 20


def test_a_template_of_many_and_a_group_of_near_copies_make_few_pairs(spark, monkeypatch):
    shared = " ".join(f"t{i}" for i in range(120))
    docs = [(i, shared + " " + " ".join(f"u{i}x{j}" for j in range(40))) for i in range(400)]
    docs += [(1_000 + i, " ".join(f"v{j}" if j != i else f"q{i}" for j in range(400))) for i in range(400)]
    compared = []
    alike = shingle_similarity.alike

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return alike(pairs, *rest)

    monkeypatch.setattr(shingle_similarity, "alike", counted)
    got = {r.doc_id: r.component_id for r in shingle_similarity.near_copies(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(400)) and all(got[1_000 + i] == 1_000 for i in range(400))
    assert sum(compared) < 10_000


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf001, odd_docs):
    names = ["kept", "n_words", "contaminated", "n_hit", "removed", "kept_text", "n_removed", "digest", "part"]
    odd = odd_docs.drop("kept").select("*", *[F.lit(f"mine {c}").alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf001)
        assert got.columns == odd.columns
        for r in got.collect():
            assert all(r[c] == f"mine {c}" for c in names)
        assert stage(spark, odd.limit(0), sf001).count() == 0
    texts = {r.doc_id for r in corpus_pipeline.decontaminated(spark, odd, sf001).collect()}
    assert texts == {r.doc_id for r in odd.collect()}
    cut = brute.substring([(r.doc_id, r.text) for r in odd.collect()])
    stay = sorted(kept for n, gone, kept in cut if not gone or gone < n)
    assert sorted(" ".join(brute.WORD.findall(r.text or "")) for r in corpus_pipeline.substring(
        spark, odd.drop("n_chars"), sf001).collect()) == stay and len(stay) == 11
    assert all(r.n_words >= 50 for r in corpus_pipeline.quality_rules.judge(odd).where("kept").collect())
    mixed = corpus_pipeline.mixed(spark, odd.withColumn("taken", F.lit("mine")), sf001)
    assert {r.taken_before for r in mixed.collect()} == {"mine"}


def test_near_copies_at_the_threshold_and_in_chains(spark):
    def text(i, changed):
        return " ".join(f"x{i}" if i in changed else f"w{i}" for i in range(104))

    # 100 shingles each: one changed word inside loses five, one at the end loses one
    docs = [(4, text(0, ())), (3, text(0, (0, 20))), (9, text(1, (50, 101))), (8, text(2, (50, 80, 101))), (7, "a b")]
    docs += [(100 + i, text(i, (5 * i % 100, 103))) for i in range(60)] + [(6, "A  b"), (5, ""), (2, " ")]
    # 80 of 100 shingles: 8 / 10 exactly, and one below
    docs += [(200, " ".join(f"v{i}" for i in range(94))), (201, " ".join(f"v{i}" for i in range(76))),
             (202, " ".join(f"v{i}" for i in range(19, 94)))]
    got = {r.doc_id: r.component_id for r in shingle_similarity.near_copies(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components(docs) and got[201] == 200 and got[202] == 202


def test_near_copies_on_odd_rows(spark, odd_docs):
    got = corpus_pipeline.near_dedup(spark, odd_docs, "")
    assert got.where("doc_id IS NULL").count() == 2 and got.where("doc_id = 1").count() == 2
    assert {r.doc_id for r in got.collect()} == {None, 1, 2, 5, 6, 9, 10}  # 6 and 7 share a passage
    assert corpus_pipeline.near_dedup(spark, odd_docs.limit(0), "").count() == 0
    assert shingle_similarity.near_copies(odd_docs).where(F.col("doc_id") == 4).first().component_id == 2


def test_simhash_brings_near_copies_together_and_exact_sets_decide(spark, monkeypatch):
    near = [(i, " ".join(f"v{j}" if j != i else f"q{i}" for j in range(400))) for i in range(40)]
    # one fingerprint, sets that share nothing: planted, as such texts are too rare to come by
    apart = [(100, " ".join(f"a{j}" for j in range(60))), (101, " ".join(f"b{j}" for j in range(60)))]
    shared = [(102, " ".join(f"a{j}" for j in range(1, 60))), (103, " ".join(f"b{j}" for j in range(1, 60)))]
    docs = spark.createDataFrame(near + apart + shared, "doc_id long, text string")
    sketches, candidates, seen = shingle_similarity.sketches, shingle_similarity.simhash_pairs, []
    monkeypatch.setattr(shingle_similarity, "sketches", lambda d, width: sketches(d, width).withColumn(
        "fp", F.when(F.col("doc_id") >= 100, F.lit(5)).otherwise(F.col("fp"))))
    # without the completion by shingles only SimHash is left
    monkeypatch.setattr(shingle_similarity, "star_pairs", lambda rows, *_: rows.select(
        F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    monkeypatch.setattr(shingle_similarity, "open_pairs", lambda rows, *_: rows.select(
        F.col("node").alias("u"), F.col("node").alias("v")).limit(0))

    def watched(marked):
        found = candidates(marked)
        seen.extend((r.u, r.v) for r in found.collect())
        return found

    monkeypatch.setattr(shingle_similarity, "simhash_pairs", watched)
    got = {r.doc_id: r.component_id for r in shingle_similarity.near_copies(docs).collect()}
    assert sum(got[i] == 0 for i in range(40)) > 30
    assert (100, 101) in seen and got[101] == 101 and got[102] == 100
    assert max(sum(v == i for _, v in seen) for i in range(40)) <= shingle_similarity.CENTRES
