import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from auditspark.llm import conversation_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string, pos int, k1 string"


def brute(rows):
    """rows: (conv_id, turn, role, text); one row per node of the rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(head, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(found) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n],
         hashlib.sha256(",".join(str(c) for c in m if whole[c] == n).encode()).hexdigest())
        for n, m in members.items())


def got(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=lambda r: (r[0], r[1]))


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    return queries.op12_prefix_trie(spark, str(tmp_path))


def test_whole_table_matches_plain_python(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_prefix_trie(spark, sf001)) == brute(rows)


@pytest.mark.parametrize("conversations, turns", [(3, 1_000), (2_048, 5), (2_048, 65_536)])
def test_shards_of_any_size_give_one_trie(spark, tmp_path, monkeypatch, conversations, turns):
    monkeypatch.setattr(conversation_trie, "CONVERSATIONS", conversations)
    monkeypatch.setattr(conversation_trie, "TURNS", turns)
    rng = random.Random(3)
    rows = [(c, t, "ab"[t % 2], rng.choice(["x", "y", "é"]) * rng.randint(0, 2))
            for c in rng.sample(range(-300, 9_000), 250) for t in range(rng.randint(1, 14))]
    rows += [(c, t, "a", "same") for c in range(10_000, 10_200) for t in range(4)]
    assert got(run(spark, rows, tmp_path)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    long = "word " * 50_000
    rows = [(1, None, None, None), (1, 0, "a", ""), (1, 0, "a", ""), (1, 0, None, "b"), (None, 1, "a", "b"),
            (2, 1, "a", long), (3, 1, "a", long), (7, 2, "b", "c"), (7, 1, "b", "c")]
    rows += [(9, t, "a", str(t % 3)) for t in range(400)] + [(12, t, "a", str(t % 3)) for t in range(390)]
    # role and text are not run together
    rows += [(10, 1, "ab", "c"), (15, 1, "a", "bc"), (20, 1, "ab", "c")]
    assert got(run(spark, rows, tmp_path)) == brute(rows)


def test_an_empty_table_has_no_node(spark, tmp_path):
    assert run(spark, [], tmp_path).count() == 0
    nodes, ends = conversation_trie.trie(conversation_trie.plain(spark.createDataFrame(
        [(4, 1, "a", "b"), (5, 1, "a", "b"), (6, 1, "c", "d")], "conv_id long, turn int, role string, text string")))
    assert sorted(tuple(r)[2:] for r in nodes.collect()) == [
        (4, 0, None, 3, 2, 2, 1), (4, 1, 4, 2, 0, 1, 1), (6, 1, 4, 1, 0, 1, 0)]
    assert sorted(i for r in ends.collect() for i in r.ends) == [4, 5, 6]
