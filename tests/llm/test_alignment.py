import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditspark.llm import queries, token_alignment
from auditspark.llm.token_alignment import EMPTY, Fragment


@pytest.fixture(scope="module")
def reference():
    """Both tokenizers by their own libraries: a text's (ids, token bytes) of each."""
    a = Tokenizer.from_file(token_alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_BPE)
    letters = token_alignment._letters()

    def encode(text):
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        return ([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in x],
                [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                  else b.id_to_piece(i).replace("▁", " ").encode()) for i in y])

    return encode


def brute(docs, encode):
    """docs: (doc_id, text); the digest columns of each."""
    groups = []
    for _, text in docs:
        found = []
        if text:
            x, y = encode(text)
            whole = (" " + text).encode()
            if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y):
                i = j = at = bt = 0
                one = ([], [])
                while i < len(x) or j < len(y):
                    if at <= bt:
                        one[0].append(x[i][0])
                        at += len(x[i][1])
                        i += 1
                    else:
                        one[1].append(y[j][0])
                        bt += len(y[j][1])
                        j += 1
                    if at == bt:
                        found.append(one)
                        one = ([], [])
        groups.append(found)
    links = [Counter((p, q) for a, b in g for p in a for q in b) for g in groups]
    held = Counter(k for c in links for k in c)
    top = {}
    for (p, _), n in held.items():
        top[p] = max(n, top.get(p, 0))
    out = []
    for (doc, _), g, c in zip(docs, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(m for k, m in c.items() if held[k] == top[k[0]]), sum(m * held[k] for k, m in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(spark, docs, tmp_path):
    spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, row long, pair long, "
                          "groups string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()), key=repr)


def test_whole_table_matches_plain_python(spark, sf001, reference):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in queries.op11_token_alignment(spark, sf001).collect()), key=repr)
    assert found == brute(docs, reference)


ODD = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "a  b\n\n c\td "), (5, "<|endoftext|> <s> </s>"), (5, "twice"),
       (5, "twice"), (6, "日本語 text 😀 ünï"), (7, "zero\x00width"), (8, "▁ low line"), (9, "ｆｕｌｌ width ﬁ"),
       (10, "x" * 3_000), (11, "aqz" * 900 + " " + "9" * 1_000)]


def test_odd_rows(spark, tmp_path, reference):
    assert got(spark, ODD, tmp_path) == brute(ODD, reference)


@pytest.mark.parametrize("fan, listed, broadcast", [(16, 4_096, 10 ** 6), (2, 4, 0)])
def test_stretches_compose_to_the_whole(spark, tmp_path, monkeypatch, reference, fan, listed, broadcast):
    monkeypatch.setattr(token_alignment, "FAN", fan)
    monkeypatch.setattr(token_alignment, "LISTED", listed)
    rng = random.Random(1)
    words = ["the", "Thtion", "naïve", "日本", "don't", "3.14", "\n", "  ", "wh’at", "a", "qzx" * 30]
    docs = [*ODD, *[(20 + i, " ".join(rng.choices(words, k=rng.randint(1, 400)))) for i in range(25)],
            (60, "plain words " * 300 + "▁ spoils it"), (61, "x" * 2_000 + " tail")]
    align = token_alignment.align
    monkeypatch.setattr(token_alignment, "align", lambda d: align(d, long=300, stretch=120, broadcast=broadcast))
    assert got(spark, docs, tmp_path) == brute(docs, reference)


def test_an_empty_table_gives_an_empty_table(spark, tmp_path):
    assert got(spark, [], tmp_path) == []


ENDS = st.lists(st.integers(1, 60), min_size=1, max_size=25, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.lists(st.integers(0, 60), max_size=8), st.randoms())
def test_fragments_of_any_ranges_compose_in_any_grouping(ends_a, ends_b, cuts, rng):
    ends_a, ends_b = ([*e, 61] for e in (ends_a, ends_b))
    streams = [(list(range(len(e))), e) for e in (ends_a, ends_b)]
    whole = Fragment.of(*streams[0], *streams[1])
    edges = [0, *sorted(cuts), 61]
    parts = [Fragment.of(*[x for ids, ends in streams for x in (
        [i for i, e in zip(ids, ends, strict=True) if low < e <= high], [e for e in ends if low < e <= high])])
        for low, high in zip(edges, edges[1:], strict=False)]
    assert reduce(Fragment.then, parts, EMPTY).groups() == whole.groups()
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i:i + 2] = [parts[i].then(parts[i + 1])]
    assert parts[0] == whole


def test_pieces_join_to_the_groups(spark):
    text = "some plain words here " * 40
    docs, pieces = token_alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), long=200, stretch=90)
    rows = pieces.orderBy("seq", "half").collect()
    n = docs.first()
    assert len(rows) > 5 and ";".join(r.groups for r in rows).count(";") == n.n_groups - 1
    assert pieces.where(F.col("only")).count() == 0
