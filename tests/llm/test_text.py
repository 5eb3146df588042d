import json
import random

import pytest
from pyspark.sql import functions as F

from auditspark.llm import chat_format, html_extract, language_id, quality_classifier, queries
from auditspark.llm import token_counts


def test_scores_separate_held_out_quality(spark, sf001):
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    rows = queries.op1_quality_classifier(spark, sf001).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(rows) > 40 and sum(right) / len(right) > 0.93
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97


def test_cosines_approximate_the_gaussian_kernel():
    import numpy as np

    d = len(quality_classifier.FEATURES)
    model = quality_classifier.QualityModel([0.0] * d, [1.0] * d, [], [0.0], [0.5], 7)
    x = np.random.default_rng(1).normal(size=(40, d)) * 0.7
    z = model.cosines(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert abs(z @ z.T - np.exp(-apart / (2 * d))).max() < 0.25


def test_pooling_is_the_isotonic_fit():
    knots, levels = quality_classifier.pooled(
        [(0.1, 10, 1.0), (0.2, 10, 5.0), (0.3, 10, 3.0), (0.4, 10, 9.0)])
    assert knots == pytest.approx([0.1, 0.25, 0.4])
    assert levels == pytest.approx([0.1, 0.4, 0.9], abs=0.01)


def test_classifier_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame(
        [(1, 1), (3, 0), (4, 0), (6, 1), (7, 1), (9, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = quality_classifier.classify(odd_docs, labels.limit(0)).collect()
    assert len({r.score for r in empty}) <= len(empty) and all(r.predicted == 1 for r in empty)
    assert quality_classifier.classify(odd_docs.limit(0), labels).count() == 0


def page(lang, text, declared=True):
    return f"<html{f' lang={lang!r}' if declared else ''}><body><article><p>{text}</p></article></body></html>"


def test_language_of_real_pages_follows_their_text(spark, sf001):
    rows = queries.op2_language_id(spark, sf001).collect()
    stated = [(r.lang, r.declared) for r in rows if r.declared]
    assert len(rows) == spark.read.parquet(f"{sf001}/pages.parquet").count()
    assert sum(a == b for a, b in stated) / len(stated) > 0.95
    assert all(0 < r.probability <= 1 + 1e-9 for r in rows)


def test_evidence_decides_where_the_text_is_silent(spark):
    docs = spark.createDataFrame(
        [("en", "the of and that with " * 20), ("de", "der die und das nicht " * 20), (None, "x"),
         ("fr", None)], "lang string, text string")
    rows = [(i, f"https://a.example.de/{i}", page("de", "der und die das nicht der die")) for i in range(30)]
    rows += [(100 + i, f"https://b.example.com/{i}", page("en", "the that and with of the")) for i in range(30)]
    rows += [(200, "https://a.example.de/x", page("de", "", False)), (201, "https://new.example.com/x", page("en", "")),
             (202, None, None), (203, "", ""), (203, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert {got[i].lang for i in range(30)} == {"de"} and {got[100 + i].lang for i in range(30)} == {"en"}
    assert got[200].lang == "de" and got[201].lang == "en" and got[202].lang in ("de", "en")
    assert language_id.identify(pages, docs).count() == len(rows)
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert language_id.identify(pages, docs.limit(0)).where("lang IS NULL").count() == len(rows)


@pytest.fixture(scope="session")
def vocabulary():
    return token_counts.Vocabulary.read(token_counts.DEFAULT_MODEL)


def library(vocabulary):
    """The unigram lattice of a public library over the same pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -1e9) for i in range(256)], *vocabulary.scores.items()]
    low = min(vocabulary.scores.values())
    pieces = [(p, low if s == -1e9 else s) for p, s in pieces]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_a_public_unigram_lattice(spark, sf001, vocabulary):
    counter, other = token_counts.Counter(vocabulary), library(vocabulary)
    texts = [r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").select("text").limit(300).collect()]
    texts += ["a", "  two  spaces ", "日本 é 😀x", "tabs\tand\nlines", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    for text in texts:
        assert counter.count(text)[1] == len(other.encode(text, add_special_tokens=False).ids), text


def test_ties_unknowns_and_sums_follow_the_lattice_rules():
    v = token_counts.Vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, "abc": -9.0, "▁": -0.5})
    counter = token_counts.Counter(v)
    assert counter.stretch("ab") == (-2.0, 1)  # a tie goes to the piece that begins first
    assert counter.stretch("abc") == (-9.0, 1)
    assert counter.stretch("é") == (-19.0, 2)

    def brute(text):
        best = {0: (0.0, 0)}
        for begin in range(len(text)):
            score, n = best[begin]
            options = [(p, s, 1) for p, s in v.scores.items() if text.startswith(p, begin)]
            if not any(len(p) == 1 for p, _, _ in options):
                options.append((text[begin], -19.0, len(text[begin].encode())))
            for p, s, k in options:
                end = begin + len(p)
                if end not in best or score + s > best[end][0]:
                    best[end] = (score + s, n + k)
        return best[len(text)]

    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 12)))
        assert counter.stretch(text) == brute(text)


def test_token_counts_on_odd_rows(spark, odd_docs, vocabulary):
    rows = token_counts.count_tokens(odd_docs, vocabulary).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.n_tokens == 0) == (not r.text) for r in rows)
    assert token_counts.count_tokens(odd_docs.limit(0), vocabulary).count() == 0


def test_calls_meet_results_in_order_and_are_validated(spark):
    turns = [(1, 0, "system", "s")]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    calls = spark.createDataFrame([
        (1, "c", 5, "add", '{"b": 2, "a": 1}', ["b"]), (1, "b", 3, "add", '{"a": "x", "z": 1}', ["a"]),
        (1, "a", 1, "add", "no json", []), (1, "p", 7, "add", '{"a":1,"b":2}', ["q"]),
        (1, "q", 9, "nope", "{}", ["p"]), (2, None, 1, "add", None, None), (1, "d", 11, "add", '{"a":1,"b":2.5}', ["gone"])],
        "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame(
        [(1, "a", 2, "ok"), (1, "a", 2, "ok"), (1, "zz", 4, None), (2, None, 2, "lost")],
        "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame(
        [("add", "a", "integer", True), ("add", "b", "number", True)],
        "name string, field string, type string, required boolean")
    got = {(r.kind, r.conv_id, r.call_id): r for r in chat_format.format_chats(
        messages, calls, results, schemas).collect()}
    assert [got["call", 1, k].level for k in "abcdpq"] == [0, 1, 2, 0, None, None]
    assert got["call", 1, "c"].json == '{"arguments":{"a":1,"b":2},"id":"c","name":"add","role":"call"}'
    assert got["call", 1, "b"].problems == ["a is no integer", "missing field b", "unknown field z"]
    assert got["call", 1, "a"].problems == ["arguments are no object"]
    assert got["call", 1, "q"].problems == ["unknown tool nope"] and not got["call", 1, "d"].problems
    assert (got["call", 1, "a"].status, got["call", 1, "b"].status) == ("linked", "unanswered")
    assert (got["result", 1, "a"].status, got["result", 1, "zz"].status) == ("linked", "orphan")
    assert got["result", 2, None].status == "orphan" and got["call", 2, None].status == "unanswered"
    assert len(got) == 1 + 7 + 3 and all(isinstance(json.loads(r.json), dict) for r in got.values())


def test_chat_rows_cover_every_turn(spark, sf001):
    turns = spark.read.parquet(f"{sf001}/conversations.parquet")
    got = queries.op6_chat_format(spark, sf001)
    assert got.count() == turns.count() and got.where("problems <> ''").count() == 0
    odd = spark.createDataFrame(
        [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (1, None, "user", "q"), (1, None, "assistant", "a"),
         (1, None, None, None), (2, 1, "user", None), (2, 1, "user", None), (2, 2, "assistant", ""), (None,) * 4],
        turns.select("conv_id", "turn", "role", "text").schema).withColumn("level", F.lit("clash"))
    rows = chat_format.format_chats(*chat_format.from_turns(odd)).collect()
    assert len(rows) == 8  # the repeated call counts once
    assert {(r.conv_id, r.kind, r.status) for r in rows if r.conv_id != 2 and r.kind != "message"} == {
        (None, "call", "unanswered"), (None, "result", "orphan"), (1, "call", "unanswered"), (1, "result", "orphan")}
    assert {r.status for r in rows if r.conv_id == 2} == {"linked"}
    empty = chat_format.format_chats(*chat_format.from_turns(turns.limit(0)))
    assert empty.count() == 0


ARTICLE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li>Home<li>News</ul></nav><!-- ad <p>x</p> --><div class="ad box">Buy</div>
<div id="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header>
<p>One <b>bold
 word</b><br>next<p>Two&nbsp;&lt;tag&gt;</p><script>var t="</p>";</script><form><label>Name</label><input></form>
<ul><li>first<li>second</ul><aside>Related</aside><section class="comments"><p>me too</p></section></article>
<div class="sidebar">Links</div><footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert html_extract.main_text(ARTICLE) == "\n".join(
        ["Title & more", "One bold word next", "Two <tag>", "first", "second"])
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<p>cut <b>off") == "cut off"
    assert html_extract.main_text("a < b <p>c") == "a < b\nc"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html_extract.main_text(long).count("\n") == 19_999


def test_wrappers_find_optional_repeated_and_template_groups():
    pages = [html_extract.groups(html_extract.blocks(p)) for p in (
        "<div class=top>Site</div><div class=body><p>a<p>b</div><div class=low>Imprint</div>",
        "<div class=top>Site</div><div class=body><p>c</div><div class=extra>x</div><div class=low>Imprint</div>")]
    wrapper = html_extract.aligned(*pages)
    assert [(g[0], g[1], g[2], g[3] is not None) for g in wrapper] == [
        ("div.top", False, False, True), ("div.body/p", True, False, False),
        ("div.extra", False, True, True), ("div.low", False, False, True)]


def test_longest_common_sequences_are_longest_and_common():
    rng = random.Random(5)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "xy")
        got = html_extract.common(x, y)
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = max(table[i][j] + 1 if a == b else 0, table[i][j + 1], table[i + 1][j])
        assert len(got) == table[-1][-1] and all(x[i] == y[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
    long = ["h2", "p"] * 6_000
    assert len(html_extract.common(long, ["p"] + long[:9_000] + ["ul"])) == 9_001


def test_unmarked_pages_lose_their_hosts_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=top>Site</div><div><p>text {i}<p>more {i}</div><p>Imprint")
            for i in range(20)]
    rows += [(99, "http://other.example/1", "<div class=top>Site</div><p>alone"), (98, None, None),
             (97, "http://h.example/97", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"text {i}\nmore {i}" for i in range(20))
    assert got[99] == "Site\nalone" and got[98] == got[97] == ""
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_extract_of_the_given_pages_equals_a_plain_reading(spark, sf001):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    for r in queries.op8_html_extract(spark, sf001).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", inner))
        want = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts]
        assert r.text == "\n".join(p for p in want if p) and r.n_chars == len(r.text)
