"""One registered query per operator over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import decontaminate as decontamination
from auditspark.llm import chat_format, conversation_trie, embedding_cells, html_extract, language_id, mixing
from auditspark.llm import quality_classifier
from auditspark.llm import quality_rules, simhash_pivots, substring_dedup, token_counts
from auditspark.llm import token_alignment
from auditspark.llm.common import read_table, streamed_sha256


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(
        read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.Vocabulary.read(token_counts.DEFAULT_MODEL)
    return token_counts.count_tokens(
        read_table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.from_turns(read_table(spark, sf_dir, "conversations"))
    return chat_format.format_chats(*turns).withColumn(
        "problems", F.array_join("problems", "; "))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", *quality_rules.STATISTICS, "base_failed", "kept")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract(pages, ["page_id", "url"]).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pieces = token_alignment.align(read_table(spark, sf_dir, "documents"))
    digests = pieces.where("only").select("row", F.sha2("groups", 256).alias("sha256")).unionByName(
        streamed_sha256(pieces.where("NOT only"), ["row"], ["seq", "half"], "groups", ";"))
    return found.join(digests, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.coalesce("sha256", F.lit("")).alias("groups_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = conversation_trie.trie(
        conversation_trie.rebuilt(read_table(spark, sf_dir, "conversations")))
    return nodes.join(conversation_trie.end_digests(ends), ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_cells.near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_language_id, op3_mixing, op4_decontamination, op5_token_counts,
    op6_chat_format, op7_quality_rules, op8_html_extract, op9_simhash, op10_substring_dedup,
    op11_token_alignment, op12_prefix_trie, op13_embedding_dedup)}

_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][k % 3 + 1] AS weight,
         source_size * 2.0::DOUBLE AS cap FROM r),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
f AS (SELECT arg_min(level, (cap / weight, k)) AS free FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size,
         CASE WHEN free IS NULL THEN cap ELSE least(cap, free * weight) END AS target
  FROM l CROSS JOIN f),
p AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         CAST(floor(floor(target) / source_size) AS BIGINT) * size
         + least(greatest(CAST(floor(target) AS BIGINT)
                 - CAST(floor(floor(target) / source_size) AS BIGINT) * source_size - before, 0), size) END AS BIGINT) AS taken
FROM p
"""

_OP4 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, w[i:i + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM b),
dp AS (
  SELECT doc_id, k, p, w[p:p + k - 1] AS win
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM dw CROSS JOIN k WHERE len(w) >= k)
  WHERE w[p] IN (SELECT win[1] FROM b)),
h AS (SELECT doc_id, b.item_id, p, dp.k FROM dp JOIN b ON dp.k = b.k AND dp.win = b.win),
n AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
m AS (SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h),
c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q
  FROM g JOIN m USING (h) WHERE first_doc < doc_id),
x AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (
  SELECT x.doc_id, string_agg(w[x.q], ' ' ORDER BY x.q) AS kept
  FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""

_OP6 = r"""
WITH u AS (SELECT conv_id, min(turn) AS first_turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
c AS (
  SELECT DISTINCT conv_id, conv_id || ':' || turn AS call_id, turn, text, first_turn
  FROM conversations JOIN u USING (conv_id) WHERE role = 'user'),
r AS (
  SELECT DISTINCT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, text
  FROM conversations WHERE role = 'assistant'),
l AS (SELECT DISTINCT conv_id, call_id, CAST(turn > first_turn AS INTEGER) AS level FROM c),
a AS (SELECT DISTINCT conv_id, call_id FROM r)
SELECT conv_id, 0 AS level, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'plain' AS status, '' AS problems,
       '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
UNION ALL
SELECT c.conv_id, l.level, c.turn, 'call', c.call_id, CASE WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END, '',
       '{"arguments":{"chars":' || length(c.text) || ',"text":' || to_json(c.text) || '},"id":"' || c.call_id || '","name":"reply","role":"call"}'
FROM c JOIN l USING (conv_id, call_id) LEFT JOIN a USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, l.level, r.turn, 'result', r.call_id, CASE WHEN l.call_id IS NULL THEN 'orphan' ELSE 'linked' END, '',
       '{"content":' || to_json(r.text) || ',"id":"' || r.call_id || '","role":"result"}'
FROM r LEFT JOIN l USING (conv_id, call_id)
"""

_OP12 = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, p, md5(length(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM o),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
             lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
n AS (SELECT c.conv_id, h, head, count(k.p) AS lent FROM c LEFT JOIN k ON k.conv_id = c.head AND k.p <= c.h GROUP BY ALL),
r AS (
  SELECT n.conv_id, k.p AS pos, k, bytes FROM n JOIN k ON k.conv_id = n.head AND k.p <= n.h
  UNION ALL
  SELECT n.conv_id, k.p - h + lent, k, bytes FROM n JOIN k USING (conv_id) WHERE k.p > h),
l AS (
  SELECT n.conv_id, count(pos) AS len, coalesce(list(k ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ks,
         coalesce(list(bytes ORDER BY pos) FILTER (pos IS NOT NULL), []) AS sizes
  FROM n LEFT JOIN r USING (conv_id) GROUP BY n.conv_id),
m AS (
  SELECT conv_id, d, len, md5(array_to_string(ks[1:d], ',')) AS node, md5(array_to_string(ks[1:d - 1], ',')) AS up,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, len + 1)) AS d FROM l)),
t AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(up) AS up, min(bytes) AS bytes,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len), '') AS ends
  FROM m GROUP BY node, d),
w AS (
  SELECT t.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM t AS x WHERE x.d = t.d + 1 AND x.up = t.node) AS n_children
  FROM t LEFT JOIN t AS p ON t.d > 0 AND p.d = t.d - 1 AND p.node = t.up),
s AS (
  SELECT m.node, m.d, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * w.bytes) AS saved_tokens
  FROM w JOIN m ON m.conv_id = w.conv_id AND m.d <= w.d GROUP BY m.node, m.d)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM w JOIN s USING (node, d)
"""

_OP13 = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.i, b.i AS j, b.vec_id FROM g AS a JOIN g AS b ON a.label = b.label AND a.i <> b.i AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT i, i AS j FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT r.i, min(v.vec_id) AS component_id FROM r JOIN v ON r.j = v.i GROUP BY r.i),
n AS (SELECT i, count(*) AS n_links FROM l GROUP BY i)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (i) LEFT JOIN n USING (i)
"""

ORACLES = {"op3_mixing": _OP3, "op6_chat_format": _OP6, "op4_decontamination": _OP4, "op10_substring_dedup": _OP10,
           "op12_prefix_trie": _OP12, "op13_embedding_dedup": _OP13}
