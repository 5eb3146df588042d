"""Benchmark decontamination through a positional inverted index of the training words.

The index holds, for the terms that a search needs, where they stand in every document. A search for
an item's windows starts from each window's rarest terms in the corpus: their postings, shifted by
the terms' offsets in the item, must agree on where the item would begin. Only where they do is the
document opened and every word of the item compared at its shifted place. Everything is built-in
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import LOWER, UPPER, stored

#: What stands between words: ASCII other than digits, upper- and lower-case letters.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def terms(text: Column) -> Column:
    """Words of ``text`` with A-Z lower-cased; null has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, _BETWEEN), "")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(``item``, ``offset``, ``term``, ``item_words``) for every word of every item.

    ``item`` numbers the rows by id and text, so rows that share an id stay apart.
    """
    keyed = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).select(
        F.struct(F.col("item_id").alias("id"), F.xxhash64("text").alias("tag")).alias("item"),
        terms(F.col("text")).alias("__t")).dropDuplicates(["item"])
    return keyed.select("item", F.size("__t").alias("item_words"),
                        F.posexplode("__t").alias("offset", "term"))


def search_terms(items: DataFrame, frequency: DataFrame, window: int, rarest: int) -> DataFrame:
    """For every window its ``rarest`` rarest words: (``item``, ``first``, ``offset``, ``term``).

    ``first`` is the window's first word. A window with a word that the corpus lacks occurs nowhere
    and gets no row.
    """
    counted = items.join(frequency, "term", "left")
    length = F.least(F.lit(window), F.col("item_words"))
    windows = counted.withColumn("__length", length).withColumn(
        "first", F.explode(F.sequence(
            F.greatest(F.lit(0), F.col("offset") - F.col("__length") + 1),
            F.least(F.col("offset"), F.col("item_words") - F.col("__length")))))
    per = Window.partitionBy("item", "first")
    order = per.orderBy("n", "term", "offset")
    placed = windows.withColumn("__absent", F.max(F.col("n").isNull()).over(per)).withColumn(
        "__place", F.row_number().over(order))
    return placed.where(~F.col("__absent") & (F.col("__place") <= rarest)).select(
        "item", "first", "offset", "term", "item_words")


def corpus_frequency(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each vocabulary term stands in all texts: (``term``, ``n``)."""
    return docs.select(F.explode(terms(F.col("text"))).alias("term")).join(
        vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The positional index over ``wanted`` terms: (``term``, ``doc``, ``pos``) for every occurrence.

    ``doc`` is the id with the text's hash, so rows that share an id stay apart.
    """
    return docs.select(
        _doc().alias("doc"), F.posexplode(terms(F.col("text"))).alias("pos", "term")).join(
        wanted, "term").select("term", "doc", "pos")


def _doc() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"))


def phrase_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13,
                rarest: int = 2) -> DataFrame:
    """(``doc``, ``item``, ``begin``, ``end``): runs of document words inside item windows.

    Exact: every occurrence of every window, and nothing else.
    """
    items = stored(item_terms(benchmark))
    frequency = stored(corpus_frequency(docs, items.select("term").distinct()))
    searched = stored(search_terms(items, frequency, window, rarest))
    index = stored(postings(docs, searched.select("term").distinct()))
    # rarest first: a window's chosen terms must agree on where its item begins in the document
    places = searched.select("item", "offset", "term").distinct()
    starts = index.join(places, "term").select(
        "doc", "item", "offset", (F.col("pos") - F.col("offset")).alias("start")).distinct()
    needed = searched.groupBy("item", "first").agg(F.count("*").alias("__needed"))
    agreed = starts.join(searched.select("item", "first", "offset"), ["item", "offset"]).groupBy(
        "doc", "item", "start", "first").agg(F.count("*").alias("__found")).join(
        needed, ["item", "first"]).where(F.col("__found") == F.col("__needed"))
    candidates = stored(agreed.select("doc", "item", "start").distinct())
    # the opened documents: every word of the item compared at its shifted place
    opened = docs.join(candidates.select(F.col("doc.id").alias("__id"),
                                         F.col("doc.tag").alias("__tag")).distinct(),
                       F.col("doc_id").eqNullSafe(F.col("__id"))
                       & (F.xxhash64("text") == F.col("__tag")), "left_semi")
    opened = opened.select(_doc().alias("doc"), "text").dropDuplicates(["doc"])
    there = opened.select("doc", F.posexplode(terms(F.col("text"))).alias("pos", "term"))
    expected = candidates.join(items, "item").select(
        "doc", "item", "start", "offset", "item_words", "term",
        (F.col("start") + F.col("offset")).alias("pos"))
    same = there.join(expected, ["doc", "pos", "term"])
    run = Window.partitionBy("doc", "item", "start").orderBy("offset")
    runs = same.withColumn("__run", F.col("offset") - F.row_number().over(run)).groupBy(
        "doc", "item", "start", "__run").agg(
        F.min("pos").alias("begin"), F.max("pos").alias("end"),
        F.max("item_words").alias("item_words"))
    return runs.where(F.col("end") - F.col("begin") + 1 >= F.least(
        F.lit(window), F.col("item_words"))).select("doc", "item", "begin", "end")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, rarest: int = 2,
                      slop: int = 3) -> DataFrame:
    """(``doc_id``, ``item_id``, ``first``): windows whose rarest terms stand as in the item, give or
    take ``slop`` words of displacement between neighbouring ones. Reworded passages show here."""
    items = stored(item_terms(benchmark))
    frequency = stored(corpus_frequency(docs, items.select("term").distinct()))
    searched = stored(search_terms(items, frequency, window, rarest))
    index = postings(docs, searched.select("term").distinct())
    shifted = index.join(searched, "term").select(
        "doc", "item", "first", "offset", (F.col("pos") - F.col("offset")).alias("start"))
    needed = searched.groupBy("item", "first").agg(F.count("*").alias("__needed"))
    near = Window.partitionBy("doc", "item", "first").orderBy("start").rangeBetween(-slop, 0)
    found = shifted.withColumn("__found", F.size(F.collect_set("offset").over(near)))
    return found.join(needed, ["item", "first"]).where(
        F.col("__found") == F.col("__needed")).select(
        F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id"), "first").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13,
                  share: int = 20) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` and ``contaminated`` added.

    Columns of added names are replaced. Words inside any window of any item are hit; an item of
    fewer than ``window`` words is one window, one without words none. A document is contaminated if
    it has hits and they are at least one word in ``share``. ``item_ids`` are sorted as strings;
    items that share an id count once, an item without an id as an empty string. Null and blank
    texts have no words. Repeated rows get the same result. Without items, or documents, nothing is
    hit.
    """
    added = ("n_words", "n_hit", "item_ids", "contaminated")
    kept = [c for c in docs.columns if c not in added]
    hits = stored(phrase_hits(docs, benchmark, window))
    covered = hits.select("doc", F.explode(F.sequence("begin", "end")).alias("pos")).distinct(
    ).groupBy("doc").agg(F.count("*").alias("n_hit"))
    found = hits.groupBy("doc").agg(F.array_sort(F.collect_set(
        F.coalesce(F.col("item.id").cast("string"), F.lit("")))).alias("item_ids"))
    per = covered.join(found, "doc").select(
        F.col("doc.id").alias("__id"), F.col("doc.tag").alias("__tag"),
        F.col("n_hit").alias("__hit"), F.col("item_ids").alias("__items"))
    counted = docs.select(*kept, F.size(terms(F.col("text"))).cast("long").alias("n_words"),
                          F.xxhash64("text").alias("__text"))
    joined = counted.join(per, F.col("doc_id").eqNullSafe(F.col("__id"))
                          & (F.col("__text") == F.col("__tag")), "left")
    hit = F.coalesce("__hit", F.lit(0)).cast("long")
    return joined.select(
        *kept, "n_words", hit.alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("item_ids"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))
