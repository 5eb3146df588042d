"""Mixing sources to target weights: hash order, distributed prefix sums, exact budgets.

Every document gets a hash-random key. Within its source the keys are split into ranges; totals of
the ranges give each range its start, a running sum inside the range gives each document its place
among the source's words, and the budget cuts there. A budget above the source's size first takes
every document once and goes on from the start of the order for the next epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import stored, words

#: Weights by the rank of a source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """Each source's target: ``share`` of all words by weight, none above ``most`` times its size.

    ``sizes`` has one row per source (``source``, ``source_size``). Sources are ranked by code
    point, null last. What a capped source leaves is shared again by weight. With sources in order
    of cap / weight, those capped are a prefix, so running sums find the common level directly
    instead of resharing in rounds. One row per source passes through one task, no documents.
    """
    ranked = sizes.withColumn("__rank", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("__rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("__w", weight).withColumn(
        "__cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ((F.sum("source_size").over(everything) * F.lit(float(share))
              - F.coalesce(F.sum("__cap").over(before), zero))
             / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), zero)))
    levelled = capped.withColumn("__level", level)
    # the first source, in this order, whose level does not pass its cap fixes the level of the rest
    free = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(
        F.col("__cap") / F.col("__w"), F.col("__rank"), F.col("__level")).alias("f")))
    shared = levelled.withColumn("__free", free.over(everything).getField("__level"))
    target = F.when(F.col("__free").isNull(), F.col("__cap")).otherwise(
        F.least(F.col("__cap"), F.col("__free") * F.col("__w")))
    return shared.select("source", "source_size", target.alias("target"))


def _group(source: Column) -> Column:
    """A source as a key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(docs: DataFrame, range_digits: int = 4, **rules) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` added.

    Needs ``doc_id``, ``text`` and ``source``; a column of an added name is replaced. Size is the
    number of words, 0 for null and empty texts. Null sources form one source. The order within a
    source is by the MD5 of the id, then id and size: reruns agree, rows equal in all three are
    interchangeable. A budget is cut to whole words inside the document that crosses it, so a
    source's ``taken`` sums to its target rounded down. An empty table gives an empty table.

    ``range_digits`` leading hex digits of the key make 16**range_digits even ranges per source,
    so no task holds more than that share of a source, however large, and the totals of a source
    are at most 16**range_digits rows.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = docs.select(
        *kept, F.size(words(F.col("text"))).cast("long").alias("size"),
        _group(F.col("source").cast("string")).alias("__g"), key.alias("__key"),
    ).withColumn("__range", F.substring("__key", 1, range_digits))
    totals = stored(placed.groupBy("__g", "__range").agg(F.sum("size").alias("__total")))
    targets = source_targets(
        totals.groupBy(F.col("__g").alias("source")).agg(F.sum("__total").alias("source_size")),
        **rules).withColumnRenamed("source", "__g")
    earlier = Window.partitionBy("__g").orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select(
        "__g", "__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__g", "__range").orderBy("__key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    run = placed.withColumn("__within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = run.join(starts.join(targets, "__g"), ["__g", "__range"])
    before = F.col("__start") + F.col("__within")
    budget = F.floor(F.col("target"))
    whole = F.when(F.col("source_size") > 0,
                   F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    part = F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))
    return joined.select(*kept, "size", "source_size", "target",
                         (whole * F.col("size") + part).cast("long").alias("taken"))
