"""The corpus pipeline: raw documents to a mixed training set, one written table per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import decontaminate as decontamination
from auditspark.llm import mixing, quality_rules, shingle_similarity, substring_dedup
from auditspark.llm.common import read_table, stored


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns of ``docs``, null where there are none, and all others as one struct:
    what an operator adds cannot meet a column of the same name."""
    held = [c for c in docs.columns if c not in needed]
    given = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in needed]
    return docs.select(*given, F.struct(*held, F.lit(0).alias("__none")).alias("__held"))


def together(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, in their order, ``changed`` ones anew."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in df.columns and c in (
        "doc_id", "text", "source") else F.col("__held").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision verdict keeps, unchanged, whatever their other columns.

    Null and blank texts go (the base rule); repeated rows are judged alike; an empty table stays one.
    """
    return together(quality_rules.judge(apart(docs, "text")).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near copies, unchanged; rows without an id stay.

    Near copies share five-word shingles at a Jaccard similarity of 0.8 or more. SimHash fingerprints
    bring candidates together, exact sets decide, and rare shingles find the pairs whose fingerprints
    lie further apart. Rows that repeat an id are one document and stay or go together. Blank texts are copies of each other. An empty
    table stays one.
    """
    found = shingle_similarity.near_copies(docs.select("doc_id", "text"))
    gone = stored(found.where("component_id < doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long spans that an earlier document has; a text that loses nothing stays
    as it is, a document that loses every word goes. ``n_chars``, where there is one, follows the
    text. Null and blank texts, rows with a null id and other columns stay; so does an empty table.
    """
    cut = substring_dedup.remove_repeats(apart(docs, "doc_id", "text"))
    changed = F.col("n_removed") > 0
    out = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length("kept_text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("__held.n_chars"))
    return together(cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), docs, **out)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, unchanged, whatever their other columns.

    Null and blank texts have no words and stay; repeated rows are judged alike; an empty table
    stays one.
    """
    found = decontamination.decontaminate(
        apart(docs, "doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return together(found.where("NOT contaminated"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that the mix takes, with ``size``, ``source_size``, ``target`` and the words
    ``taken`` of it, repeats counted. A column of ``docs`` of one of these names goes by
    ``<name>_before``. Documents without words are not taken; a null source is one source."""
    added = ("size", "source_size", "target", "taken")
    renamed = docs.withColumnsRenamed({c: f"{c}_before" for c in added if c in docs.columns})
    return mixing.mix(renamed).where("taken > 0")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Votes fitted by iteration, fingerprints and connected components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
