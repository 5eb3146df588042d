"""Dataset registries: JSON documents listing datasets, exclusions and documented leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.sources.tables import table_diff

_DATASET = (
    "struct<dataset_id:string,target:string,task_type:string,metric:string,positive_class:string,"
    "n_rows:bigint,n_features:bigint,n_usable_features:bigint,positive_rate:double,"
    "leakage_labelled:boolean,known_leakage:array<struct<column:string,kind:string,why:string>>>")
_DOCUMENT = (
    f"datasets array<{_DATASET}>, "
    "excluded array<struct<name:string,failed:string,measured:map<string,string>>>")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per dataset of a registry document."""
    document = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)
    return document.select(F.explode("datasets").alias("d")).select("d.*")


def excluded(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)
    return document.select(F.explode("excluded").alias("e")).select("e.*")


def combine(**registries: DataFrame) -> DataFrame:
    """Registries in one namespace, tagged with ``dataset_source``; a shared id is an error."""
    out = None
    for name, df in registries.items():
        tagged = df.withColumn("dataset_source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    shared = clashes(out).limit(5).collect()
    if shared:
        raise ValueError(f"dataset ids in more than one registry: {[r.dataset_id for r in shared]}")
    return out


def clashes(combined: DataFrame) -> DataFrame:
    return combined.groupBy("dataset_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def find(combined: DataFrame, dataset_id: str) -> DataFrame:
    """The row of one dataset; an unknown id is refused."""
    row = combined.filter(F.col("dataset_id") == dataset_id)
    if row.limit(1).count() == 0:
        raise ValueError(f"unknown dataset {dataset_id!r}")
    return row


def listing(combined: DataFrame) -> DataFrame:
    return combined.select(
        "dataset_id", "dataset_source", "target", "n_rows", "n_features",
        "positive_rate").orderBy("dataset_id")


def known_leakage(combined: DataFrame) -> DataFrame:
    """(dataset_id, column, kind): documented leaks. Known is not planted: never graded against."""
    return combined.select("dataset_id", F.explode("known_leakage").alias("k")).select(
        "dataset_id", "k.column", "k.kind")


def drift(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Datasets added, removed or changed between a stored and a rebuilt registry."""
    scalars = [f.name for f in stored.schema.fields if "array" not in f.dataType.simpleString()]
    return table_diff(stored.select(*scalars), rebuilt.select(*scalars), ["dataset_id"])
