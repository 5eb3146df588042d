"""Content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.functions.exprs import as_text, field_types

_NULL = "\\N"


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """md5 of a row's values in column order; NULL and the empty string differ."""
    types = field_types(df)
    return F.md5(F.concat_ws("|", *[
        F.coalesce(as_text(F.col(c), types[c]), F.lit(_NULL)) for c in (columns or df.columns)]))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order- and partition-insensitive digest of a table: row count and two folds of row digests.

    The xor cancels pairs of equal rows, so a sum is kept beside it, added up as a decimal and
    reduced modulo 2^62, so that no number of rows overflows it.
    """
    digest = row_digest(df, columns)
    head = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    tail = F.conv(F.substring(digest, 13, 7), 16, 10).cast("bigint")
    return df.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(head), F.lit(0)).alias("xor_head"),
        F.coalesce(F.pmod(F.sum(tail.cast("decimal(20,0)")), F.lit(2**62).cast("decimal(38,0)")).cast(
            "bigint"), F.lit(0)).alias("sum_tail"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 per file, for files small enough to be read whole (registries, manifests)."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256"))
