"""Opaque column names, and ground truth that follows the rename."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMINGS = ("descriptive", "opaque")


def rename_map(columns: Sequence[str], target: str, naming: str = "opaque") -> dict[str, str]:
    """Every column but the target becomes ``var_NN``, numbered from 1 in source order."""
    if naming not in NAMINGS:
        raise ValueError(f"naming must be one of {NAMINGS}, got {naming!r}")
    if target not in columns:
        raise ValueError(f"target {target!r} is not a column")
    if naming == "descriptive":
        return {c: c for c in columns}
    features = [c for c in columns if c != target]
    return {c: f"var_{i:02d}" for i, c in enumerate(features, start=1)} | {target: target}


def opaque_names(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename columns only; every value stays what it was."""
    columns = [c for c in df.columns if c not in set(keep)]
    return df.withColumnsRenamed(rename_map(columns, target))


def rename_names(names: Column, mapping: dict[str, str]) -> Column:
    """Apply a rename to an array of column names; names outside the map stay."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(names, lambda n: F.coalesce(F.element_at(pairs, n), n))


def materialize(df: DataFrame, target: str, naming: str, path: str) -> dict[str, str]:
    """Write the renamed table and return the mapping that was used."""
    mapping = rename_map(df.columns, target, naming)
    df.withColumnsRenamed(mapping).write.mode("overwrite").parquet(path)
    return mapping
