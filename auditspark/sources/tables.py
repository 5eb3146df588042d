"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.functions import vocab
from auditspark.operators.ranking import dense_index


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, multi_line: bool = True,
               partitions: int | None = None) -> DataFrame:
    """Headered CSV (or parquet, orc, json by suffix) with missing-value tokens as NULL.

    Quoted CSV fields may hold line ends, for which one task has to read a whole file;
    ``multi_line=False`` is for files without such fields and splits them over tasks. ``partitions``
    deals the rows of a CSV out anew after reading.

    Without a schema the CSV types are inferred after the tokens are blanked, as a CSV reader that
    knows those tokens would: a numeric column holding ``NA`` stays numeric.
    """
    kind = fmt or next((s for s in ("parquet", "orc", "json") if path.rstrip("/").endswith(s)),
                       "csv")
    if kind != "csv":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return normalise_missing(reader.format(kind).load(path))
    # quotes are doubled inside quoted fields, which may hold line ends
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')

    def dealt(rows: DataFrame) -> DataFrame:
        return rows if partitions is None else rows.repartition(partitions)

    if schema is not None:
        return normalise_missing(dealt(reader.schema(schema).csv(path)))
    raw = normalise_missing(dealt(reader.csv(path)))
    return raw.select(*[_typed(F.col(f"`{c}`"), kind_).alias(c)
                        for c, kind_ in _inferred(raw).items()])


def normalise_missing(df: DataFrame) -> DataFrame:
    """One projection turning missing-value tokens in string columns into NULL."""
    tokens = list(vocab.NA_TOKENS)
    return df.select(*[
        F.when(~F.col(f"`{f.name}`").isin(tokens), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


_INTEGER = r"^[+-]?\d+$"


def _inferred(raw: DataFrame) -> dict[str, str]:
    """Narrowest type every present value of a column fits, in one aggregate over the table."""
    if not raw.columns:
        return {}
    checks = []
    for c in raw.columns:
        v = F.col(f"`{c}`")
        present = v.isNotNull()
        checks.append(F.struct(
            F.coalesce(F.bool_and(F.when(present, v.rlike(_INTEGER) & v.try_cast(
                "bigint").isNotNull())), F.lit(False)).alias("i"),
            F.coalesce(F.bool_and(F.when(present, v.try_cast("double").isNotNull())),
                       F.lit(True)).alias("d"),
            F.coalesce(F.bool_and(F.when(present, F.lower(v).isin("true", "false"))),
                       F.lit(False)).alias("b")))
    row = raw.agg(*[k.alias(f"c{i}") for i, k in enumerate(checks)]).first()
    return {c: "boolean" if s.b else "bigint" if s.i else "double" if s.d else "string"
            for c, s in zip(raw.columns, row, strict=True)}


def _typed(column: Column, kind: str) -> Column:
    return column if kind == "string" else column.cast(kind)


def with_row_id(df: DataFrame, key: str | None = None, order_by: Sequence[str] | None = None,
                name: str = "row_id") -> DataFrame:
    """Stable row identity: a unique integer key, else the position in a total order or the file.

    Positions are assigned once and written to the checkpoint folder, so they cannot shift when a
    task is run again.
    """
    if key is not None:
        repeated = df.groupBy(key).count().filter(
            (F.col("count") > 1) | F.col(key).isNull()).limit(1).count()
        if repeated:
            raise ValueError(f"{key!r} is not a unique row key")
        return df.withColumn(name, F.col(key).cast("bigint"))
    return dense_index(df, list(order_by) if order_by else None, name)


def write_canonical(df: DataFrame, path: str, sort_by: Sequence[str]) -> None:
    """CSV with every option fixed and rows in a total order, so equal tables give equal files."""
    (df.orderBy(*sort_by).write.mode("overwrite")
     .option("header", True).option("nullValue", "").option("emptyValue", '""')
     .option("lineSep", "\n").option("quoteAll", False).option("encoding", "UTF-8").csv(path))


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., change, columns): rows added, removed or changed, NULL equal to NULL.

    Both sides are tagged and folded on the key, which needs one shuffle and meets NULL keys. A
    key occurring twice on one side is reported as ``duplicate`` rather than paired arbitrarily.
    """
    values = [c for c in a.columns if c not in set(keys)]

    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*values).alias("v"), F.lit(name).alias("side"))

    folded = tagged(a, "a").unionByName(tagged(b, "b")).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "a", F.col("v"))).alias("a"),
        F.max(F.when(F.col("side") == "b", F.col("v"))).alias("b"),
        F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    differing = F.filter(F.array(*[
        F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in values
    ]), lambda c: c.isNotNull())
    change = (
        F.when((F.col("na") > 1) | (F.col("nb") > 1), "duplicate").when(F.col("na") == 0, "added")
        .when(F.col("nb") == 0, "removed").when(F.size(differing) > 0, "changed"))
    return folded.select(
        *keys, change.alias("change"),
        F.when(change == "changed", differing).otherwise(
            F.array().cast("array<string>")).alias("columns")
    ).filter(F.col("change").isNotNull())


# ---------------------------------------------------------------- row rules


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``reason``); the first broken rule names the reason.

    A rule is the condition a row must meet; NULL counts as not met.
    """
    reason = F.coalesce(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    judged = df.withColumn("reason", reason)
    return (judged.filter(F.col("reason").isNull()).drop("reason"),
            judged.filter(F.col("reason").isNotNull()))


def objection_rules() -> dict[str, Column]:
    scoped = F.col("category").isin(*vocab.COLUMN_SCOPED)
    return {
        "category": F.col("category").isin(*vocab.CATEGORIES),
        "target_node": F.col("target_node").isin(*vocab.ACTING_NODES),
        "column_required": ~scoped | (F.size("columns") > 0),
        "raised_at_iteration": F.col("raised_at_iteration") >= 0,
    }


def spec_rules() -> dict[str, Column]:
    keyed = F.col("split_strategy").isin("temporal", "grouped")
    return {
        "metric": F.col("metric").isin(*vocab.GREATER_IS_BETTER),
        "task_type": F.col("task_type").isin(*vocab.TASK_TYPES),
        "split_key": ~keyed | F.coalesce(F.col("split_key") != "", F.lit(False)),
    }


def profile_rules() -> dict[str, Column]:
    return {
        "missing_fraction": F.col("missing_fraction").between(0.0, 1.0),
        "n_unique": F.col("n_unique") >= 0,
    }


def sorted_descending(array: Column, field: str = "mean") -> Column:
    """Whether an array of structs is ordered by ``field`` from high to low."""
    pairs = F.sequence(F.lit(1), F.size(array) - 1)
    return F.when(F.size(array) < 2, F.lit(True)).otherwise(F.forall(
        pairs, lambda i: F.get(array, i - 1)[field] >= F.get(array, i)[field]))
