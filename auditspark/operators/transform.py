"""Feature transforms: fitted on train rows, applied anywhere as plain projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.functions.exprs import as_text, field_types, null_if_nan, to_number
from auditspark.operators.profile import _chunks, classify_columns, id_like, unpivot
from auditspark.operators.ranking import column_statistics, dense_index

# ---------------------------------------------------------------- which columns are dropped


def forced_drops(profile: DataFrame, target: str, binding: DataFrame | None = None) -> DataFrame:
    """(column, reason): the target, identifier-like columns, columns of binding objections.

    ``binding`` holds (column) of column-scoped objections that still bind. The first reason wins.
    """
    named = profile.filter(F.col("column") == target).select(
        "column", F.lit("target").alias("reason"), F.lit(1).alias("priority"))
    identifiers = profile.filter((F.col("column") != target) & id_like()).select(
        "column", F.lit("identifier").alias("reason"), F.lit(2).alias("priority"))
    reasons = named.unionByName(identifiers)
    if binding is not None:
        reasons = reasons.unionByName(binding.select(
            "column", F.lit("leakage").alias("reason"), F.lit(3).alias("priority")))
    # The first reason by priority, as an aggregate so a column named often costs nothing extra.
    return reasons.groupBy("column").agg(F.min_by("reason", "priority").alias("reason"))


def merge_drops(profile: DataFrame, forced: DataFrame, proposed: DataFrame,
                kept: DataFrame | None = None) -> DataFrame:
    """(column, decision): forced drops, valid proposals, and keeps that survive them.

    A proposal must name an existing column that is not already forced; a keep of a dropped column
    is void.
    """
    known = F.broadcast(profile.select("column"))  # one row per column of the table
    extra = proposed.select("column").distinct().join(known, "column", "left_semi").join(
        F.broadcast(forced.select("column")), "column", "left_anti")
    drops = forced.select("column", F.lit("forced").alias("decision")).unionByName(
        extra.select("column", F.lit("proposed").alias("decision")))
    if kept is None:
        return drops
    keeps = kept.select("column").distinct().join(known, "column", "left_semi").join(
        F.broadcast(drops.select("column")), "column", "left_anti")
    return drops.unionByName(keeps.select("column", F.lit("kept").alias("decision")))


def valid_nominations(nominations: DataFrame, profile: DataFrame, target: str) -> DataFrame:
    """Nominations of existing columns other than the target."""
    names = profile.filter(F.col("column") != target).select("column")
    return nominations.join(F.broadcast(names), "column", "left_semi")


def source_columns(df: DataFrame, target: str, drops: Sequence[str],
                   row_id: str = "row_id") -> list[str]:
    gone = {*drops, target, row_id}
    return [c for c in df.columns if c not in gone]


# ---------------------------------------------------------------- medians and levels


def medians(df: DataFrame, columns: Sequence[str], *, approx: int | None = None,
            small_group: int | None = None) -> dict[str, float]:
    """Median of the non-missing numbers of each column; 0.0 where there are none.

    Exact medians locate one or two rows per column by counting (no column is sorted or gathered);
    ``approx`` uses a quantile sketch of that accuracy instead.
    """
    types = field_types(df)
    out: dict[str, float] = {}
    if approx is not None:
        for chunk in _chunks(columns):
            row = df.agg(*[
                F.percentile_approx(to_number(F.col(c), types[c]), 0.5, approx) for c in chunk
            ]).first()
            out.update({c: 0.0 if v is None else v for c, v in zip(chunk, row, strict=True)})
        return out
    numbers = df.select(*[to_number(F.col(c), types[c]).alias(c) for c in columns])
    sizes: dict[str, int] = {}
    for chunk in _chunks(columns):
        sizes.update(zip(chunk, numbers.agg(*[F.count(c) for c in chunk]).first(), strict=True))
    ranks = {c: sorted({(m + 1) // 2, m // 2 + 1}) for c, m in sizes.items() if m}
    if ranks:
        found: dict[str, list[float]] = {}
        for cut in column_statistics(numbers, {c: F.col(c) for c in columns}, ranks, cells=small_group):
            found.setdefault(cut.group, []).append(float(cut.key))
        out = {c: sum(v) / len(v) for c, v in found.items()}
    return {c: out.get(c, 0.0) for c in columns}


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level): distinct non-missing string values."""
    return unpivot(df, columns).filter(F.col("value").isNotNull()).groupBy(
        "column", F.col("value").alias("level")).agg(F.count("*").alias("n")).drop("n")


# ---------------------------------------------------------------- one-hot transform


@dataclass(frozen=True)
class FittedTransform:
    """Constants fitted on train rows: medians, and at most 20 sorted levels per column."""

    target: str
    medians: dict[str, float]
    levels: dict[str, list[str]]
    skipped: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def numeric(self) -> list[str]:
        return list(self.medians)

    @property
    def categorical(self) -> list[str]:
        return list(self.levels)

    @property
    def source_columns(self) -> list[str]:
        return [*self.medians, *self.levels]

    @property
    def feature_order(self) -> list[str]:
        return [*self.medians, *[f"{c}={v}" for c, vs in self.levels.items() for v in vs]]

    @property
    def column_source(self) -> dict[str, str]:
        return {**{c: c for c in self.medians},
                **{f"{c}={v}": c for c, vs in self.levels.items() for v in vs}}

    def expressions(self, df: DataFrame) -> list[Column]:
        """One double per feature, never NULL, in feature order."""
        types = field_types(df)

        def fill(c: str, m: float) -> Column:
            value = to_number(F.col(f"`{c}`"), types[c]) if c in types else F.lit(None)
            return F.coalesce(value, F.lit(float(m)))

        def flag(c: str, v: str) -> Column:
            if c not in types:
                return F.lit(0.0)
            return F.coalesce((as_text(F.col(f"`{c}`"), types[c]) == F.lit(v)).cast("double"),
                              F.lit(0.0))

        return [*[fill(c, m) for c, m in self.medians.items()],
                *[flag(c, v) for c, vs in self.levels.items() for v in vs]]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The model matrix beside ``keep``: a single projection over literals."""
        named = [e.alias(n) for e, n in zip(self.expressions(df), self.feature_order, strict=True)]
        return df.select(*keep, *named)

    def vector(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features"):
        """The matrix as one array<double> column, for assembling into an ML vector."""
        return df.select(*keep, F.array(*self.expressions(df)).alias(output))


def fit_transform(train: DataFrame, target: str, drops: Sequence[str] = (),
                  row_id: str = "row_id", small_group: int | None = None) -> FittedTransform:
    """Decide types, medians and levels from the train rows only."""
    kinds = classify_columns(train.drop(row_id), target, drops)
    levels: dict[str, list[str]] = {c: [] for c in kinds["categorical"]}
    if levels:
        # At most 20 levels per categorical column by the classification above.
        for r in level_table(train, list(levels)).collect():
            levels[r["column"]].append(r.level)
    return FittedTransform(
        target, medians(train, kinds["numeric"], small_group=small_group)
        if kinds["numeric"] else {},
        {c: sorted(v) for c, v in levels.items()}, kinds["skipped"],
        sorted({*drops, *kinds["skipped"]} - {target}))


def matrix_nulls(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells in a model matrix; anything but 0 is a refusal."""
    types = field_types(matrix)
    cells = [F.when(null_if_nan(F.col(f"`{c}`"), types[c]).isNull(), 1).otherwise(0)
             for c in columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return matrix.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n_missing"),
                      F.count("*").alias("n_rows"))


def check_matrix(matrix: DataFrame, columns: Sequence[str]) -> None:
    missing = matrix_nulls(matrix, columns).first().n_missing
    if missing:
        raise ValueError(f"model matrix holds {missing} missing cells")


def fit_summary(fit: FittedTransform, profile: DataFrame, forced: DataFrame) -> DataFrame:
    """(column, decision, reason, detail): what became of every profiled column, and why."""
    numeric = F.col("column").isin(fit.numeric)
    decision = (
        F.when(F.col("reason").isNotNull(), "dropped")
        .when(F.col("column").isin(fit.skipped), "skipped")
        .when(numeric, "numeric").when(F.col("column").isin(fit.categorical), "one_hot")
        .otherwise("dropped"))
    why = F.coalesce(
        F.col("reason"), F.when(F.col("column").isin(fit.skipped), "too_many_levels"),
        F.when(numeric | F.col("column").isin(fit.categorical), "kept"), F.lit("proposed"))
    constants = {**{c: f"median={m!r}" for c, m in fit.medians.items()},
                 **{c: f"levels={len(v)}" for c, v in fit.levels.items()}}
    detail = F.lit(None).cast("string")
    if constants:
        detail = F.element_at(F.create_map(
            *[F.lit(x) for kv in constants.items() for x in kv]), F.col("column"))
    return profile.select("column").join(F.broadcast(forced), "column", "left").select(
        "column", decision.alias("decision"), why.alias("reason"),
        F.coalesce(detail, F.lit("")).alias("detail"))


# ---------------------------------------------------------------- ordinal encoding (baseline)


@dataclass(frozen=True)
class OrdinalFit:
    """Median fill for numbers; code = position of the level among the sorted train levels.

    The levels are a table, not constants: a string column may have as many levels as rows.
    """

    medians: dict[str, float]
    categorical: list[str]
    codes: DataFrame  # (column, level, code)
    sizes: dict[str, int]

    BROADCAST_LEVELS = 500_000

    @property
    def feature_order(self) -> list[str]:
        return [*self.medians, *self.categorical]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Unseen levels become -1, missing is a level of its own.

        Level tables under the size bound are broadcast together; a larger one is joined by
        shuffle, where AQE splits a hot level.
        """
        types = field_types(df)
        out = df.select("*", *[
            F.coalesce(as_text(F.col(c), types[c]), F.lit(vocab.BASELINE_MISSING_LEVEL)).alias(
                f"__l_{c}") for c in self.categorical])
        for c in self.categorical:
            levels = self.codes.filter(F.col("column") == c).select(
                F.col("level").alias(f"__l_{c}"), F.col("code").cast("double").alias(f"__c_{c}"))
            if self.sizes.get(c, 0) <= self.BROADCAST_LEVELS:
                levels = F.broadcast(levels)
            out = out.join(levels, f"__l_{c}", "left")
        return out.select(
            *keep,
            *[F.coalesce(to_number(F.col(c), types[c]), F.lit(float(m))).alias(c)
              for c, m in self.medians.items()],
            *[F.coalesce(F.col(f"__c_{c}"), F.lit(-1.0)).alias(c) for c in self.categorical])


def fit_ordinal(train: DataFrame, target: str, row_id: str = "row_id",
                small_group: int | None = None) -> OrdinalFit:
    kinds = classify_columns(train.drop(row_id), target, cap=None)
    types = field_types(train)
    filled = train.select(*[
        F.coalesce(as_text(F.col(c), types[c]), F.lit(vocab.BASELINE_MISSING_LEVEL)).alias(c)
        for c in kinds["categorical"]])
    if kinds["categorical"]:
        codes = ordinal_codes(level_table(filled, kinds["categorical"]))
        sizes = {r["column"]: r.n for r in codes.groupBy("column").agg(
            F.count("*").alias("n")).collect()}
    else:
        codes = train.sparkSession.createDataFrame(
            [], "column string, level string, code bigint")
        sizes = {}
    return OrdinalFit(
        medians(train, kinds["numeric"], small_group=small_group) if kinds["numeric"] else {},
        kinds["categorical"], codes, sizes)


def ordinal_codes(levels: DataFrame) -> DataFrame:
    """(column, level, code): 0-based position of each level in its column's sorted levels.

    All columns are range-sorted together and numbered once; a column's codes start where its
    first level landed, so no column's levels are gathered in one task.
    """
    placed = dense_index(levels, ["column", "level"], name="__at")
    starts = F.broadcast(placed.groupBy("column").agg(F.min("__at").alias("__start")))
    return placed.join(starts, "column").select(
        "column", "level", (F.col("__at") - F.col("__start")).alias("code"))


# ---------------------------------------------------------------- scaling


@dataclass(frozen=True)
class Scaling:
    """Mean 0 and population standard deviation 1; constant columns are only centred."""

    mean: dict[str, float]
    spread: dict[str, float]

    def expressions(self) -> list[Column]:
        return [((F.col(f"`{c}`") - F.lit(m)) / F.lit(self.spread[c])).alias(c)
                for c, m in self.mean.items()]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *self.expressions())


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    mean: dict[str, float] = {}
    spread: dict[str, float] = {}
    for chunk in _chunks(columns):
        row = df.agg(*[F.struct(F.avg(f"`{c}`"), F.stddev_pop(f"`{c}`")).alias(f"s{i}")
                       for i, c in enumerate(chunk)]).first()
        for c, (m, s) in zip(chunk, row, strict=True):
            mean[c], spread[c] = m, s or 1.0
    return Scaling(mean, spread)
