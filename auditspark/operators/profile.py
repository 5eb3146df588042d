"""Column profiling and association with a label."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.functions import vocab
from auditspark.functions.exprs import (
    as_text, field_types, frame_dtype, is_numeric, null_if_nan,
)
from auditspark.operators.ranking import Cut, column_statistics, cuts_passed

# Columns unpivoted together in one scan; wider tables take one scan per chunk.
CHUNK = 200
_LONG_TEXT = 64


def _chunks(columns: Sequence[str]) -> list[list[str]]:
    return [list(columns[i:i + CHUNK]) for i in range(0, len(columns), CHUNK)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _compact(value: Column) -> Column:
    """Stand-in for a value when only its identity matters, so long texts are not shuffled."""
    return F.when(F.length(value) > _LONG_TEXT, F.md5(value)).otherwise(value)


def melt(df: DataFrame, values: dict[str, Column], name: str, value: str,
         keep: Sequence[str | Column] = ()) -> DataFrame:
    """(keep..., name, value): one row per input row and entry of ``values``.

    The values are computed once per row and fanned out by Spark's unpivot, which allocates no
    array per row; wide tables are taken in chunks of columns.
    """
    frames = []
    names = list(values)
    for chunk in _chunks(names):
        staged = df.select(*keep, *[values[c].alias(f"__m{c}") for c in chunk])
        ids = [c for c in staged.columns if not c.startswith("__m")]
        long = staged.unpivot(ids, [f"`__m{c}`" for c in chunk], "__name", value)
        frames.append(long.select(
            *ids, F.substring("__name", 4, 1_000_000).alias(name), value))
    return _union(frames)


def unpivot(df: DataFrame, columns: Sequence[str], compact: bool = False,
            keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) with every value in its string form and missing as NULL."""
    types = field_types(df)

    def text(name: str) -> Column:
        value = as_text(F.col(name), types[name])
        return _compact(value) if compact and isinstance(types[name], T.StringType) else value

    return melt(df, {c: text(c) for c in columns}, "column", "value", keep)


# ---------------------------------------------------------------- profile


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, *,
                   approx: float | None = None) -> DataFrame:
    """One row per column: dtype, missing_fraction, n_unique (non-missing), n_rows, n_columns.

    Exact distinct counts come from one (column, value) aggregation per kind of value, combined
    map-side, so a value held by a third of the rows costs one row per task. ``approx`` (a relative error) trades that
    shuffle for sketches inside a single map-side aggregation.
    """
    columns = list(columns or df.columns)
    types = field_types(df)
    if approx is not None:
        return _approximate_profile(df, columns, approx)
    per_column = _union([
        melt(df, values, "column", "value").groupBy("column", "value").agg(
            F.count("*").alias("n"))
        .groupBy("column").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias(
                "n_missing"),
            F.count("value").alias("n_unique")) for values in _by_kind(columns, types).values()])
    return _with_dtype(per_column, types, columns, len(df.columns))


def _identity(name: str, dtype: T.DataType) -> tuple[str, Column]:
    """What tells a column's values apart, in one of three types: numbers need no string form."""
    value = F.col(f"`{name}`")
    if isinstance(dtype, T.IntegralType):
        return "bigint", value.cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double", null_if_nan(value, dtype).cast("double")  # grouping joins -0.0 and 0.0
    if isinstance(dtype, T.DateType):
        return "bigint", F.unix_date(value).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return "bigint", F.unix_micros(value)
    text = as_text(value, dtype)
    return "string", _compact(text) if isinstance(dtype, T.StringType) else text


def _by_kind(columns: Sequence[str], types: dict[str, T.DataType]) -> dict[str, dict[str, Column]]:
    """The columns' identities under the type that holds them, so each type is unpivoted by itself."""
    kinds: dict[str, dict[str, Column]] = {}
    for c in columns:
        kind, value = _identity(c, types[c])
        kinds.setdefault(kind, {})[c] = value
    return kinds


def _with_dtype(per_column, types, columns, width) -> DataFrame:
    missing = F.col("n_missing")
    kinds: dict[str, tuple[Column, list[str]]] = {}
    for c in columns:
        kinds.setdefault(types[c].simpleString(), (frame_dtype(types[c], missing), []))[1].append(c)
    dtype = F.coalesce(*[F.when(F.col("column").isin(names), expr)
                         for expr, names in kinds.values()])
    return per_column.select(
        "column", dtype.alias("dtype"), (missing / F.col("n_rows")).alias("missing_fraction"),
        "n_unique", "n_rows", F.lit(width).cast("bigint").alias("n_columns"))


def _approximate_profile(df, columns, rsd) -> DataFrame:
    types = field_types(df)
    parts = []
    for chunk in _chunks(columns):
        wide = df.agg(F.count("*").alias("n_rows"), *[
            F.struct(
                F.count(null_if_nan(F.col(c), types[c])).alias("present"),
                F.approx_count_distinct(null_if_nan(F.col(c), types[c]), rsd).alias("n_unique"),
            ).alias(f"c{i}") for i, c in enumerate(chunk)])
        parts.append(wide.select("n_rows", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"c{i}.present").alias("present"),
                     F.col(f"c{i}.n_unique").alias("n_unique"))
            for i, c in enumerate(chunk)])).alias("s")).select(
                "s.column", "n_rows", (F.col("n_rows") - F.col("s.present")).alias("n_missing"),
                "s.n_unique"))
    return _with_dtype(_union(parts), types, columns, len(df.columns))


def table_catalog(df: DataFrame) -> DataFrame:
    """What registering a table records: dtype, distinct count and row count per column."""
    return column_profile(df).select("column", "dtype", "n_unique", "n_rows")


def sample_values(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
                  k: int = vocab.SAMPLE_VALUES) -> DataFrame:
    """First ``k`` distinct non-missing values of each column in row order.

    The rank filter is pushed below the shuffle, so each task forwards at most ``k`` candidates
    per column whatever the number of distinct values.
    """
    first_seen = (
        unpivot(df, columns, keep=[row_id]).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.min(row_id).alias("first_row")))
    order = Window.partitionBy("column").orderBy("first_row", "value")
    return (
        first_seen.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("column", F.col("position").cast("bigint").alias("position"), "value"))


def target_balance(df: DataFrame, target: str,
                   max_classes: int | None = None) -> DataFrame:
    """Share of every class, missing included.

    ``max_classes`` is for readers that put the shares into one row: above it there are no rows.
    """
    types = field_types(df)
    counts = df.groupBy(as_text(F.col(target), types[target]).alias("label")).agg(
        F.count("*").alias("n"))
    total, classes = counts.agg(F.sum("n"), F.count("*")).first()
    shares = counts if max_classes is None or classes <= max_classes else counts.limit(0)
    return shares.select("label", F.round(F.col("n") / F.lit(total or 1), 4).alias("share"))


# ---------------------------------------------------------------- discretising


def _numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that may be binned; booleans are levels, not numbers, here."""
    types = field_types(df)
    return [c for c in columns if is_numeric(types[c])]


def numeric_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, bool]]:
    """Per numeric column: non-missing count, and whether more than 12 distinct values occur.

    A sketch settles columns that are far above the limit; only the rest are counted exactly, and
    those have few distinct values by construction.
    """
    types = field_types(df)
    out: dict[str, tuple[int, bool]] = {}
    unsure: list[str] = []
    for chunk in _chunks(list(columns)):
        row = df.agg(*[
            F.struct(F.count(null_if_nan(F.col(c), types[c])),
                     F.approx_count_distinct(null_if_nan(F.col(c), types[c]))).alias(f"c{i}")
            for i, c in enumerate(chunk)]).first()
        for i, c in enumerate(chunk):
            present, distinct = row[i]
            out[c] = (present, distinct > 8 * vocab.BIN_ABOVE_DISTINCT)
            if not out[c][1]:
                unsure.append(c)
    if unsure:
        for r in _union([melt(df, v, "column", "value").groupBy("column", "value").count()
                         .groupBy("column").agg(F.count("value").alias("d"))
                         for v in _by_kind(unsure, types).values()]).collect():
            out[r["column"]] = (out[r["column"]][0], r.d > vocab.BIN_ABOVE_DISTINCT)
    return out


_DOUBLE_BITS, _LONG_DIGITS = 53, 18


def _as_integer(name: str, dtype: T.DataType) -> Column | None:
    """A bigint in the order of the column's values, for types that a double may not tell apart."""
    if isinstance(dtype, T.LongType):
        return F.col(name)
    if isinstance(dtype, T.DecimalType) and 15 < dtype.precision <= _LONG_DIGITS:
        return (F.col(name).cast(f"decimal(38,{dtype.scale})") * F.lit(10 ** dtype.scale)).cast("bigint")
    return None


def wide_integers(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that hold an integer (or a decimal's digits) beyond what doubles tell apart."""
    types = field_types(df)
    able = {c: w for c in columns if (w := _as_integer(c, types[c])) is not None}
    if not able:
        return []
    row = df.agg(*[F.struct(F.min(w), F.max(w)).alias(f"c{i}") for i, w in enumerate(able.values())]).first()
    edge = 1 << _DOUBLE_BITS
    return [c for c, (low, high) in zip(able, row, strict=True) if low is not None and (low < -edge or high > edge)]


def bin_cuts(df: DataFrame, columns: Sequence[str], row_id: str,
             small_group: int | None = None) -> dict[str, list[Cut]]:
    """The nine equal-frequency cut rows of every column that is binned.

    Bin b holds the ranks above floor(b(m-1)/10)+1 of m values ordered by (value, row id). Only
    those nine rows per column are located; no column is sorted and no row is ranked. Bigints and
    decimals of up to 18 digits are compared exactly, wider decimals as doubles.
    """
    sizes = numeric_sizes(df, columns)
    binned = {c: n for c, (n, many) in sizes.items() if many}
    if not binned:
        return {}
    ranks = {
        c: [b * (m - 1) // vocab.N_BINS + 1 for b in range(1, vocab.N_BINS)]
        for c, m in binned.items()}
    types = field_types(df)
    wide = wide_integers(df, list(binned))
    numbers = {c: null_if_nan(F.col(c), types[c]).cast("double") for c in binned if c not in wide}
    tie = F.col(row_id).cast("bigint")
    cuts = column_statistics(df, numbers, ranks, tie, small_group)
    cuts += column_statistics(df, {c: _as_integer(c, types[c]) for c in wide}, ranks, tie, small_group)
    out: dict[str, list[Cut]] = {c: [] for c in binned}
    for cut in cuts:
        out[cut.group].append(cut)
    return out


def level_code(name: str, dtype: T.DataType, cuts: list[Cut] | None, row_id: str,
               compact: bool = False) -> Column:
    """Level of one value: its bin number when the column is binned, else its string form."""
    if cuts:
        value = (_as_integer(name, dtype) if isinstance(cuts[0].key, int)
                 else null_if_nan(F.col(name), dtype).cast("double"))
        tie = F.col(row_id).cast("bigint")
        code = F.when(value.isNotNull(), cuts_passed(cuts, value, tie).cast("string"))
    else:
        code = as_text(F.col(name), dtype)
        if compact and isinstance(dtype, T.StringType):
            code = _compact(code)
    return F.coalesce(code, F.lit(vocab.MISSING_LEVEL))


def discretize(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
               small_group: int | None = None) -> DataFrame:
    """``row_id`` plus one level column per input column."""
    types = field_types(df)
    cuts = bin_cuts(df, _numeric_columns(df, columns), row_id, small_group)
    return df.select(row_id, *[
        level_code(c, types[c], cuts.get(c), row_id).alias(c) for c in columns])


# ---------------------------------------------------------------- association

_UNSUPPORTED = (T.MapType, T.BinaryType, T.ArrayType, T.StructType)


def _bins_counted(df: DataFrame, cuts: dict[str, list[Cut]], target: Column, row_id: str) -> DataFrame:
    """(column, x, t, n): rows per bin and level of the target, a missing value as bin -1.

    Batches are placed between the cuts as arrays and counted there, so what goes on is a few rows
    of counts instead of every cell.
    """
    types = field_types(df)
    names = [c for c in cuts if cuts[c]]
    whole = {c: isinstance(cuts[c][0].key, int) for c in names}
    values = [(_as_integer(c, types[c]) if whole[c] else null_if_nan(F.col(c), types[c]).cast("double"))
              for c in names]
    plain = [(c, sorted(cut.key for cut in cuts[c]), [(cut.key, cut.tie) for cut in cuts[c] if cut.tie is not None])
             for c in names]

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            labels = batch.column(0).dictionary_encode()
            label = labels.indices.to_numpy().astype(np.int64)
            width = max(1, len(labels.dictionary))
            tie = batch.column(1).to_numpy(zero_copy_only=False)
            for i, (name, keys, tied) in enumerate(plain, 2):
                column = batch.column(i)
                value = column.fill_null(0).to_numpy(zero_copy_only=False)
                place = np.searchsorted(np.array(keys, value.dtype), value, "left")
                for key, last in tied:
                    place += (value == key) & (tie > last)
                place = np.where(column.is_valid().to_numpy(zero_copy_only=False), place, -1)
                counts = np.bincount((place + 1) * width + label)
                met = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(met), pa.string()), pa.array(met // width - 1, pa.int64()),
                    labels.dictionary.take(pa.array(met % width)), pa.array(counts[met], pa.int64())],
                    names=["column", "x", "t", "n"])

    sharing = [v.isin(sorted({key for key, _ in tied})) for v, (_, _, tied) in zip(values, plain, strict=True) if tied]
    tie = F.lit(0).cast("bigint")
    if sharing:  # only rows that share a tied cut's key need one
        tie = F.when(reduce(or_, sharing), F.col(row_id).cast("bigint")).otherwise(tie)
    rows = df.select(target.alias("t"), tie.alias("tie"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
    return rows.mapInArrow(count, "column string, x bigint, t string, n bigint").groupBy(
        "column", "x", "t").agg(F.sum("n").alias("n"))


def association(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                row_id: str = "row_id", small_group: int | None = None) -> DataFrame:
    """Normalised mutual information of every column with the target, rounded to 4 places.

    Works from n·ln n sums over the joint and marginal counts, so no window ever sees all levels
    of a high-cardinality column. Columns of a type without a defined level are reported with
    ``nmi`` NULL and the reason in ``error``.
    """
    types = field_types(df)
    columns = [c for c in (columns or df.columns) if c not in (target, row_id)]
    bad = [c for c in columns if isinstance(types[c], _UNSUPPORTED)]
    good = [c for c in columns if c not in bad]
    cuts = bin_cuts(df, _numeric_columns(df, [target, *good]), row_id, small_group)

    def code(c: str) -> Column:
        return level_code(c, types[c], cuts.get(c), row_id, compact=True)

    # Only which rows share a level counts here, so numbers and dates keep their own type.
    kinds: dict[str, dict[str, Column]] = {}
    for c in [target, *good]:
        if cuts.get(c):
            continue
        if isinstance(types[c], (T.IntegralType, T.FloatType, T.DoubleType, T.DateType)):
            kind, level = _identity(c, types[c])
        else:
            kind, level = "string", code(c)
        kinds.setdefault(kind, {})[c] = level

    def entropy_term(n: str) -> Column:
        return F.sum(F.col(n) * F.log(F.col(n).cast("double")))

    joint = [melt(df, levels, "column", "x", [code(target).alias("t")])
             .groupBy("column", "x", "t").agg(F.count("*").alias("n")) for levels in kinds.values()]
    if cuts:
        joint.append(_bins_counted(df, cuts, code(target), row_id))
    marginal = _union([
        counts.groupBy("column", "x").agg(F.sum("n").alias("nx"), entropy_term("n").alias("s_tx")).drop("x")
        for counts in joint])
    sums = marginal.groupBy("column").agg(
        F.sum("nx").alias("n"), F.sum("s_tx").alias("s_tx"), entropy_term("nx").alias("s_x"),
        F.count("*").alias("levels"))
    # One row per column from here on; the label's own row is read by all the others.
    everything = Window.partitionBy(F.lit(0))
    is_label = F.col("column") == target
    joined = sums.select(
        "*", F.max(F.when(is_label, F.col("s_x"))).over(everything).alias("s_t"),
        F.max(F.when(is_label, F.col("levels"))).over(everything).alias("t_levels"),
    ).filter(~is_label)
    n = F.col("n").cast("double")
    nlogn = n * F.log(n)
    mi = (F.col("s_tx") - F.col("s_t") - F.col("s_x") + nlogn) / n
    mean_entropy = (2 * nlogn - F.col("s_t") - F.col("s_x")) / (2 * n)
    nmi = (
        F.when((F.col("levels") == 1) & (F.col("t_levels") == 1), F.lit(1.0))
        .when(mi <= 2.220446049250313e-16, F.lit(0.0))
        .otherwise(F.abs(F.round(mi / mean_entropy, 4))))
    out = joined.select("column", nmi.alias("nmi"), F.lit(None).cast("string").alias("error"))
    if bad:
        failed = df.sparkSession.createDataFrame(
            [(c, f"unsupported type: {types[c].simpleString()}") for c in bad],
            "column string, error string")
        out = out.unionByName(failed.select(
            "column", F.lit(None).cast("double").alias("nmi"), "error"))
    return out


def evidence(profile: DataFrame, associations: DataFrame, target: str) -> DataFrame:
    """What a judge of leakage is shown: the profile beside the association, target left out."""
    return profile.filter(F.col("column") != target).join(
        F.broadcast(associations), "column", "left")  # one row per column


# ---------------------------------------------------------------- derived figures


def id_like() -> Column:
    """Identifier rule over profile rows: not a float, and almost every row distinct."""
    return (
        ~F.col("dtype").contains("float") & (F.col("n_rows") > 0)
        & (F.col("n_unique") >= vocab.ID_DISTINCT_SHARE * F.col("n_rows")))


def usable_features(profile: DataFrame, target: str,
                    max_levels: int = vocab.MAX_LEVELS) -> DataFrame:
    """Columns still standing after the identifier rule and the one-hot level cap."""
    numeric = F.col("dtype").isin("int64", "float64", "bool")
    wide = ~numeric & (F.col("n_unique") > max_levels)
    return profile.filter((F.col("column") != target) & ~id_like() & ~wide)


def minority_class(df: DataFrame, target: str) -> DataFrame:
    """Rarest label (ties: smallest) and its share of all rows, rounded to 6 places."""
    counts = df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.min(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("least"),
        F.sum("n").alias("total"),
    ).select(F.col("least.label").alias("positive_class"),
             F.round(F.col("least.n") / F.col("total"), 6).alias("positive_rate"))


def measure_table(df: DataFrame, target: str) -> DataFrame:
    """Measurement row of a candidate dataset; a non-binary target is rejected before the
    expensive per-column counts are started."""
    n_classes = df.agg(F.count_distinct(target).alias("n")).first().n
    schema = ("n_rows bigint, n_features bigint, n_classes bigint, n_usable_features bigint, "
              "positive_class string, positive_rate double, failed string")
    width = len(df.columns) - 1
    if n_classes != 2:
        row = (df.count(), width, n_classes, None, None, None, "task_type")
    else:
        profile = column_profile(df)
        usable, n_rows = usable_features(profile, target).agg(
            F.count("*"), F.max("n_rows")).first()
        positive, rate = minority_class(df, target).first()
        row = (n_rows or df.count(), width, n_classes, usable, positive, rate, None)
    return df.sparkSession.createDataFrame([row], schema)


def agreement(predicted: Column, target: Column) -> Column:
    """Share of rows on which a column equals the label (aggregate expression)."""
    return F.avg((predicted == target).cast("double"))


# ---------------------------------------------------------------- label handling


def labelled_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows that can be trained on or scored."""
    return df.filter(F.col(target).isNotNull())


def missing_label_count(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count_if(F.col(target).isNull()).alias("dropped_missing_target"))


def resolve_positive(df: DataFrame, target: str, requested: str | None = None) -> DataFrame:
    """Positive class: the requested one if it occurs, else the last label in string order."""
    label = F.col(target).cast("string")
    seen = F.coalesce(F.bool_or(label == F.lit(requested)), F.lit(False))
    used = F.when(seen, F.lit(requested)).otherwise(F.max(label))
    mismatch = ~seen if requested is not None else F.lit(False)
    return df.agg(used.alias("used"), mismatch.alias("mismatch"))


def encode_target(df: DataFrame, target: str, task: str, positive: str | None = None,
                  output: str = "y") -> DataFrame:
    """0/1 for binary, the string label for multiclass, a number for regression."""
    label = F.col(target).cast("string")
    if task == "binary":
        encoded = F.when(label.isNotNull(), (label == F.lit(positive)).cast("int"))
    elif task == "multiclass":
        encoded = label
    elif task == "regression":
        encoded = F.col(target).try_cast("double")
    else:
        raise ValueError(f"unknown task {task!r}; expected one of {vocab.TASK_TYPES}")
    return df.withColumn(output, encoded)


def class_guard(df: DataFrame, target: str, min_rows: int = vocab.MIN_AGENT_ROWS) -> DataFrame:
    """Rows and non-empty classes, with the reason a table is refused (NULL when it is fine)."""
    label = F.col(target).cast("string")
    present = F.when(label != "", label)
    # Only "at least two classes" matters, so min <> max replaces a distinct count.
    several = F.coalesce(F.min(present) != F.max(present), F.lit(False))
    return df.agg(F.count("*").alias("n_rows"), several.alias("several_classes")).select(
        "n_rows", "several_classes",
        F.when(~F.col("several_classes"), "fewer than two classes")
        .when(F.col("n_rows") < min_rows, "too few rows").alias("refused"))


def scoring_rows(df: DataFrame, y: str = "y") -> DataFrame:
    """Single-class flag and positive count of the rows a score is computed on."""
    present = df.filter(F.col(y).isNotNull())
    return present.agg(
        F.count("*").alias("n_rows"), F.sum(F.col(y).cast("bigint")).alias("n_positive"),
        F.coalesce(F.min(y) == F.max(y), F.lit(True)).alias("single_class"))


def classify_columns(df: DataFrame, target: str | None, drop: Sequence[str] = (),
                     cap: int | None = vocab.MAX_LEVELS) -> dict[str, list[str]]:
    """numeric / categorical / skipped source columns, decided on the rows given (train rows).

    Column names only reach the driver. String columns far above the cap are settled by a sketch;
    the others are counted exactly. A column without a single value is numeric.
    """
    types = field_types(df)
    sources = [c for c in df.columns if c != target and c not in set(drop)]
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "skipped": []}
    texts = [c for c in sources
             if not (is_numeric(types[c]) or isinstance(types[c], (T.BooleanType, T.NullType)))]
    distinct: dict[str, int] = {}
    for chunk in _chunks(texts):
        row = df.agg(*[F.approx_count_distinct(c) for c in chunk]).first()
        distinct.update(zip(chunk, row, strict=True))
    unsure = [c for c in texts if distinct[c] <= 4 * (cap or 0) + 20]
    if cap is not None and unsure:
        for r in unpivot(df, unsure).filter(F.col("value").isNotNull()).groupBy(
                "column", "value").count().groupBy("column").agg(F.count("*").alias("d")).collect():
            distinct[r["column"]] = r.d
    for c in sources:
        if c not in distinct or distinct[c] == 0:
            out["numeric"].append(c)
        elif cap is None or distinct[c] <= cap:
            out["categorical"].append(c)
        else:
            out["skipped"].append(c)
    return out


