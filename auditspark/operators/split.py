"""Withheld rows, pinned folds and the checks that keep them honest.

Rows are drawn by a hash of (seed, row id), so a split depends on neither row order nor
partitioning. Quotas are met by locating threshold draws per class, not by sorting the class.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions import vocab
from auditspark.functions.exprs import draw
from auditspark.operators import ranking
from auditspark.operators.profile import class_guard
from auditspark.operators.ranking import Cut, order_statistics
from auditspark.session import durable
from auditspark.sources.fingerprint import row_digest, table_fingerprint

HOLDOUT = "h"


def _stratum(target: str) -> Column:
    return F.coalesce(F.col(target).cast("string"), F.lit(""))


# ---------------------------------------------------------------- withheld carve


def withhold(df: DataFrame, target: str, fraction: float, seed: int = vocab.DEFAULT_SEED,
             row_id: str = "row_id", small_group: int | None = None) -> DataFrame:
    """Flag ``withheld``: per label, max(1, floor(fraction * n)) rows but never all of them.

    A missing label is its own group and a single-row class stays. Where every class is small enough
    for one task, classes are numbered by a window. Otherwise no class is gathered: up to
    BROADCAST_CLASSES classes get one threshold each, found over (label, draw, id) alone, and the
    rows only meet their label's; of more, rows are numbered within label and draw prefix, so that
    a hot label among them is dealt over many tasks.
    """
    if not 0 <= fraction < 1:
        raise ValueError(f"fraction must be in [0, 1), got {fraction}")
    if fraction == 0:
        return df.withColumn("withheld", F.lit(False))
    limit = ranking.SMALL_GROUP if small_group is None else small_group
    columns = df.columns
    staged = df.select(
        "*", _stratum(target).alias("__label"), draw(seed, F.col(row_id)).alias("__draw"))

    def take(n: Column) -> Column:
        return F.least(F.greatest(F.lit(1), F.floor(F.lit(fraction) * n)), n - 1)

    largest, n_classes = staged.groupBy("__label").agg(F.count("*").alias("n")).agg(
        F.max("n"), F.count("*")).first()
    if (largest or 0) <= limit:
        label = Window.partitionBy("__label")
        place = F.row_number().over(label.orderBy("__draw", row_id))
        return staged.withColumn("withheld", place <= take(F.count("*").over(label))).select(
            *columns, "withheld")
    keys = [F.col("__label").alias("grp"), F.col("__draw").alias("key"), F.col(row_id).alias("tie")]
    if n_classes > BROADCAST_CLASSES:
        numbered = ranking.draw_places(staged.select(F.struct(*columns).alias("__row"), *keys))
        return numbered.select("__row.*", (F.col("place") <= take(F.col("size"))).alias("withheld"))
    cuts = F.broadcast(durable(ranking.draw_places(staged.select(*keys)).where(
        F.col("place") == take(F.col("size"))).select(
            F.col("grp").alias("__label"), F.col("key").alias("__cut"), F.col("tie").alias("__cut_tie"))))
    reached = (F.col("__draw") < F.col("__cut")) | (
        (F.col("__draw") == F.col("__cut")) & (F.col(row_id) <= F.col("__cut_tie")))
    return staged.join(cuts, "__label", "left").withColumn(
        "withheld", F.coalesce(reached, F.lit(False))).select(*columns, "withheld")


def partition(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agent rows, withheld rows); together they are the source, value for value."""
    return (flagged.filter(~F.col("withheld")).drop("withheld"),
            flagged.filter("withheld").drop("withheld"))


# ---------------------------------------------------------------- pinned train / holdout / folds


def _largest_remainder(total: int, counts: dict[str, int]) -> dict[str, int]:
    """Share ``total`` over the classes in proportion to their size; ties go to the first label."""
    n = sum(counts.values())
    exact = {c: total * k / n for c, k in counts.items()}
    quota = {c: math.floor(v) for c, v in exact.items()}
    spare = total - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))[:spare]:
        quota[c] += 1
    return quota


def _fold_sizes(train: dict[str, int], k: int, stratified: bool) -> dict[str, list[int]]:
    """Rows of each class in each fold.

    Stratified: class-sorted rows are dealt round-robin. Plain: the first n % k folds get one more.
    """
    sizes: dict[str, list[int]] = {}
    start = 0
    for c in sorted(train):
        n = train[c]
        if stratified:
            sizes[c] = [len(range((i - start) % k, n, k)) for i in range(k)]
        else:
            sizes[c] = [n // k + (1 if i < n % k else 0) for i in range(k)]
        start += n
    return sizes


@dataclass(frozen=True)
class SplitSpec:
    """How rows are dealt.

    ``max_classes`` is for callers to whom a label with more levels is no class label: its rows are
    then drawn without regard to it. None, the default, stratifies over any number of classes.
    """

    strategy: str = "stratified"
    seed: int = vocab.DEFAULT_SEED
    fraction: float = vocab.HOLDOUT_FRACTION
    folds: int = vocab.N_FOLDS
    max_classes: int | None = None

    def __post_init__(self) -> None:
        if self.strategy not in ("stratified", "random"):
            # Assigning these rows at random would record a split that was never made.
            raise ValueError(f"split strategy {self.strategy!r} is not supported")
        if not 2 <= self.folds <= vocab.MAX_FOLDS:
            raise ValueError(f"folds must be in 2..{vocab.MAX_FOLDS}, got {self.folds}")
        if not 0 < self.fraction < 1:
            raise ValueError(f"fraction must be in (0, 1), got {self.fraction}")


def pin_split(df: DataFrame, target: str, spec: SplitSpec = SplitSpec(),  # noqa: B008
              row_id: str = "row_id", small_group: int | None = None,
              driver_classes: int | None = None) -> DataFrame:
    """Assignment table (row_id, part): ``h`` for the holdout, ``0``..``k-1`` for the folds.

    The holdout takes ceil(fraction * n) rows. The stratified strategy shares it over the classes
    by largest remainder; with more than ``spec.max_classes`` classes the draw ignores the label.
    The strategy really applied is kept with ``part``, where :func:`split_manifest` finds it. Up to
    ``driver_classes`` classes (DRIVER_CLASSES) get k threshold draws each and the rows are only
    scanned; of more, sizes, quotas and places stay tables. Both ways assign alike.
    """
    limit = ranking.SMALL_GROUP if small_group is None else small_group
    counts: dict[str, int] = {}
    stratified = False
    if spec.strategy == "stratified":
        few = DRIVER_CLASSES if driver_classes is None else driver_classes
        most = math.inf if spec.max_classes is None else spec.max_classes
        classes = durable(df.groupBy(_stratum(target).alias("grp")).agg(F.count("*").alias("n")))
        found = classes.limit(min(few, most) + 1).collect()  # one more than allowed is enough to know
        if len(found) <= min(few, most):
            stratified, counts = True, {r.grp: r.n for r in found}
        elif len(found) <= most and (most == math.inf or classes.limit(most + 1).count() <= most):
            return _pin_by_table(df, target, spec, row_id, classes)
    if not stratified:
        counts = {"": df.count()}
    group = _stratum(target) if stratified else F.lit("")
    n = sum(counts.values())
    quota = _largest_remainder(math.ceil(spec.fraction * n), counts)
    folds = _fold_sizes({c: counts[c] - quota[c] for c in counts}, spec.folds, stratified)
    ends: dict[str, list[int]] = {}
    for c in counts:
        upto, ends[c] = quota[c], [quota[c]]
        for size in folds[c]:
            upto += size
            ends[c].append(upto)
    staged = df.select(
        F.col(row_id).cast("bigint").alias("tie"), draw(spec.seed, F.col(row_id)).alias("key"),
        group.alias("grp"))
    cuts = order_statistics(staged, ends, counts, small_group=limit)
    thresholds = df.sparkSession.createDataFrame(
        _thresholds(ends, {(c.group, c.rank): c for c in cuts}),
        "grp string, cuts array<struct<part:string,key:bigint,tie:bigint>>")
    if len(ends) <= BROADCAST_CLASSES:
        thresholds = F.broadcast(thresholds)
    reached = F.filter("cuts", lambda c: (F.col("key") < c["key"]) | (
        (F.col("key") == c["key"]) & (F.col("tie") <= c["tie"])))
    part = F.coalesce(F.get(reached, F.lit(0))["part"], F.lit(str(spec.folds - 1)))
    return staged.join(thresholds, "grp").select(
        F.col("tie").alias("row_id"), part.alias(
            "part", metadata={"strategy": "stratified" if stratified else "random"}))


def _pin_by_table(df: DataFrame, target: str, spec: SplitSpec, row_id: str, classes: DataFrame) -> DataFrame:
    """:func:`pin_split` for any number of ``classes`` (``grp``, ``n``): the driver sees their distinct
    sizes only, of which N rows have less than the root of 2 N.

    Classes of one size have one remainder, so the sizes tell which remainders are topped up and how
    many classes of the last one are, first labels first. Those, and the round-robin start of a class,
    are prefix sums over the labels, sorted once; a row's part follows from its place.
    """
    staged = df.select(F.col(row_id).cast("bigint").alias("tie"), draw(spec.seed, F.col(row_id)).alias("key"),
                       _stratum(target).alias("grp"))
    sizes = {r.n: r.k for r in classes.groupBy("n").agg(F.count("*").alias("k")).collect()}
    total = sum(n * k for n, k in sizes.items())
    n_test, k = math.ceil(spec.fraction * total), spec.folds
    shares = {n: float(n_test) * n / float(total) for n in sizes}
    left = n_test - sum(math.floor(v) * sizes[n] for n, v in shares.items())
    remainders: dict[float, int] = defaultdict(int)
    for n, v in shares.items():
        remainders[v - math.floor(v)] += sizes[n]
    for last in sorted(remainders, reverse=True):
        if left <= remainders[last]:
            break
        left -= remainders[last]
    exact = F.lit(float(n_test)) * F.col("n") / F.lit(float(total))
    over = exact - F.floor(exact)
    ordered = ranking.dense_index(classes.select(
        "grp", "n", (F.floor(exact) + (over > last).cast("bigint")).alias("sure"),
        (over == last).cast("bigint").alias("tied")), [F.col("grp")], "at")
    summed = ranking.running_totals(
        ordered, "at", {"upto": F.col("n") - F.col("sure"), "nth": F.col("tied")}).withColumn(
        "quota", F.col("sure") + F.when(F.col("nth") <= left, F.col("tied")).otherwise(0)).withColumn(
        "train", F.col("n") - F.col("quota"))
    start = F.col("upto") - F.least(F.col("nth"), F.lit(left)) - F.col("train")
    ends = [F.col("quota")]
    for i in range(k):
        behind = F.pmod(F.lit(i) - start, F.lit(k))
        ends.append(ends[-1] + F.floor((F.col("train") + (k - 1) - behind) / k))
    bounds = summed.select("grp", F.array(*ends).alias("ends"))
    first = F.array_position(F.transform("ends", lambda e: e >= F.col("place")), True)
    part = F.when(first == 1, F.lit(HOLDOUT)).otherwise((first - 2).cast("string"))
    return ranking.draw_places(staged, bounds).select(
        F.col("tie").alias("row_id"), part.alias("part", metadata={"strategy": "stratified"}))


#: Classes that the driver deals itself, a few numbers each.
DRIVER_CLASSES = 10_000
#: Classes whose thresholds, a few hundred bytes each, are broadcast; more are joined by shuffle.
BROADCAST_CLASSES = 10_000


def _thresholds(ends: dict[str, list[int]], at: dict[tuple[str, int], Cut]) -> list[tuple]:
    """Per class its parts in order, each with the last draw that it takes."""
    last = (1 << 63) - 1
    rows = []
    for group, bounds in ends.items():
        named = zip([HOLDOUT, *map(str, range(len(bounds) - 1))], bounds, strict=True)
        cuts = [(name, at[(group, bound)]) for name, bound in named if bound > 0]
        rows.append((group, [(name, int(c.key), last if c.tie is None else c.tie)
                             for name, c in cuts]))
    return rows


# ---------------------------------------------------------------- manifest, verification


def part_counts(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("part").agg(F.count("*").alias("n"))


_FAN_IN = 4096


def assignment_digest(assignment: DataFrame) -> str:
    """sha256 tree over the parts in row order: chunks of 4096 rows, then chunks of digests.

    Each level groups at most 4096 short strings, so the digest of any number of rows never
    gathers more than that in one place.
    """
    lowest = assignment.agg(F.least(F.min("row_id"), F.lit(0)).alias("m")).first().m
    level = assignment.select((F.col("row_id") - F.lit(lowest or 0)).alias("pos"),
                              F.col("part").alias("text"))  # below zero, chunks would never meet
    while True:
        level = (
            level.groupBy(F.floor(F.col("pos") / _FAN_IN).cast("bigint").alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("items"))
            .select(F.col("chunk").alias("pos"),
                    F.sha2(F.array_join(F.col("items.text"), ""), 256).alias("text")))
        first = level.limit(2).collect()
        if len(first) <= 1:
            return first[0].text if first else ""


def split_manifest(assignment: DataFrame, spec: SplitSpec, target: str) -> DataFrame:
    """One header row describing a pinned split, with the strategy that was really applied."""
    applied = assignment.schema["part"].metadata.get("strategy", spec.strategy)
    counts = {r.part: r.n for r in part_counts(assignment).collect()}  # at most 11 parts
    known = {HOLDOUT, *[str(i) for i in range(spec.folds)]}
    if set(counts) - known:
        raise ValueError(f"unknown parts {sorted(map(str, set(counts) - known))}")
    return assignment.sparkSession.createDataFrame(
        [("complement", applied, spec.seed, target, sum(counts.values()), spec.folds,
          spec.fraction, counts, assignment_digest(assignment))],
        "fold_train string, strategy string, seed bigint, target string, n_rows bigint, "
        "n_folds int, holdout_fraction double, counts map<string,bigint>, digest string")


def split_problems(df: DataFrame, assignment: DataFrame, manifest: DataFrame | None = None,
                   row_id: str = "row_id") -> DataFrame:
    """(problem, n) rows; empty when every row of ``df`` is in exactly one known part."""
    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"))
    known = F.coalesce(F.col("part").rlike("^(h|[0-9])$"), F.lit(False))
    tagged = rows.select("row_id", F.lit(1).alias("f"), F.lit(0).alias("a"), F.lit(0).alias(
        "odd")).unionByName(assignment.select(
            "row_id", F.lit(0).alias("f"), F.lit(1).alias("a"), (~known).cast("int").alias("odd")))
    per_row = tagged.groupBy("row_id").agg(*[F.sum(c).alias(c) for c in ("f", "a", "odd")])
    wide = per_row.agg(
        F.count_if((F.col("f") > 0) & (F.col("a") == 0)).alias("unassigned"),
        F.count_if((F.col("f") == 0) & (F.col("a") > 0)).alias("not_in_frame"),
        F.count_if(F.col("a") > 1).alias("assigned_twice"),
        F.count_if(F.col("odd") > 0).alias("unknown_part"))
    out = wide.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("problem"), F.col(x).alias("n")) for x in wide.columns
    ])).alias("p")).select("p.problem", "p.n")
    if manifest is not None:
        stated = manifest.select(F.explode("counts").alias("part", "stated"))
        rule = manifest.filter(F.col("fold_train") != "complement").agg(
            F.lit("unknown_fold_rule").alias("problem"), F.count("*").alias("n"))
        counted = part_counts(assignment).join(stated, "part", "full_outer").agg(
            F.lit("count_mismatch").alias("problem"),
            F.count_if(~F.col("n").eqNullSafe(F.col("stated"))).alias("n"))
        out = out.unionByName(counted).unionByName(rule)
    return out.filter(F.col("n") > 0)


def verify_split(df: DataFrame, assignment: DataFrame, manifest: DataFrame | None = None,
                 row_id: str = "row_id") -> None:
    problems = split_problems(df, assignment, manifest, row_id).collect()
    if problems:
        raise ValueError("; ".join(f"{p.problem}: {p.n}" for p in problems))


def attach(df: DataFrame, assignment: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows with their part, one for each row of ``df``.

    An id that the assignment holds more than once is an error (joining it would multiply rows), and
    so is a row whose id the assignment lacks, a null id among them: no row vanishes unseen.
    """
    held = assignment.groupBy(F.col("row_id").alias(row_id)).agg(
        F.first("part").alias("__part"), F.count("*").alias("__n"))

    def refused(what: str) -> Column:
        named = F.coalesce(F.col(row_id).cast("string"), F.lit("null"))
        return F.raise_error(F.concat(F.lit(what), named)).cast("string")

    found = F.when(F.col("__n") > 1, refused("row id assigned more than once: ")).when(
        F.col("__n").isNull(), refused("row id without an assignment: ")).otherwise(F.col("__part"))
    return df.join(held, row_id, "left").withColumn("part", found).drop("__part", "__n")


def fold_train(assigned: DataFrame, fold: int) -> DataFrame:
    """Complement rule: train rows outside the fold."""
    return assigned.filter((F.col("part") != HOLDOUT) & (F.col("part") != str(fold)))


def fold_valid(assigned: DataFrame, fold: int) -> DataFrame:
    return assigned.filter(F.col("part") == str(fold))


def expand_folds(assignment: DataFrame, folds: int) -> DataFrame:
    """(fold, role, row_id) for every train row and every fold."""
    return (
        assignment.filter(F.col("part") != HOLDOUT)
        .select("row_id", "part", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
        .select("fold", F.when(F.col("part") == F.col("fold").cast("string"), "valid")
                .otherwise("train").alias("role"), "row_id"))


def row_overlap(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``a`` whose values also occur in ``b``; must be empty for a withheld table.

    Copies are collapsed on ``b``'s side before the join, so a hot value costs one row there.
    """
    columns = columns or [c for c in a.columns if c in b.columns]
    digests = b.select(row_digest(b, columns).alias("__digest")).distinct()
    return a.withColumn("__digest", row_digest(a, columns)).join(
        digests, "__digest", "left_semi").drop("__digest")


# ---------------------------------------------------------------- prepare


@dataclass(frozen=True)
class Prepared:
    """What a run is given and what is kept from it."""

    agent: DataFrame
    withheld: DataFrame | None
    target: str
    fraction: float
    fingerprint: DataFrame


def prepare(df: DataFrame, target: str, fraction: float, seed: int = vocab.DEFAULT_SEED,
            row_id: str = "row_id", naming: str = "descriptive") -> Prepared:
    """Rename, carve, guard and fingerprint. Fraction 0 leaves the table untouched."""
    from auditspark.operators.naming import rename_map

    mapping = rename_map([c for c in df.columns if c != row_id], target, naming)
    named = df.withColumnsRenamed(mapping)
    if fraction == 0:
        return Prepared(named, None, target, 0.0, table_fingerprint(named))
    agent, held = partition(withhold(named, target, fraction, seed, row_id))
    refused = class_guard(agent, target).first().refused
    if refused:
        raise ValueError(f"cannot withhold rows: {refused}")
    return Prepared(agent, held, target, fraction, table_fingerprint(agent))
