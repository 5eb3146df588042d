"""Order-dependent work without a global sort in one task.

Four building blocks carry every rank, quantile, quota, cumulative sum and row number in the
library:

* ``order_statistics``  exact k-th smallest rows per group, for a handful of ranks per group
* ``column_statistics`` the same for a table's columns, by counts alone
* ``running_totals``    prefix sums along one order over arbitrarily many rows
* ``dense_index``       0-based position of every row in a total order, or in file order

None of them puts an unbounded group into one task, and none depends on how rows are distributed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce
from operator import add, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.session import durable

# A group up to this many rows is ranked by one window task; beyond it only sketches and counts run.
SMALL_GROUP = 200_000
_GRID = 256
_ACCURACY = 4_000


@dataclass(frozen=True)
class Cut:
    """The row at ``rank`` in its group. ``tie`` None: every row sharing ``key`` is at or before.

    ``key`` is a Python int where integers were ranked in their own type.
    """

    group: str
    rank: int
    key: float | int
    tie: int | None

    def reached(self, key: Column, tie: Column) -> Column:
        """True for rows at or before this cut in (key, tie) order."""
        if self.tie is None:
            return key <= F.lit(self.key)
        return (key < F.lit(self.key)) | ((key == F.lit(self.key)) & (tie <= F.lit(self.tie)))


def cuts_passed(cuts: list[Cut], key: Column, tie: Column) -> Column:
    """How many of one group's cuts a row lies beyond.

    Keys are compared through one constant array; only rows sharing a cut's key look at ties.
    """
    def constant(c: Cut) -> Column:
        return F.lit(c.key).cast("bigint") if isinstance(c.key, int) else F.lit(float(c.key))

    beyond = F.size(F.filter(F.array(*[constant(c) for c in cuts]), lambda k: k < key))
    tied = [c for c in cuts if c.tie is not None]
    if not tied:
        return beyond
    ties = F.array(*[F.struct(constant(c).alias("k"), F.lit(c.tie).alias("t")) for c in tied])
    further = F.size(F.filter(ties, lambda c: (c["k"] == key) & (c["t"] < tie)))
    return F.when(key.isin(sorted({c.key for c in tied})), beyond + further).otherwise(beyond)


@dataclass(frozen=True)
class _Search:
    """A rank being narrowed down: the answer's key lies strictly between ``low`` and ``high``."""

    group: str
    rank: int
    low: float | None
    high: float | None
    before: int  # rows with key <= low
    inside: int


def order_statistics(
    rows: DataFrame,
    ranks: dict[str, list[int]],
    sizes: dict[str, int],
    *,
    with_tie: bool = True,
    small_group: int | None = None,
    half_tie: bool = False,
) -> list[Cut]:
    """Exact order statistics of ``rows(grp, key[, tie])``, ordered by (key, tie) within ``grp``.

    ``ranks`` asks for a few 1-based ranks of each group, so the answer is a fixed number of
    constants. Groups are columns or classes; ``sizes`` holds their row counts. ``key`` is numeric
    and not NULL; ``tie`` is a bigint that is unique within equal keys.

    Small groups are numbered by a window. For larger groups no row is moved: each round takes one
    approximate-quantile sketch of the surviving interval (map-side combined), counts exactly how
    many rows lie below the chosen pivots, and keeps only the interval holding the rank. The exact
    counts, not the sketch's error bound, decide, so the result is exact; an interval shrinks by
    about the grid size per round.
    """
    limit = SMALL_GROUP if small_group is None else small_group
    wanted = {g: sorted({r for r in rs if 1 <= r <= sizes[g]}) for g, rs in ranks.items()}
    wanted = {g: rs for g, rs in wanted.items() if rs}
    small = {g: rs for g, rs in wanted.items() if sizes[g] <= limit}
    large = {g: rs for g, rs in wanted.items() if sizes[g] > limit}
    found: list[Cut] = []
    if small:
        found += _by_window(rows, small, with_tie)
    if large:
        found += _by_narrowing(rows, large, sizes, with_tie, limit, half_tie)
    return sorted(found, key=lambda c: (c.group, c.rank))


_WORD_BITS = 32  # half of a tie: either half is exact as a double


def _constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver constants (a fixed number per column or class) as a broadcast side."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _by_window(rows: DataFrame, ranks: dict[str, list[int]], with_tie: bool) -> list[Cut]:
    targets = _constants(
        rows.sparkSession, [(g, r) for g, rs in ranks.items() for r in rs], "grp string, rank int")
    order = ["key", "tie"] if with_tie else ["key"]
    numbered = rows.filter(F.col("grp").isin(list(ranks))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
    picked = numbered.join(targets, ["grp", "rank"])
    tie = F.col("tie") if with_tie else F.lit(None).cast("bigint").alias("tie")
    return [Cut(r.grp, r.rank, r.key, r.tie)
            for r in picked.select("grp", "rank", "key", tie).collect()]


def _by_narrowing(rows, ranks, sizes, with_tie, limit, half_tie) -> list[Cut]:
    open_ = [_Search(g, r, None, None, 0, sizes[g]) for g, rs in ranks.items() for r in rs]
    solved: list[tuple[_Search, float, int, int]] = []  # (search, key, rank among ties, ties)
    while open_:
        listing = [s for s in open_ if s.inside <= limit]
        open_ = [s for s in open_ if s.inside > limit]
        if listing:
            solved += _list_interval(rows, listing)
        if open_:
            decided, open_ = _narrow(rows, open_, limit)
            solved += decided
    cuts, tied = [], []
    for search, key, offset, ties in solved:
        if not with_tie or offset == ties:
            cuts.append(Cut(search.group, search.rank, key, None))
        else:
            tied.append((search, key, offset, ties))
    if tied:
        cuts += _break_ties(rows, tied, limit, half_tie)
    return cuts


def _locate(rows: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """Adds ``pos``, the number of the group's bounds below ``key``, and ``eq``, being on a bound.

    A group's few bounds arrive as the columns of one broadcast row, padded with NaN (which no key
    exceeds or equals), so a row is joined once and compared in generated code.
    """
    width = max(1, max(len(b) for b in bounds.values()))
    names = [f"b{i}" for i in range(width)]
    table = _constants(
        rows.sparkSession,
        [(g, *map(float, b), *[math.nan] * (width - len(b))) for g, b in bounds.items()],
        "grp string not null, " + ", ".join(f"{n} double not null" for n in names))
    key = F.col("key").cast("double")
    below = reduce(add, [(key > F.col(n)).cast("int") for n in names])
    reached = reduce(add, [(key >= F.col(n)).cast("int") for n in names])
    return rows.join(table, "grp").select(
        *rows.columns, below.alias("pos"), (below != reached).alias("eq"))


def _bounds_of(searches: list[_Search]) -> dict[str, list[float]]:
    out: dict[str, set[float]] = defaultdict(set)
    for s in searches:
        out[s.group] |= {float(v) for v in (s.low, s.high) if v is not None}
    return {g: sorted(b) for g, b in out.items()}


def _place(search: _Search, bounds: dict[str, list[float]]) -> tuple[str, int]:
    """(group, pos) of the keys strictly inside a search's interval."""
    if search.low is None:
        return search.group, 0
    return search.group, bounds[search.group].index(float(search.low)) + 1


def _inside(rows: DataFrame, searches: list[_Search], bounds: dict[str, list[float]]) -> DataFrame:
    places = _constants(rows.sparkSession, sorted({_place(s, bounds) for s in searches}),
                        "grp string, pos int")
    return _locate(rows, bounds).filter(~F.col("eq")).join(places, ["grp", "pos"])


def _narrow(rows, searches, limit):
    """One sketch and one exact count; returns (decided, still open)."""
    bounds = _bounds_of(searches)
    grid = [i / _GRID for i in range(_GRID + 1)]
    sketch = {
        (r.grp, r.pos): (r.points, r.distinct)
        for r in _inside(rows, searches, bounds).groupBy("grp", "pos").agg(
            F.percentile_approx(F.col("key").cast("double"), grid, _ACCURACY).alias("points"),
            F.approx_count_distinct("key").alias("distinct")).collect()}
    proposals, still_open = [], []
    for s in searches:
        points, distinct = sketch[_place(s, bounds)]
        if distinct <= limit // 2:
            # The interval's keys, once counted, fit one window task: it is listed next round.
            still_open.append(replace(s, inside=0))
            continue
        at = round((s.rank - s.before) / s.inside * _GRID)
        proposals.append((s, points[max(0, at - 1)], points[min(_GRID, at + 1)]))
    decided = []
    if not proposals:
        return decided, still_open
    pivots: dict[str, set[float]] = defaultdict(set)
    for s, lo, hi in proposals:
        pivots[s.group] |= {lo, hi}
    ordered = {g: sorted(b) for g, b in pivots.items()}
    # At most two counts per bound come back; prefix sums over them are the exact ranks.
    counted = {
        (r.grp, r.pos, r.eq): r.n for r in _locate(rows, ordered).groupBy("grp", "pos", "eq").agg(
            F.count("*").alias("n")).collect()}
    below: dict[tuple[str, float], tuple[int, int]] = {}  # keys < bound, keys <= bound
    for g, marks in ordered.items():
        upto = 0
        for i, bound in enumerate(marks):
            upto += counted.get((g, i, False), 0)
            on = counted.get((g, i, True), 0)
            below[(g, bound)] = (upto, upto + on)
            upto += on
    # Every rank moves into the cell between neighbouring pivots of its group, so the intervals of
    # one group are always equal or disjoint.
    for s, _, _ in proposals:
        low, high, before, end = s.low, s.high, s.before, s.before + s.inside
        for mark in ordered[s.group]:
            less, upto = below[(s.group, mark)]
            if less < s.rank <= upto:
                decided.append((s, mark, s.rank - less, upto - less))
                break
            if upto < s.rank and (low is None or mark > low):
                low, before = mark, upto
            elif less >= s.rank:
                if high is None or mark < high:
                    high, end = mark, less
                still_open.append(replace(s, low=low, high=high, before=before,
                                          inside=end - before))
                break
        else:
            still_open.append(replace(s, low=low, high=high, before=before, inside=end - before))
    return decided, still_open


def _list_interval(rows, searches):
    """Resolve ranks whose interval holds few distinct keys: count per key, accumulate, pick."""
    bounds = _bounds_of(searches)
    per_key = _inside(rows, searches, bounds).groupBy("grp", "pos", "key").agg(
        F.count("*").alias("ties"))
    order = Window.partitionBy("grp", "pos").orderBy("key")
    cumulated = per_key.withColumn("upto", F.sum("ties").over(order))
    asks = _constants(
        rows.sparkSession,
        [(i, *_place(s, bounds), s.rank - s.before) for i, s in enumerate(searches)],
        "sid int, grp string, pos int, k bigint")
    hit = cumulated.join(asks, ["grp", "pos"]).filter(
        (F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("ties")))
    return [(searches[r.sid], r.key, r.k - (r.upto - r.ties), r.ties)
            for r in hit.select("sid", "key", "k", "upto", "ties").collect()]


def _break_ties(rows, tied, limit, half_tie) -> list[Cut]:
    """The same search again over ``tie`` among rows sharing the located key.

    Sketches work in doubles, which tell bigints apart only up to 2^53. A tie is therefore searched
    by its high half first and by its low half among rows that share the high one.
    """
    by_place: dict[tuple, list] = defaultdict(list)
    for search, key, offset, ties in tied:
        by_place[(search.group, key, ties)].append((search, offset))
    places = list(by_place)
    lookup = _constants(
        rows.sparkSession, [(g, float(k), str(i)) for i, (g, k, _) in enumerate(places)],
        "grp string, key double, place string")
    sharing = rows.select("grp", F.col("key").cast("double").alias("key"), "tie").join(
        lookup, ["grp", "key"])
    if half_tie:
        sharing = sharing.select(F.col("place").alias("grp"), F.col("tie").alias("key"))
    else:
        sharing = sharing.select(
            F.col("place").alias("grp"), F.shiftright("tie", _WORD_BITS).alias("key"),
            F.col("tie").bitwiseAND((1 << _WORD_BITS) - 1).alias("tie"))
    inner = order_statistics(
        sharing,
        {str(i): [o for _, o in by_place[p]] for i, p in enumerate(places)},
        {str(i): p[2] for i, p in enumerate(places)},
        with_tie=not half_tie, small_group=limit, half_tie=True)
    full = (1 << _WORD_BITS) - 1  # without a low half, every row of the high one is reached
    located = {(c.group, c.rank): int(c.key) if half_tie else
               (int(c.key) << _WORD_BITS) + (full if c.tie is None else c.tie) for c in inner}
    return [Cut(s.group, s.rank, places[i][1], located[(str(i), offset)])
            for i, p in enumerate(places) for s, offset in by_place[p]]


# ---------------------------------------------------------------- ranks of a table's columns

CELLS = 65_536  # counts that one round brings to the driver
COLUMNS_PER_ROUND = 40
_MOST_PIVOTS = 31


@dataclass(frozen=True)
class _Span:
    """Ranks looked for among a column's values in [low, high], of rows with ``key`` where one is given."""

    group: str
    key: float | int | None
    ranks: tuple[int, ...]
    low: float | int | None = None
    high: float | int | None = None
    before: int = 0  # values < low
    inside: int = 0
    crowded: bool = False  # equal steps did not part the values: sketched pivots do


def column_statistics(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]],
                      tie: Column | None = None, cells: int | None = None) -> list[Cut]:
    """``order_statistics`` of the columns ``values`` of one table, missing ones left out.

    A value is a double or a bigint, all of one type, and is compared as such (NaN is to be NULL). No
    row is moved or joined: every round counts the values of each interval that holds a rank in equal steps, with
    the smallest and largest of each step, and goes on with the steps that hold the ranks, at most
    ``cells`` counts for all columns. Where values crowd into few steps, or lie too far apart for
    steps, the next round's bounds are sketched. The counts decide, so the result is exact. Ranks
    among equal values are then looked for over ``tie`` (a bigint) in the same way.
    """
    budget = CELLS if cells is None else cells
    names = [c for c in values if ranks.get(c)]
    found: list[Cut] = []
    for start in range(0, len(names), COLUMNS_PER_ROUND):
        chunk = names[start:start + COLUMNS_PER_ROUND]
        rows = df.select(*[values[c].alias(f"__v{i}") for i, c in enumerate(chunk)],
                         *([] if tie is None else [tie.alias("__tie")]))
        column = {c: F.col(f"__v{i}") for i, c in enumerate(chunk)}
        tied: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        numbers = rows.select(*[f"__v{i}" for i in range(len(chunk))])
        ends = numbers.agg(*[f(f"__v{i}") for i in range(len(chunk)) for f in (F.min, F.max, F.count)]).first()
        spans = [_Span(c, None, tuple(sorted(set(ranks[c]))), *ends[3 * i:3 * i + 2], 0, ends[3 * i + 2])
                 for i, c in enumerate(chunk) if ends[3 * i + 2]]
        for s, rank, key, offset, ties in _spans_searched(numbers, column, None, spans, budget):
            if tie is None or offset == ties:
                found.append(Cut(s.group, rank, key, None))
            else:
                tied[(s.group, key)].append((offset, rank))
        if not tied:
            continue
        shared: dict[str, list] = defaultdict(list)
        for c, key in tied:
            shared[c].append(key)
        sharing = rows.filter(reduce(or_, [column[c].isin(keys) for c, keys in shared.items()]))
        spans = [_Span(c, key, tuple(sorted({o for o, _ in asked}))) for (c, key), asked in tied.items()]
        places = {(s.group, s.key, offset): at for s, offset, at, _, _ in _spans_searched(
            sharing, {c: F.col("__tie") for c in shared}, column, spans, budget)}
        found += [Cut(c, rank, key, places[(c, key, offset)])
                  for (c, key), asked in tied.items() for offset, rank in asked]
    return sorted(found, key=lambda c: (c.group, c.rank))


def _number(value: float | int) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)


def _steps(span: _Span, width: int) -> float | None:
    """Steps per unit that cut [low, high] into ``width``; None where doubles cannot hold them."""
    if span.low == span.high:
        return 1.0
    try:
        scale = width / float(span.high - span.low)
    except (OverflowError, ZeroDivisionError):
        return None
    return scale if math.isfinite(scale) and scale > 0 else None


def _held(span: _Span, value: Column, keys: dict[str, Column] | None) -> Column:
    """Whether a row's value lies in the span."""
    inside = value.isNotNull() if span.low is None else (
        (value >= _number(span.low)) & (value <= _number(span.high)))
    return inside if keys is None else (keys[span.group] == _number(span.key)) & inside


def _counter(spans: list[_Span], width: int, pivots: dict[_Span, list], at: dict[str, int], whole: bool,
             tied: bool):
    """A function over Arrow batches: values per step of every span with the least and the largest.

    A task adds up its batches and returns one row per step that it met. The columns' values stand
    first in a batch, ``tie`` last; ``whole`` says that what is searched is a bigint.
    """
    plain = [(i * width, at[s.group], s.key, s.low, s.high, _steps(s, width) if s.low is not None else None,
              pivots.get(s)) for i, s in enumerate(spans)]
    total = len(spans) * width

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def array(column):
            given = column.is_valid().to_numpy(zero_copy_only=False)
            return column.fill_null(0).to_numpy(zero_copy_only=False), given

        limits = np.iinfo(np.int64) if whole else None
        least, most = (limits.min, limits.max) if whole else (-np.inf, np.inf)
        n = np.zeros(total, np.int64)
        low = np.full(total, most, np.int64 if whole else np.float64)
        high = np.full(total, least, np.int64 if whole else np.float64)
        for batch in batches:
            columns = {i: array(batch.column(i)) for i in {p[1] for p in plain}}
            ties = array(batch.column(batch.num_columns - 1))[0] if tied else None
            for start, i, key, lo, hi, scale, marks in plain:
                values, held = columns[i]
                if tied:
                    held, values = held & (values == key), ties
                if lo is not None:
                    held = held & (values >= lo) & (values <= hi)
                found = values[held]
                if not len(found):
                    continue
                if lo is None:
                    n[start] += len(found)
                    low[start], high[start] = min(low[start], found.min()), max(high[start], found.max())
                    continue
                found = np.sort(found)
                if marks:
                    step = np.searchsorted(marks, found, "left") + np.searchsorted(marks, found, "right")
                else:
                    near = not whole or hi - lo < 1 << 63
                    distance = (found - lo).astype(np.float64) if near else found.astype(np.float64) - float(lo)
                    step = np.minimum(np.floor(distance * scale).astype(np.int64), width - 1)
                edges = np.flatnonzero(np.diff(step)) + 1  # steps rise with the sorted values
                first, last = np.append(0, edges), np.append(edges, len(found))
                cell = start + step[first]
                n[cell] += last - first
                low[cell] = np.minimum(low[cell], found[first])
                high[cell] = np.maximum(high[cell], found[last - 1])
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(low[met]), pa.array(high[met])],
                                         names=["code", "n", "low", "high"])

    return count


def _sketched(rows, values, keys, spans: list[_Span]) -> dict[_Span, list]:
    """For each span, values next to its ranks by an approximate quantile sketch."""
    if not spans:
        return {}
    grid = [i / _GRID for i in range(_GRID + 1)]
    row = rows.agg(*[F.percentile_approx(F.when(_held(s, values[s.group], keys), values[s.group]), grid, _ACCURACY)
                     for s in spans]).first()
    out = {}
    for s, points in zip(spans, row, strict=True):
        at = [round((r - s.before) / s.inside * _GRID) for r in s.ranks]
        near = sorted({points[min(_GRID, max(0, i + d))] for i in at for d in (-1, 1)})
        out[s] = near[:_MOST_PIVOTS]
    return out


def _spans_searched(rows, values, keys, spans: list[_Span], budget: int) -> list[tuple]:
    """(span, rank, value, rank among equal values, equal values) of every rank of the spans.

    ``values`` are columns of ``rows``; with ``keys`` only rows with a span's key count for it.
    """
    solved, narrowed = [], False
    at = {c: i for i, c in enumerate(values if keys is None else keys)}
    whole = keys is not None or isinstance(rows.schema[0].dataType, T.LongType)
    while spans:
        width = max(2 * _MOST_PIVOTS + 1, budget // len(spans))
        pivots = _sketched(rows, values, keys, [
            s for s in spans if s.low is not None and (s.crowded or _steps(s, width) is None)])
        kind = "bigint" if whole else "double"
        counted = rows.mapInArrow(
            _counter(spans, width, pivots, at, whole, keys is not None),
            f"code bigint, n bigint, low {kind}, high {kind}").groupBy("code").agg(
                F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        steps: dict[int, list] = defaultdict(list)
        for r in sorted(counted, key=lambda r: r.code):
            steps[r.code // width].append(r)
        left, kept = [], defaultdict(set)
        for i, s in enumerate(spans):
            upto = s.before
            for r in steps[i]:
                within = tuple(k for k in s.ranks if upto < k <= upto + r.n)
                if within and r.low == r.high:
                    solved += [(s, k, r.low, k - upto, r.n) for k in within]
                elif within:
                    crowded = s.low is not None and not s.crowded and 8 * r.n > s.inside > _GRID
                    left.append(replace(s, ranks=within, low=r.low, high=r.high, before=upto, inside=r.n,
                                        crowded=crowded))
                    kept[i].add(r.code % width)
                upto += r.n
        if keys is None and not whole and not pivots and left and not narrowed:
            # Later rounds read only rows whose step of this round holds a rank.
            rows, narrowed = rows.filter(reduce(or_, [
                F.least(F.floor((values[s.group] - F.lit(s.low)) * F.lit(_steps(s, width))), F.lit(width - 1))
                .isin(sorted(kept[i])) for i, s in enumerate(spans) if kept[i]])), True
        spans = left
    return solved


# ---------------------------------------------------------------- places of draws

_PREFIX_BITS = 16


def draw_places(rows: DataFrame, held: DataFrame | None = None, bits: int = 52) -> DataFrame:
    """``rows(grp, key, tie)`` with ``place``, 1-based by (key, tie) within ``grp``, and ``size``.

    ``key`` is a uniform draw in [0, 2^bits), so its first 16 bits deal a group of any size evenly:
    rows are numbered within group and prefix, and the counts of the prefixes before, at most
    65,536 a group, give the start. It takes any number of groups and brings nothing to the driver.
    ``held`` adds its columns, one row per ``grp``; it meets the counts, never the rows.
    """
    dealt = rows.withColumn("__prefix", F.shiftright("key", bits - _PREFIX_BITS))
    per_prefix = dealt.groupBy("grp", "__prefix").agg(F.count("*").alias("__n"))
    group = Window.partitionBy("grp")
    starts = per_prefix.select(
        "grp", "__prefix",
        (F.sum("__n").over(group.orderBy("__prefix")) - F.col("__n")).alias("__start"),
        F.sum("__n").over(group).alias("size"))
    if held is not None:
        starts = starts.join(held, "grp")
    within = F.row_number().over(Window.partitionBy("grp", "__prefix").orderBy("key", "tie"))
    kept = [c for c in starts.columns if c not in ("grp", "__prefix", "__start")]
    return dealt.withColumn("__at", within).join(starts, ["grp", "__prefix"]).select(
        *rows.columns, (F.col("__start") + F.col("__at")).alias("place"), *kept)


# ---------------------------------------------------------------- prefix sums


ROWS_PER_RANGE = 1_000_000


def range_splits(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Strictly increasing bucket bounds holding about equally many rows, from one sketch.

    Without ``buckets`` there are at least 256, and more where a range would pass
    ``ROWS_PER_RANGE``; then a finer sketch follows. A table small enough for one window task gets
    a single bucket.
    """
    def sketch(parts: int) -> Column:
        grid = [i / parts for i in range(1, parts)]
        return F.percentile_approx(F.col(order).cast("double"), grid, max(_ACCURACY, 4 * parts))

    n, points = df.agg(F.count("*"), sketch(buckets or _GRID)).first()
    if n <= SMALL_GROUP:
        return [-math.inf, math.inf]
    if buckets is None and n > _GRID * ROWS_PER_RANGE:
        points = df.agg(sketch(math.ceil(n / ROWS_PER_RANGE))).first()[0]
    return [-math.inf, *sorted(set(points or [])), math.inf]


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, Column],
    group: list[str] | None = None,
    *,
    buckets: int | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """Add inclusive prefix sums of ``totals`` along ``order`` within ``group``.

    ``order`` is numeric and unique within a group. Rows are placed into value ranges of similar
    size; each range is accumulated by its own window task, and the ranges' own totals (one row
    per range and group) supply the offset. The bounds are constants, so a recomputed task
    places its rows identically.
    """
    group = group or []
    bounds = splits or range_splits(df, order, buckets)
    staged = df
    for name, value in totals.items():
        staged = staged.withColumn(f"__v_{name}", value)
    staged = staged.withColumn("__order", F.col(order).cast("double"))
    if len(bounds) > 2:
        placed = Bucketizer(splits=bounds, inputCol="__order", outputCol="__bucket").transform(
            staged).withColumn("__bucket", F.col("__bucket").cast("int"))
    else:
        placed = staged.withColumn("__bucket", F.lit(0))
    local = Window.partitionBy(*group, "__bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = placed.select(
        "*", *[F.sum(f"__v_{n}").over(local).alias(f"__w_{n}") for n in totals])
    if len(bounds) == 2:
        out = within.select(*df.columns, *[F.col(f"__w_{n}").alias(n) for n in totals])
        return out
    per_bucket = placed.groupBy(*group, "__bucket").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in totals])
    earlier = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group, "__bucket",
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}")
          for n in totals])
    keys = [*group, "__bucket"]
    if not group:
        offsets = F.broadcast(offsets)  # one row per range
    joined = within.join(offsets, keys)
    return joined.select(
        *df.columns, *[(F.col(f"__w_{n}") + F.col(f"__o_{n}")).alias(n) for n in totals])


# ---------------------------------------------------------------- row numbers

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the in-partition position in the low 33 bits


def dense_index(df: DataFrame, order: list | None = None, name: str = "row_id") -> DataFrame:
    """Number rows 0..n-1 in ``order`` (a total order), or in file order when none is given.

    The numbered copy is written to the checkpoint folder before anything reads it, so a lost
    executor cannot renumber rows; only one count per partition passes through the driver's side.
    """
    source = df.orderBy(*order) if order else df
    numbered = durable(source.withColumn("__mono", F.monotonically_increasing_id()))
    part = F.shiftright("__mono", _LOCAL_BITS)
    counts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counts.select(  # one row per partition of the written copy
        "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")))
    position = F.col("__start") + F.col("__mono").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return (
        numbered.withColumn("__part", part).join(starts, "__part")
        .withColumn(name, position.cast(T.LongType()))
        .select(*df.columns, name))
