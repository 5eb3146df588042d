"""Deep random forests over long tables.

Spark ML grows a forest in rounds, each a job that returns the statistics of the open nodes; deep trees over
distinct rows have too many of them. Here only nodes of more than ``GROUP_ROWS`` rows are divided by counts over
all rows. The rows of every smaller node are shuffled together, and a task grows what is below it.

The law is Spark ML's: each row is drawn Poisson(1) times a tree, a node looks at a random subset of the features,
the best gain (gini or variance) over the bins divides it, leaves that predict the same are one, and a row's
probability is the mean of its leaves'. Features are numbers of bins, and equal rows are kept once with their count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import durable

#: Most rows (equal ones together) of a node that one task grows. Their numbers take 20 bits of a sort key.
GROUP_ROWS = 250_000
#: Rows a task reads at once, rows scored together (fewer where there are more than two classes), and equal rows drawn by one number.
PART_ROWS, SCORED_ROWS, DRAWN_AT_ONCE = 50_000, 20_000, 64

#: Partitions the nodes' groups are dealt over, at most.
MOST_PARTS = 1_000

_TREE = "tree int, node int, size int, feature binary, cut binary, left binary, value binary"


@dataclass(frozen=True)
class Recipe:
    """What every task needs to know; ``classes`` is 0 for a number, and two classes are one share."""

    trees: int
    subset: int
    depth: int
    seed: int
    classes: int

    @property
    def width(self) -> int:
        return self.classes if self.classes > 2 else 1

    def goals(self, y: np.ndarray) -> np.ndarray:
        if self.classes > 2:
            return (y[:, None] == np.arange(self.classes)).astype(float)
        return y[:, None].astype(float)

    def predicted(self, value: np.ndarray) -> np.ndarray:
        if self.classes > 2:
            return value.argmax(1)
        return value[:, 0] > 0.5 if self.classes else value[:, 0]


def _poisson_steps() -> tuple[np.ndarray, np.ndarray]:
    """``c`` plus the distribution function of Poisson(c), for all c in a row, and where each c begins."""
    steps, starts = [], [0, 0]
    for c in range(1, DRAWN_AT_ONCE + 1):
        chance, below, k = math.exp(-c), 0.0, 0
        while k <= c or chance > 1e-18:
            below += chance
            steps.append(c + min(below, 1.0))
            k += 1
            chance *= c / k
        steps[-1] = c + 1.0
        starts.append(len(steps))
    return np.array(steps), np.array(starts)


_STEPS, _STARTS = _poisson_steps()


def drawn(h: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row of ``n`` equal ones: Poisson(n), fixed by the row's hash."""
    z = h.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(24)) * 2.0**-40
    return np.searchsorted(_STEPS, n + u, side="right") - _STARTS[n]


def walked(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node at which each row ends: left up to the cut, else the node after."""
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        live = live[feature[at[live]] >= 0]
        if not len(live):
            return at
        here = at[live]
        at[live] = left[here] + (x[live, feature[here]] > cut[here])


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- one node's rows, grown by a task


def _best(x, at, w, goals, total, sums, chosen):
    """The best (feature or -1, cut) of every node; ``at`` numbers the rows' nodes in ascending order."""
    bits = len(at).bit_length()
    before = np.r_[0.0, np.cumsum(total)]
    before_goals = np.vstack([np.zeros(sums.shape[1]), np.cumsum(sums, 0)])
    gains, feature = np.zeros(len(total)), np.full(len(total), -1, np.int32)
    cut = np.zeros(len(total), np.int32)
    number = np.arange(len(at))
    for tried in chosen.T:
        key = ((at << 16 | x[number, tried[at]]) << bits) | number
        key.sort()
        order, cell = key & ((1 << bits) - 1), key >> bits
        last = np.flatnonzero(cell[1:] != cell[:-1])
        last = last[cell[last] >> 16 == cell[last + 1] >> 16]
        if not len(last):
            continue
        node = cell[last] >> 16
        inside = np.cumsum(w[order])[last] - before[node]
        goal = np.cumsum(goals[order], 0)[last] - before_goals[node]
        d = goal * total[node, None] - sums[node] * inside[:, None]
        gain = (d * d).sum(1) / (total[node] * inside * (total[node] - inside))
        runs = _runs(node)
        most = np.maximum.reduceat(gain, runs)
        hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[runs, len(node)])))
        hit = hit[_runs(node[hit])]
        owner = node[hit]
        better = most > gains[owner]
        owner, hit = owner[better], hit[better]
        gains[owner], feature[owner], cut[owner] = most[better], tried[owner], cell[last[hit]] & 0xFFFF
    return feature, cut


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, recipe: Recipe, depth: int,
          rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, value) of the tree below one node, level by level; a leaf's feature is -1."""
    bits = len(x).bit_length()
    w = w.astype(float)
    goals = recipe.goals(y)
    shift = np.zeros(1) if recipe.classes else np.array([np.average(y, weights=w)])
    goals = (goals - shift) * w[:, None]
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    levels, at = [], 0
    for level in range(depth + 1):
        runs = _runs(node)
        total, sums = np.add.reduceat(w[row], runs), np.add.reduceat(goals[row], runs)
        feature, cut = np.full(len(runs), -1, np.int32), np.zeros(len(runs), np.int32)
        left = np.zeros(len(runs), np.int32)
        mixed = np.minimum.reduceat(y[row], runs) < np.maximum.reduceat(y[row], runs)
        levels.append((feature, cut, left, sums / total[:, None] + shift))
        at += len(runs)
        if level == depth or not mixed.any():
            break
        live = mixed[node]
        row, place = row[live], (np.cumsum(mixed) - 1)[node[live]]
        chosen = np.argsort(rng.random((int(mixed.sum()), x.shape[1])), axis=1)[:, :recipe.subset]
        feature[mixed], cut[mixed] = _best(x[row], place, w[row], goals[row], total[mixed], sums[mixed], chosen)
        split = feature >= 0
        left[split] = at + 2 * np.arange(int(split.sum()))
        if not split.any():
            break
        by, to = feature[mixed][place], cut[mixed][place]
        row, place, by, to = (a[by >= 0] for a in (row, place, by, to))
        place = (np.cumsum(split[mixed]) - 1)[place]
        key = (2 * place + (x[row, by] > to)) << bits | np.arange(len(row))
        key.sort()
        row, node = row[key & ((1 << bits) - 1)], key >> bits
    feature, cut, left, value = (np.concatenate(parts) for parts in zip(*levels, strict=True))
    spans = np.cumsum([0, *[len(a[0]) for a in levels]])
    said = recipe.predicted(value)
    for lo, hi in zip(spans[-2::-1], spans[:0:-1], strict=True):
        inner = lo + np.flatnonzero(feature[lo:hi] >= 0)
        a = left[inner]
        feature[inner[(feature[a] < 0) & (feature[a + 1] < 0) & (said[a] == said[a + 1])]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for lo, hi in zip(spans[:-1], spans[1:], strict=True):
        inner = lo + np.flatnonzero((feature[lo:hi] >= 0) & kept[lo:hi])
        kept[left[inner]] = kept[left[inner] + 1] = True
    left = (np.cumsum(kept) - 1)[left].astype(np.int32)
    return feature[kept], cut[kept], left[kept], value[kept]


# ---------------------------------------------------------------- the whole table


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition, about ``PART_ROWS`` at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PART_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _bins(table: pa.Table) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["x"].chunks])
    return flat.reshape(table.num_rows, -1).astype(np.uint16)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


class _Top:
    """The nodes of one tree that are divided by counts over all rows; those with feature -1 end here."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value, self.depth = [-1], [0], [0], [None], [0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for column, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, None),
                            (self.depth, self.depth[node] + 1)):
            column += [new, new]
        return at, at + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int32), np.array(self.cut, np.int32), np.array(self.left, np.int32)


def _divided(rows: DataFrame, recipe: Recipe, tops: list[_Top], open_nodes: dict[int, list[int]],
             features: int, bins: int) -> list:
    """(tree, node, feature or -1, cut, rows left and right, value) of every open node, by counts over all rows."""
    paths = [t.arrays() for t in tops]
    chosen = {(t, v): np.random.default_rng([recipe.seed, t, v, 0]).permutation(features)[:recipe.subset]
              for t, nodes in open_nodes.items() for v in nodes}
    shape = (recipe.subset, bins, 2 + recipe.width)

    def count(batches):
        for table in _read(batches):
            x, h, n = _bins(table), _numbers(table, "h"), _numbers(table, "n")
            goals = recipe.goals(_numbers(table, "label"))
            for tree, nodes in open_nodes.items():
                w, at = drawn(h, n, tree, recipe.seed), walked(x, *paths[tree])
                for node in nodes:
                    here = np.flatnonzero((at == node) & (w > 0))
                    if not len(here):
                        continue
                    counts = np.zeros(shape)
                    times = w[here].astype(float)
                    for j, f in enumerate(chosen[tree, node]):
                        b = x[here, f]
                        counts[j, :, 0] = np.bincount(b, minlength=bins)
                        counts[j, :, 1] = np.bincount(b, times, bins)
                        for k in range(recipe.width):
                            counts[j, :, 2 + k] = np.bincount(b, times * goals[here, k], bins)
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                        "counts": pa.array([counts.tobytes()], pa.binary())})

    def best(table):
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        counts = sum(np.frombuffer(b) for b in sorted(table["counts"].to_pylist())).reshape(shape)
        whole, left = counts[0].sum(0), counts.cumsum(1)[:, :-1]
        total, sums, inside = whole[1], whole[2:], left[..., 1]
        d = left[..., 2:] * total - sums * inside[..., None]
        sides = total * inside * (total - inside)
        gain = np.divide((d * d).sum(-1), sides, out=np.zeros(sides.shape), where=sides > 0)
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        found = gain[j, b] > 0
        inside_rows = int(left[j, b, 0])
        return pa.Table.from_pylist([{
            "tree": tree, "node": node, "feature": int(chosen[tree, node][j]) if found else -1, "cut": int(b),
            "n_left": inside_rows, "n_right": int(whole[0]) - inside_rows, "value": (sums / total).tolist()}],
            pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()),
                       ("n_left", pa.int64()), ("n_right", pa.int64()), ("value", pa.list_(pa.float64()))]))

    counted = rows.mapInArrow(count, "tree int, node int, counts binary")
    return counted.groupBy("tree", "node").applyInArrow(
        best, "tree int, node int, feature int, cut int, n_left long, n_right long, value array<double>").collect()


def _tree_row(tree: int, node: int, feature, cut, left, value) -> dict:
    return {"tree": tree, "node": node, "size": len(feature), "feature": feature.astype(np.int32).tobytes(),
            "cut": cut.astype(np.int32).tobytes(), "left": left.astype(np.int32).tobytes(),
            "value": value.astype(float).tobytes()}


def _placed(x: np.ndarray, path: tuple[np.ndarray, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows) of the nodes of one tree's top at which rows end."""
    at = walked(x, *path)
    order = np.argsort(at, kind="stable")
    starts = _runs(at[order])
    yield from ((int(at[part[0]]), part) for part in np.split(order, starts[1:]))


def grow_forest(training: DataFrame, recipe: Recipe, bins: int, spark: SparkSession) -> GrownForest:
    """A forest over (features as bin numbers below ``bins``, label).

    The driver holds the tops of the trees: about twice as many nodes as ``GROUP_ROWS`` goes into the rows, a tree.
    """
    counted = training.groupBy(vector_to_array("features").alias("x"), "label").agg(F.count("*").alias("c"))
    most = F.lit(DRAWN_AT_ONCE)
    apart = counted.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / most)))).select(
        "x", "label", F.least(most, F.col("c") - F.col("at") * most).cast("long").alias("n"),
        F.xxhash64("x", "label", "at").alias("h"))
    rows = durable(apart)
    n, features = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    rows = rows.repartition(max(1, math.ceil(n / PART_ROWS)), "h")

    tops = [_Top() for _ in range(recipe.trees)]
    ends: list[tuple[int, int]] = []  # leaves among the tops
    open_nodes = {t: [0] for t in range(recipe.trees)} if n > GROUP_ROWS and recipe.depth else {}
    while open_nodes:
        found = _divided(rows, recipe, tops, open_nodes, features, bins)
        open_nodes = {}
        for r in sorted(found, key=lambda r: (r.tree, r.node)):
            top = tops[r.tree]
            top.value[r.node] = np.array(r.value)
            if r.feature < 0:
                ends.append((r.tree, r.node))
                continue
            for child, size in zip(top.split(r.node, r.feature, r.cut), (r.n_left, r.n_right), strict=True):
                if size > GROUP_ROWS and top.depth[child] < recipe.depth:
                    open_nodes.setdefault(r.tree, []).append(child)
    paths, closed = [t.arrays() for t in tops], set(ends)
    depths = [t.depth for t in tops]

    def send(batches):
        for table in _read(batches):
            x, y = _bins(table), _numbers(table, "label")
            h, n = _numbers(table, "h"), _numbers(table, "n")
            small = np.uint8 if bins <= 256 else np.uint16
            kind = np.uint16 if recipe.classes else float
            for tree in range(recipe.trees):
                w = drawn(h, n, tree, recipe.seed)
                met = np.flatnonzero(w)
                if not len(met):
                    continue
                out = {"tree": [], "node": [], "x": [], "y": [], "w": []}
                for node, part in _placed(x[met], paths[tree]):
                    if (tree, node) in closed:
                        continue
                    part = met[part]
                    for name, cell in (("tree", tree), ("node", node), ("x", x[part].astype(small).tobytes()),
                                       ("y", y[part].astype(kind).tobytes()), ("w", w[part].astype(np.uint8).tobytes())):
                        out[name].append(cell)
                yield pa.RecordBatch.from_pydict(out, pa.schema([
                    ("tree", pa.int32()), ("node", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("w", pa.binary())]))

    def grow(table):
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        parts = sorted(zip(*(table[c].to_pylist() for c in "xyw"), strict=True))
        x = np.concatenate([np.frombuffer(p[0], np.uint8 if bins <= 256 else np.uint16) for p in parts])
        y = np.concatenate([np.frombuffer(p[1], np.uint16 if recipe.classes else float) for p in parts])
        w = np.concatenate([np.frombuffer(p[2], np.uint8) for p in parts])
        rng = np.random.default_rng([recipe.seed, tree, node, 1])
        made = grown(x.reshape(len(y), -1), y, w, recipe, recipe.depth - depths[tree][node], rng)
        return pa.Table.from_pylist([_tree_row(tree, node, *made)], pa.schema([
            ("tree", pa.int32()), ("node", pa.int32()), ("size", pa.int32()), *[
                (c, pa.binary()) for c in ("feature", "cut", "left", "value")]]))

    sent = rows.mapInArrow(send, "tree int, node int, x binary, y binary, w binary")
    parts = min(MOST_PARTS, sum(f < 0 for t in tops for f in t.feature))
    trees = durable(sent.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(grow, _TREE))

    # Leaves that predict the same are one, as within the groups: from the tops' last nodes to the roots.
    single = {(r.tree, r.node): np.frombuffer(r.value) for r in trees.filter("size = 1").collect()}
    single |= {(t, v): tops[t].value[v] for t, v in ends}
    for t, top in enumerate(tops):
        for v in range(len(top.feature) - 1, -1, -1):
            a, b = (single.get((t, top.left[v] + i)) for i in (0, 1))
            if top.feature[v] >= 0 and a is not None and b is not None and np.array_equal(
                    recipe.predicted(a[None]), recipe.predicted(b[None])):
                top.feature[v] = -1
                single[t, v] = top.value[v]
                ends.append((t, v))
    leaf = np.array([-1]), np.zeros(1), np.zeros(1)
    if ends:
        made = [_tree_row(t, v, *leaf, tops[t].value[v]) for t, v in ends]
        trees = trees.unionByName(spark.createDataFrame(made, _TREE))
    return GrownForest(recipe, [t.arrays() for t in tops], trees, parts)


@dataclass(frozen=True)
class GrownForest:
    """Tops of the trees, and a written table of what grows below them. Equal rows are scored once."""

    recipe: Recipe
    tops: list
    trees: DataFrame
    parts: int

    def transform(self, df: DataFrame) -> DataFrame:
        recipe, tops = self.recipe, self.tops
        binned = df.withColumn("__x", vector_to_array("features"))

        def pack(batches):
            step = max(1, SCORED_ROWS // recipe.width)
            tables = (t.slice(lo, step) for t in _read(batches) for lo in range(0, t.num_rows, step))
            for i, table in enumerate(tables):
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([TaskContext.get().partitionId() << 32 | i], pa.int64()),
                    "n": pa.array([table.num_rows], pa.int32()), "x": pa.array([_bins(table).tobytes()], pa.binary())})

        cells = binned.select(F.col("__x").alias("x")).distinct().repartition(
            df.sparkSession.sparkContext.defaultParallelism, "x")
        blocks = durable(cells.mapInArrow(pack, "block long, n int, x binary"))

        def send(batches):
            for batch in batches:
                for block in batch.to_pylist():
                    x = np.frombuffer(block["x"], np.uint16).reshape(block["n"], -1)
                    for tree, path in enumerate(tops):
                        placed = list(_placed(x, path))
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array([tree] * len(placed), pa.int32()),
                            "node": pa.array([v for v, _ in placed], pa.int32()),
                            "block": pa.array([block["block"]] * len(placed), pa.int64()),
                            "at": pa.array([part.astype(np.int32).tobytes() for _, part in placed], pa.binary()),
                            "x": pa.array([x[part].tobytes() for _, part in placed], pa.binary())})

        def score(trees, sent):
            out = {"block": [], "tree": [], "at": [], "value": []}
            for tree in trees.to_pylist()[:1]:
                path = [np.frombuffer(tree[c], np.int32) for c in ("feature", "cut", "left")]
                value = np.frombuffer(tree["value"]).reshape(len(path[0]), recipe.width)
                for r in sent.to_pylist():
                    x = np.frombuffer(r["x"], np.uint16).reshape(len(r["at"]) // 4, -1)
                    for name, cell in (("block", r["block"]), ("tree", r["tree"]), ("at", r["at"]),
                                       ("value", value[walked(x, *path)].tobytes())):
                        out[name].append(cell)
            return pa.Table.from_pydict(out, pa.schema([
                ("block", pa.int64()), ("tree", pa.int32()), ("at", pa.binary()), ("value", pa.binary())]))

        def add(scored, blocks):
            block = blocks.to_pylist()[0]
            total = np.zeros((block["n"], recipe.width))
            for r in sorted(scored.to_pylist(), key=lambda r: r["tree"]):  # a tree's rows are each in one piece
                total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["value"]).reshape(-1, recipe.width)
            x = np.frombuffer(block["x"], np.uint16).reshape(block["n"], -1).astype(float)
            share = total / recipe.trees
            if recipe.classes == 2:
                share = np.hstack([1 - share, share])
            return pa.table({"__x": _lists(x), "__shares": _lists(share)})

        sent = blocks.mapInArrow(send, "tree int, node int, block long, at binary, x binary")
        trees, sent = (d.repartition(self.parts, "tree", "node").groupBy("tree", "node") for d in (self.trees, sent))
        scored = trees.cogroup(sent).applyInArrow(score, "block long, tree int, at binary, value binary")
        shares = scored.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
            add, "__x array<double>, __shares array<double>")
        out = binned.join(durable(shares), "__x")
        if not recipe.classes:
            return out.select(*df.columns, F.get("__shares", F.lit(0)).alias("prediction"))
        most = F.array_position("__shares", F.array_max("__shares"))
        return out.select(*df.columns, array_to_vector("__shares").alias("probability"),
                          (most - 1).cast("double").alias("prediction"))
