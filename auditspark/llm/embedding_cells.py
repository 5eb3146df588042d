"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors are one node. The nodes of a label are dealt to the cells of a spherical k-means that
is fitted on a bounded sample of the label; every node has one cell of its own and is a guest of the
cells whose border it lies near. Within a cell, bounded blocks of nodes are multiplied. A block knows
its centre and its widest angle, so two blocks that lie within the limit link whole and two that lie
beyond it do not meet; only the pairs of blocks between carry their vectors. What leaves a pair of
blocks is a number of links per node and a spanning star per connected part, never all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import by_arrow, stored
from auditspark.llm.simhash_pivots import components

#: Nodes that meet a copy of their label's centres in one group.
SLICE = 4_096
#: Nodes per cell aimed at, and nodes per block at most on average.
CELL, BLOCK = 512, 1024
#: Rows of a label that the k-means sees, and cells of a label at most.
SAMPLE, MOST_CELLS = 16_384, 2_048
#: A node is a guest of each cell whose bisecting plane with the own cell is this near. A pair at
#: 0.93 lies at most sin(acos 0.93) = 0.368 from the plane that parts it: that margin is exact.
MARGIN = 0.2
#: Centres nearer than this cosine are one centre, so a dense group is one cell, not many.
MERGED = 0.8
_NODE = "node long, label string, dim int, weight long, vector binary"
_CELL = ["label", "dim", "cell"]


def unit_vectors(table: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` (as a string), ``dim``, the vector as bytes of doubles, their digest.

    The bytes are null where the vector links with nothing: no label, null, empty, zero, or a
    component that is null or not finite.
    """
    kind = dict(table.dtypes)["vec_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            labels, vectors = batch.column(1).to_pylist(), batch.column(2)
            out, dims = [], []
            for label, x in zip(labels, vectors, strict=True):
                v = None
                if label is not None and x.is_valid and x.values is not None and x.values.null_count == 0:
                    v = np.asarray(x.values, np.float64)
                    top = np.abs(v).max(initial=0.0)
                    v = v / top if 0 < top < np.inf else None  # scaled first: no overflow of squares
                dims.append(0 if v is None else len(v))
                out.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary()),
                 pa.array([v and xxh3_128_digest(v) for v in out], pa.binary())],
                ["vec_id", "label", "dim", "vector", "digest"])

    slim = table.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return by_arrow(slim, run, f"vec_id {kind}, label string, dim int, vector binary, digest binary")


def _matrix(vectors, dim: int):
    """Unit rows from bytes."""
    import numpy as np

    x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_centres(x, k: int, rounds: int = 8):
    """Spherical k-means on unit rows: at most ``k`` unit centres, none within MERGED of another."""
    import numpy as np

    def apart(c):
        kept = []
        for i in range(len(c)):
            if not kept or (c[kept] @ c[i]).max() < MERGED:
                kept.append(i)
        return c[kept]

    centres = apart(x[:4 * k])[:k]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[at:at + 512] @ centres.T, axis=1) for at in range(0, len(x), 512)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = apart(sums[size > 1e-9] / size[size > 1e-9][:, None])
    return centres


def cells_of(x, centres, margin: float):
    """The own cell of each unit row, and the cells that it is a guest of."""
    import numpy as np

    owns, guests = [], []
    for at in range(0, len(x), 512):
        near = x[at:at + 512] @ centres.T
        rows, own = np.arange(len(near)), np.argmax(near, axis=1)
        width = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0))
        guest = near[rows, own][:, None] - near <= margin * width + 1e-12
        guest[rows, own] = False
        owns += own.tolist()
        guests += [np.flatnonzero(g).astype("int32") for g in guest]
    return np.array(owns, np.int32), guests


def assign(nodes: DataFrame, cell: int, margin: float) -> DataFrame:
    """``nodes`` with ``own`` cell, ``guests`` (cell numbers) and ``rank`` (cosine with the centre).

    A label of up to two cells' worth of nodes is one cell. Others are dealt out in slices of
    bounded size, each with a copy of its label's centres.
    """
    sizes = stored(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell))
    small = nodes.join(sizes.select("label", "dim"), ["label", "dim"], "left_anti").select(
        nodes.columns).withColumns({"own": F.lit(0), "guests": F.array().cast("array<int>"), "rank": F.lit(1.0)})
    large = nodes.join(sizes, ["label", "dim"])
    seen = large.where(F.pmod(F.xxhash64("vector", F.lit(7)), F.lit(1 << 30)) * F.col("n")
                       < F.lit(SAMPLE << 30)).select("label", "dim", "n", "vector")

    def fit(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("vector", key=lambda v: v.map(hash_bytes), kind="stable")
        k = int(min(max(frame["n"].iloc[0] // cell, 1), MOST_CELLS))
        centres = fit_centres(_matrix(frame["vector"], key[1]), k)
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "centres": [np.ascontiguousarray(centres).tobytes()]})

    centres = stored(seen.groupBy("label", "dim").applyInPandas(fit, "label string, dim int, centres binary"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    dealt = centres.join(sizes, ["label", "dim"]).select(
        "label", "dim", "centres", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    rows = large.withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int")).drop("n")

    def place(key, frame, known):
        import numpy as np

        if not len(frame):
            return frame.assign(own=[], guests=[], rank=[]).drop(columns="slice")
        found = np.frombuffer(known["centres"].iloc[0], np.float64).reshape(-1, key[1])
        x = _matrix(frame["vector"], key[1])
        own, guest = cells_of(x, found, margin)
        return frame.drop(columns="slice").assign(
            own=own, guests=guest, rank=(x * found[own]).sum(axis=1))

    keys = ["label", "dim", "slice"]
    placed = rows.select(*nodes.columns, "slice").groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        place, f"{_NODE}, own int, guests array<int>, rank double")
    return small.select(*nodes.columns, "own", "guests", "rank").unionByName(placed)


def hash_bytes(value: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(value, 11)


def blocks(placed: DataFrame, block: int) -> DataFrame:
    """One row per block of a cell: nodes, weights and vectors packed, centre and widest angle.

    Own nodes and guests have blocks of their own. A cell of more than ``block`` nodes is first cut
    by the cosine with its centre, so that a dense group's blocks hold little else, then by hash.
    """
    here = placed.withColumn("own_cell", F.col("own")).select(
        "label", "dim", F.explode(F.concat(
            F.array(F.struct(F.col("own").alias("cell"), F.lit(False).alias("guest"))),
            F.transform("guests", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("guest"))))).alias("at"),
        "node", "weight", "vector", "own_cell", "guests", "rank").select("label", "dim", "at.*", "node", "weight",
                                                                         "vector", "own_cell", "guests", "rank")
    cell = ["label", "dim", "cell", "guest"]
    band = F.floor((1 - F.col("rank")) * 64).cast("int")
    bands = here.groupBy(*cell, band.alias("band")).agg(F.count("*").alias("m"))
    whole = bands.groupBy(*cell).agg(F.sum("m").alias("n"))
    cut = bands.join(whole, cell).select(*cell, "band", *[c.alias(x) for c, x in (
        (F.when(F.col("n") > block, F.col("band")).otherwise(0), "part"),
        (F.when(F.col("n") > block, F.ceil(F.col("m") / block).cast("int")).otherwise(1), "slots"))])
    keyed = here.withColumn("band", band).join(stored(cut), [*cell, "band"]).withColumn(
        "slot", F.pmod(F.xxhash64("node", F.lit(3)), F.col("slots")).cast("int"))

    def pack(key, frame):
        import numpy as np
        import pandas as pd

        x = _matrix(frame["vector"], key[1])
        centre = x.sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else x[0]
        wide = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        return pd.DataFrame({
            "label": [key[0]], "dim": [key[1]], "cell": [key[2]], "guest": [key[3]],
            "block": [f"{key[4]}.{key[5]}"], "wide": [wide], "centre": [centre.tolist()],
            "n": [len(frame)], "total": [int(frame["weight"].sum())], "least": [int(frame["node"].min())],
            "nodes": [frame["node"].tolist()], "weights": [frame["weight"].tolist()],
            "owns": [frame["own_cell"].tolist()], "guests": [[list(g) for g in frame["guests"]]],
            "vectors": [x.tobytes()]})

    return keyed.groupBy(*cell, "part", "slot").applyInPandas(
        pack, "label string, dim int, cell int, guest boolean, block string, wide double, centre array<double>, "
              "n long, total long, least long, nodes array<long>, weights array<long>, owns array<int>, "
              "guests array<array<int>>, vectors binary")


def spanning(links, left, right):
    """(u, v) edges that connect what the boolean matrix ``links`` connects between two node lists."""
    import numpy as np

    open_rows = links.any(axis=1)
    found = []
    while open_rows.any():
        rows = np.zeros(len(left), bool)
        cols = np.zeros(len(right), bool)
        fresh = np.zeros(len(left), bool)
        fresh[np.argmax(open_rows)] = True
        while fresh.any():
            rows |= fresh
            reached = links[fresh].any(axis=0) & ~cols
            cols |= reached
            fresh = links[:, reached].any(axis=1) & ~rows
        open_rows &= ~rows
        members = np.unique(np.concatenate([left[rows], right[cols]]))
        found += [(int(members[0]), int(m)) for m in members[1:]]
    return found


def linked(packed: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``links``) partial numbers of links, and (``u``, ``v``) edges that connect alike."""
    limit, slack = math.acos(cosine), 1e-6  # angles within the slack of a limit are multiplied out

    def angle(x: str, y: str):
        dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))

    # blocks that lie within half the limit of one point are a ball: all their nodes link
    about = packed.select(*_CELL, "guest", "block", "wide", "centre", "total", "least")
    points = about.where("NOT guest").groupBy(*_CELL).agg(
        F.min_by("centre", F.struct("wide", "block")).alias("point"))
    about = stored(about.join(points, _CELL).withColumn("ball", ~F.col("guest") & (
        angle("centre", "point") + F.col("wide") <= limit / 2 - slack)).drop("point"))
    a, b = about.alias("a"), about.alias("b")
    same = (F.col("a.block") == F.col("b.block")) & ~F.col("b.guest")
    between = angle("a.centre", "b.centre")
    pairs = stored(a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
                          & (F.col("a.cell") == F.col("b.cell")) & ~F.col("a.guest")
                          & (F.col("b.guest") | (F.col("a.block") <= F.col("b.block")))
                          & ~(F.col("a.ball") & F.col("b.ball"))
                          & (same | (between - F.col("a.wide") - F.col("b.wide") <= limit + slack))).select(
        *[F.col(f"a.{c}").alias(c) for c in _CELL], F.col("a.block").alias("left"),
        F.col("b.block").alias("right"), F.col("b.guest").alias("guest"), same.alias("same"),
        F.col("a.total").alias("x"), F.col("b.total").alias("y"), F.col("a.least").alias("u"),
        F.col("b.least").alias("v"),
        (~same & ~F.col("b.guest") & (between + F.col("a.wide") + F.col("b.wide") <= limit - slack)
         ).alias("near")))
    whole = pairs.where("near")
    balls = about.where("ball").groupBy(*_CELL).agg(F.sum("total").alias("gain"), F.min("least").alias("hub"))
    # each node gains the weight of every block that its own block links whole with
    gain = about.where("ball").join(balls, _CELL).select(*_CELL, "block", "gain", "hub").unionByName(
        whole.select(*_CELL, F.col("left").alias("block"), F.col("y").alias("gain"), F.lit(None).alias("hub"))
    ).unionByName(whole.select(*_CELL, F.col("right").alias("block"), F.col("x").alias("gain"),
                               F.lit(None).alias("hub"))).groupBy(*_CELL, "block").agg(
        F.sum("gain").alias("gain"), F.min("hub").alias("hub"))
    own_blocks = packed.where("NOT guest")
    dense = own_blocks.select(*_CELL, "block", "least", F.explode(F.arrays_zip("nodes", "weights")).alias("m")).join(
        gain, [*_CELL, "block"])
    dense_links = dense.select(F.col("m.nodes").alias("node"), (F.col("gain") - F.when(
        F.col("hub").isNotNull(), F.col("m.weights")).otherwise(0)).alias("links"))
    # where blocks link whole, all nodes of either hang on the least node of the other
    dense_edges = dense.where("hub IS NOT NULL").select(F.col("hub").alias("u"), F.col("m.nodes").alias("v")
        ).unionByName(dense.select(F.col("least").alias("u"), F.col("m.nodes").alias("v"))).unionByName(
        whole.select("u", "v"))
    cell, unsure = _CELL, pairs.where("NOT near")
    fields = ["nodes", "weights", "owns", "guests", "vectors"]
    sent = unsure.join(own_blocks.select(*cell, F.col("block").alias("left"), F.struct(*fields).alias("a")),
                       [*cell, "left"]).join(
        packed.select(*cell, "guest", F.col("block").alias("right"), F.struct(*fields[:3], "vectors").alias("b")),
        [*cell, "guest", "right"]).select(
        *cell, "guest", "left", "right", "same", "a", "b")

    def multiply(table):
        import numpy as np
        import pyarrow as pa

        dim, cell_, same_, guest, p, q = (table.column(c)[0].as_py() for c in (
            "dim", "cell", "same", "guest", "a", "b"))
        x, y = (np.frombuffer(s["vectors"], np.float64).reshape(-1, dim) for s in (p, q))
        left, right = np.array(p["nodes"]), np.array(q["nodes"])
        hit = x @ y.T >= cosine
        if same_:
            np.fill_diagonal(hit, False)
        if guest:  # a pair that both cells see counts in the lower cell only
            owns = np.array(q["owns"])
            for other in np.unique(owns[owns < cell_]):
                seen = np.array([other in g for g in p["guests"]])
                hit[np.ix_(seen, owns == other)] = False
        counts = [(left, hit @ np.array(q["weights"]))]
        if not same_:
            counts.append((right, np.array(p["weights"]) @ hit))
        edges = np.array(spanning(hit, left, right), np.int64).reshape(-1, 2)
        node = np.concatenate([n[c > 0] for n, c in counts])
        links = np.concatenate([c[c > 0] for _, c in counts])
        return pa.table({
            "node": pa.array(np.concatenate([node, edges[:, 0]]), pa.int64()),
            "links": pa.array(np.concatenate([links, np.zeros(len(edges), np.int64)]), pa.int64()),
            "v": pa.array([None] * len(node) + edges[:, 1].tolist(), pa.int64())})

    # a group is one pair of blocks
    found = stored(sent.groupBy("label", "dim", "cell", "guest", "left", "right").applyInArrow(
        multiply, "node long, links long, v long"))
    return (found.where("v IS NULL").select("node", "links").unionByName(dense_links),
            found.where("v IS NOT NULL").select(F.col("node").alias("u"), "v").unionByName(dense_edges))


def near_vectors(table: DataFrame, cosine: float = 0.93, cell: int = CELL, block: int = BLOCK,
                 margin: float = MARGIN) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``table`` (``vec_id``,
    ``embedding``, ``label``).

    Vectors of one label link at a cosine of ``cosine`` or more, in doubles. Equal vectors (after
    division by the largest component) are one node that weighs its number of rows and
    link with each other. A row whose label is null or whose vector is null, empty, zero or holds a
    null or non-finite component links with nothing: ``n_links`` 0, a component of its own. Vectors
    of different lengths do not link. A null ``vec_id`` takes part; its component is the smallest
    id it reaches, null if there is none, and ``kept`` is null. Rows that repeat an id are vectors
    of their own. An empty table gives an empty table; other columns are not looked at.

    No pair at ``cosine`` is lost in a label of up to two cells, nor at all where ``margin`` is at
    least sin(acos(cosine)); below that a pair is lost only if both of its vectors lie further than
    ``margin`` beyond the plane that parts their cells.
    """
    marked = stored(unit_vectors(table))
    live = marked.where("vector IS NOT NULL")
    nodes = stored(live.groupBy("label", "dim", "digest").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector")).withColumn(
        "node", F.monotonically_increasing_id()))
    slim = nodes.select("node", "label", "dim", "weight", "vector")
    packed = stored(blocks(stored(assign(slim, cell, margin)), block))
    counts, edges = linked(packed, cosine)
    joined = components(edges.where("u <> v").distinct())
    joined = stored(joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()))
    ids = joined.join(nodes.select("node", "first_id"), "node")
    least = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = joined.join(least, "component").select("node", "component_id", F.lit(0).cast("long").alias("links"))
    per_node = placed.unionByName(counts.select(
        "node", F.lit(None).cast(dict(placed.dtypes)["component_id"]).alias("component_id"), "links")).groupBy(
        "node").agg(F.max("component_id").alias("component_id"), F.sum("links").alias("links"))
    known = nodes.join(per_node, "node", "left").select(
        "label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "first_id").alias("component_id"))
    return marked.join(known, ["label", "dim", "digest"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
