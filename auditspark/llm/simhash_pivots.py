"""SimHash near-duplicates found through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to a set of reference fingerprints (pivots),
kept per group of bits. By the triangle inequality two fingerprints within ``radius`` bits differ by
at most ``radius`` in every full-width distance. Within groups the same holds more sharply: among
``groups`` groups at least ``groups - radius`` hold no differing bit, and there all distances are
equal. So two fingerprints can only link if, for some choice of that many groups, their rows of
distances agree; that is an equality, which Spark joins on. Pairs that meet are discarded by the
largest difference of full-width distances and the rest verified bit by bit.
"""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import as_bytes, by_arrow, stored

N_PIVOTS = 16
#: Reference fingerprints, spread at random over the cube.
PIVOTS = [random.Random(1000 + i).getrandbits(64) for i in range(N_PIVOTS)]
#: Fingerprints sharing a key beyond this many are linked in blocks of this many.
BLOCK = 2_000


def shingle_hashes(text: bytes | None, width: int = 4):
    """Hashes of the ``width``-word shingles in text order, repeats included; a shorter text is one
    shingle, a blank one has none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= width:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(
        starts, ends[width - 1:].tolist(), strict=False)), np.uint64, len(found) - width + 1)


def majority(hashes) -> int:
    """The bits set in over half of ``hashes``, as an unsigned integer; zero without hashes."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def shingle_bits(text: bytes | None, width: int = 4) -> int:
    """SimHash of one text over ``width``-word shingles, as an unsigned integer."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = np.array([shingle_bits(t, width) for t in as_bytes(batch.column(1))],
                              np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return by_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def groups_for(n: int, radius: int) -> int:
    """Groups of bits so that a key has more bits than it takes to tell ``n`` fingerprints apart."""
    for groups in range(radius + 2, 64):
        if 64 * (groups - radius) // groups >= n.bit_length():
            return groups
    return 64


def pivot_keys(distinct: DataFrame, radius: int, groups: int) -> DataFrame:
    """Rows (``key``, ``node``, ``fp``): each choice of groups gives a fingerprint one key, made of
    its distances to all pivots within the chosen groups and of the choice."""
    edges = [round(i * 64 / groups) for i in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    choices = list(itertools.combinations(range(groups), groups - radius))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            node, signed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = np.ascontiguousarray(signed).view(np.uint64)
            rows = []
            for mask in masks:
                row = np.zeros(len(fp), np.uint64)
                for pivot in PIVOTS:
                    d = np.bitwise_count((fp ^ np.uint64(pivot)) & np.uint64(mask))
                    # a group's distances as one number; unequal rows that meet are verified away
                    row = (row ^ d) * np.uint64(0x9E3779B97F4A7C15)
                    row ^= row >> np.uint64(29)
                rows.append(row)
            for c, chosen in enumerate(choices):
                key = np.full(len(fp), c, np.uint64)
                for g in chosen:
                    key = (key ^ rows[g]) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(node), pa.array(signed)],
                    ["key", "node", "fp"])

    return by_arrow(distinct.select("node", "fp"), run, "key long, node long, fp long")


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _with_distances(rows: DataFrame) -> DataFrame:
    """``rows`` with the full-width distances ``d0``.. of ``fp`` to the pivots."""
    return rows.select("*", *[
        F.bit_count(F.col("fp").bitwiseXOR(_signed(p))).alias(f"d{i}") for i, p in enumerate(PIVOTS)])


def _far(a: str, b: str) -> Column:
    """The largest difference of two rows' full-width pivot distances."""
    return F.greatest(*[F.abs(F.col(f"{a}.d{i}") - F.col(f"{b}.d{i}")) for i in range(N_PIVOTS)])


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp")))


def _spanning(node, fp, ball, radius: int) -> list[tuple[int, int]]:
    """Links that connect what links of at most ``radius`` bits connect, without listing all pairs.

    Rows marked ``ball`` already hang together, so each row outside needs one link to them at most.
    Rows outside are walked breadth first: each one reached looks only at those not reached yet.
    """
    import numpy as np

    links: list[tuple[int, int]] = []
    inner, outer = np.flatnonzero(ball), np.flatnonzero(~ball)
    if len(inner):
        for at in outer:
            near = np.flatnonzero(np.bitwise_count(fp[inner] ^ fp[at]) <= radius)
            if len(near):
                links.append((int(node[at]), int(node[inner[near[0]]])))
        return links
    left = outer
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= radius
            if near.any():
                reached = left[near]
                links += [(int(node[at]), int(x)) for x in node[reached]]
                queue += reached.tolist()
                left = left[~near]
    return links


def near_links(distinct: DataFrame, radius: int = 4, groups: int | None = None,
               block: int = BLOCK, finer: int = 2) -> DataFrame:
    """Links (``u``, ``v``) that connect the distinct fingerprints (``node``, ``fp``) as all links would.

    A key that few fingerprints share is joined with itself. Fingerprints that meet many others
    under some key get new keys of more, smaller groups, ``finer`` times over; what still crowds
    together then is a dense group and linked by :func:`_dense_links`.
    """
    if groups is None:
        groups = groups_for(distinct.count(), radius)
    few = block // 4
    keyed = stored(pivot_keys(distinct, radius, groups))
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1"))
    shared = stored(keyed.join(sizes, "key"))
    cold = _with_distances(shared.where(F.col("__n") <= few).select("key", "node", "fp"))
    a, b = cold.alias("a"), cold.alias("b")
    links = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
                   & (_far("a", "b") <= radius) & (_bits("a", "b") <= radius)).select(
        F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    hot = shared.where(F.col("__n") > few)
    if hot.limit(1).count():
        rest = (near_links(stored(hot.select("node", "fp").distinct()), radius, groups + 2, block,
                           finer - 1) if finer else _dense_links(hot, radius, block))
        links = links.unionByName(rest)
    return links.distinct()


def _dense_links(hot: DataFrame, radius: int, block: int) -> DataFrame:
    """Links within keys that many fingerprints share.

    Members within ``radius`` of one of them, the centre, all link to it and so need no links among
    themselves. Only what lies outside that ball is compared with the rest, in blocks of bounded
    size, each pair of blocks a group of its own.
    """
    centres = hot.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("__centre"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("__centre.fp")))
    placed = stored(hot.join(centres, "key").withColumn("__apart", apart).where(
        F.col("node") != F.col("__centre.node")))
    ball = F.col("__apart") <= radius
    stars = placed.where(ball).select(F.col("__centre.node").alias("u"), F.col("node").alias("v"))
    outside = placed.where(~ball).groupBy("key").agg(F.count("*").alias("__outside"))
    rows = placed.join(outside, "key")
    blocks, out_blocks = (F.ceil(F.col(n) / block).cast("int") for n in ("__n", "__outside"))
    own, out = (F.pmod(F.xxhash64("fp"), n).cast("int") for n in (blocks, out_blocks))

    def slots(kind: int, count: Column, slot) -> Column:
        return F.transform(F.sequence(F.lit(0), count - 1), lambda x: F.struct(
            F.lit(kind).alias("kind"), *[c.alias(n) for n, c in zip("ij", slot(x), strict=True)]))

    # ball rows meet every block of outside rows; outside rows every block of either kind
    met = F.when(ball, slots(0, out_blocks, lambda x: (own, x))).otherwise(F.concat(
        slots(0, blocks, lambda x: (x, out)),
        slots(1, out_blocks, lambda x: (F.least(x, out), F.greatest(x, out)))))
    dealt = rows.select("key", "node", "fp", ball.alias("ball"), F.explode(met).alias("slot")).select(
        "key", "slot.*", "node", "fp", "ball")

    def within(frame):
        import numpy as np
        import pandas as pd

        fp = frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
        found = _spanning(frame["node"].to_numpy(), fp, frame["ball"].to_numpy().astype(bool), radius)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    blocked = dealt.groupBy("key", "kind", "i", "j").applyInPandas(within, "u long, v long")
    return stars.unionByName(blocked)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(``node``, ``component``): the smallest node each linked node can reach.

    Alternates large-star and small-star steps, which keep connectivity and end when every node
    hangs on the smallest of its component. Each step's table is written, so no step repeats an
    earlier one.
    """
    edges = stored(links)
    shape = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(
            edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == shape:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        shape = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    The component is the smallest id reachable over links of at most ``radius`` bits, the own one
    included. Null and blank texts share the fingerprint zero and link like any other. A row with a
    null id takes part: its component is the smallest non-null id its fingerprint reaches, null if
    there is none. Repeated rows stay. An empty table gives an empty table.
    """
    marked = stored(fingerprints(docs, width))
    # equal fingerprints are one node, named by their smallest id: copies never pair up
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")).where(
        F.col("node").isNotNull()))
    joined = components(near_links(distinct, radius))
    classes = distinct.join(joined, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
