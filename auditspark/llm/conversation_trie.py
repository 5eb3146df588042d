"""A prefix trie of conversations from vertical bitmaps, one shard of conversations at a time.

A shard is a run of conversations in order of their ids. It indexes (position, turn) to the bitset of
the conversations that have that turn there. Depth first, the bitset of a node is intersected with
the postings of the next position: each result that is not empty is a child, its number of bits the
shard's members, the bits of conversations that end there the shard's end list. Nodes of different
shards are the same if their prefixes have the same key, 128 bits over all (position, turn) of the
prefix; sums over shards make the trie. What counts a node once (leaves, bytes of distinct turns) is
counted in the shard of its smallest member, which holds all its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import by_arrow, stored, streamed_sha256

#: A shard ends at so many conversations, or turns once it has one conversation.
CONVERSATIONS, TURNS = 2_048, 65_536
#: Conversations share their first turns with the one whose id is the last multiple of this.
FAMILY, MOST_SHARED = 5, 8


def _key(*parts: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (1, 2, ..), ``role``, ``text`` in order of ``turn``, null first.

    Turns of one number are ordered by role, then text; repeated rows are turns of their own. A null
    role or text is empty. Rows without a ``conv_id`` belong to no conversation.
    """
    filled = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return filled.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The sequences with the first turns of each conversation taken from its family's head.

    Conversation c starts with the first h turns of conversation c - c % 5 (% as in SQL, with the
    sign of c), h the CRC-32 of c in decimal modulo 9, and goes on with its own turns after its first
    h. A row with ``pos`` 0 stands for each conversation, also one that is left without turns.
    """
    own = stored(sequences(turns).select("conv_id", "pos", F.octet_length("text").alias("bytes"), *[
        _key("role", "text", F.length("role"), seed=s).alias(f"k{s}") for s in (1, 2)]))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    head = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head")
    ids = own.where("pos = 1").select("conv_id", shared.alias("h"), head)
    lent = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= MOST_SHARED)).groupBy(
        F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(
            F.struct("pos", "bytes", "k1", "k2"))).alias("lent"))
    known = ids.join(lent, "head", "left").select(
        "conv_id", "h", F.slice(F.coalesce("lent", F.array()), 1, F.col("h")).alias("lent"))
    first = known.select("conv_id", F.explode(F.concat(F.array(F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("bytes"), F.lit(0).cast("long").alias("k1"),
        F.lit(0).cast("long").alias("k2"))), "lent")).alias("t")).select("conv_id", "t.*")
    rest = own.join(known.select("conv_id", "h", F.size("lent").alias("n")), "conv_id").where(
        F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "bytes", "k1", "k2")
    return first.unionByName(rest)


def plain(turns: DataFrame) -> DataFrame:
    """The sequences as they are, with a ``pos`` 0 row for each conversation."""
    own = sequences(turns).select("conv_id", "pos", F.octet_length("text").alias("bytes"), *[
        _key("role", "text", F.length("role"), seed=s).alias(f"k{s}") for s in (1, 2)])
    return own.unionByName(own.where("pos = 1").select(
        "conv_id", F.lit(0).alias("pos"), F.lit(0).alias("bytes"), *[
            F.lit(0).cast("long").alias(c) for c in ("k1", "k2")]))


def grow(conversations: list[tuple[int, list[tuple], list[int]]]):
    """The trie of one shard. ``conversations``: (id, keys of the turns, their bytes), ids ascending.

    Yields in preorder (parent's row, depth, key, members, smallest id, bytes of the last turn, ids
    that end there). The key of a node is the exclusive or of its (position, turn) keys.
    """
    postings: dict[tuple, int] = {}
    for bit, (_, keys, _) in enumerate(conversations):
        for at, turn in enumerate(keys):
            postings[at, turn] = postings.get((at, turn), 0) | 1 << bit
    ends: dict[int, int] = {}
    for bit, (_, keys, _) in enumerate(conversations):
        ends[len(keys)] = ends.get(len(keys), 0) | 1 << bit

    def ids(bits):
        found = []
        while bits:
            low = bits & -bits
            found.append(conversations[low.bit_length() - 1][0])
            bits ^= low
        return found

    stack = [(-1, 0, (0, 0), (1 << len(conversations)) - 1, 0)]
    row = 0
    while stack:
        parent, depth, key, members, size = stack.pop()
        here = members & ends.get(depth, 0)
        least = conversations[(members & -members).bit_length() - 1][0]
        yield parent, depth, key, members.bit_count(), least, size, ids(here)
        rest = members ^ here
        while rest:
            some = conversations[(rest & -rest).bit_length() - 1]
            turn = some[1][depth]
            child = rest & postings[depth, turn]
            rest ^= child
            stack.append((row, depth + 1, (key[0] ^ turn[0], key[1] ^ turn[1]), child, some[2][depth]))
        row += 1


def shards(placed: DataFrame) -> DataFrame:
    """The nodes of every shard: ``shard`` (its smallest id), ``row``, ``up`` (parent's row),
    ``depth``, ``key`` (two longs), ``n``, ``least``, ``bytes``, ``ends``.

    Rows stream in order of conversation; a shard's index is all that a task holds, with 24 bytes a
    turn for a conversation longer than a shard's turns.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(block):
            shard, rows = block[0][0], list(grow(block))
            for at in range(0, len(rows), 10_000):
                up, depth, key, n, least, size, ends = zip(*rows[at:at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(up), pa.int64()), pa.array(range(at, at + len(up)), pa.int32()),
                    pa.array(up, pa.int32()), pa.array(depth, pa.int32()),
                    *[pa.array([k[i] for k in key], pa.int64()) for i in (0, 1)], pa.array(n, pa.int64()),
                    pa.array(least, pa.int64()), pa.array(size, pa.int64()),
                    pa.array(ends, pa.list_(pa.int64()))],
                    ["shard", "row", "up", "depth", "k1", "k2", "n", "least", "bytes", "ends"])

        block, turns = [], 0
        for batch in batches:
            conv, pos, size, k1, k2 = (c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)
            for c, p, b, x, y in zip(conv, pos, size, k1, k2, strict=True):
                if p == 0:
                    if len(block) >= CONVERSATIONS or turns >= TURNS:
                        yield from out(block)
                        block, turns = [], 0
                    block.append((c, [], []))
                else:
                    turns += 1
                    block[-1][1].append((x, y))
                    block[-1][2].append(b)
        if block:
            yield from out(block)

    # a turn's key within a prefix holds its position, so that order counts
    keyed = placed.select("conv_id", "pos", "bytes", *[
        _key("pos", "k1", "k2", seed=s).alias(f"p{s}") for s in (3, 4)])
    ordered = keyed.repartitionByRange(F.col("conv_id")).sortWithinPartitions("conv_id", "pos")
    return by_arrow(ordered, run, "shard long, row int, up int, depth int, k1 long, k2 long, n long, "
                                  "least long, bytes long, ends array<long>")


def _sums(parts: DataFrame) -> DataFrame:
    """Per shard and node: what the shard adds to the node's children, leaves and saved bytes.

    Rows of a shard are numbered in preorder, so a subtree is a run of rows and a sum over it a
    difference of two prefix sums.
    """

    def run(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("row")
        up, owned = frame["up"].to_numpy(), frame["owned"].to_numpy()
        end = np.arange(1, len(frame) + 1)
        for row in range(len(frame) - 1, 0, -1):
            if end[up[row]] < end[row]:
                end[up[row]] = end[row]

        def below(values):
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[:-1]

        size = frame["bytes"].to_numpy()
        kids = np.bincount(up[1:], weights=owned[1:], minlength=len(frame)).astype(np.int64)
        first = frame["first"].to_numpy()
        return pd.DataFrame({
            "k1": frame["k1"], "k2": frame["k2"], "depth": frame["depth"], "n": frame["total"],
            "conv_id": first, "kids": kids, "leaves": below((owned & frame["leaf"].to_numpy()).astype(np.int64)),
            "saved": below(frame["n"].to_numpy() * size - owned * size),
            "parent": pd.array([None, *first[up[1:]].tolist()], dtype="Int64")})

    return parts.groupBy("shard").applyInPandas(
        run, "k1 long, k2 long, depth int, n long, conv_id long, kids long, leaves long, saved long, parent long")


def trie(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the end lists of the trie over ``placed`` (:func:`plain` or :func:`rebuilt`).

    Nodes: ``k1``, ``k2`` (the node's key), ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (smallest member of the parent, null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (over the
    subtree, bytes of the last text times the members beyond the first). The text of a node is turn
    ``depth`` of conversation ``conv_id``. End lists: ``k1``, ``k2``, ``shard``, ``ends`` (ids
    ascending), one row per shard that has ends of the node; shards do not overlap.

    No conversation, no node. Two prefixes are one node if 128 bits of hash agree.
    """
    parts = stored(shards(stored(placed)))
    node = ["k1", "k2"]
    whole = parts.groupBy(*node).agg(
        F.sum("n").alias("total"), F.sum(F.size("ends")).alias("ended"), F.min("least").alias("first"),
        F.min("shard").alias("owner"))
    local = parts.drop("ends").join(whole, node).withColumns({
        "owned": F.col("shard") == F.col("owner"), "leaf": F.col("total") == F.col("ended")})
    nodes = _sums(local).groupBy(*node).agg(
        F.first("conv_id").alias("conv_id"), F.first("depth").cast("long").alias("depth"),
        F.max("parent").alias("parent_conv_id"), F.first("n").alias("n_convs"),
        F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"))
    return nodes, parts.where(F.size("ends") > 0).select(*node, "shard", "ends")


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends_sha256``: SHA-256 of each node's ids, decimal, comma-joined.

    The lists of a node stream through one hash in order of shard; none is put together.
    """

    listed = ends.select("k1", "k2", "shard", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    return streamed_sha256(listed, ["k1", "k2"], ["shard"], "ids", ",").withColumnRenamed("sha256", "ends_sha256")
