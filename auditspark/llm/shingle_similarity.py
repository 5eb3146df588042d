"""Near copies by SimHash and by rare shingles, decided by the Jaccard similarity of exact sets.

SimHash goes first: texts whose fingerprints differ in a few bits are candidates, found by the pivot
keys of :mod:`simhash_pivots`, and those whose sets are alike hang together from the start. A pair at
0.8 may differ in more bits than pivot keys reach, so what the fingerprints leave apart is completed:
shingles are ordered from rare to common, and two sets at similarity t or more share a shingle among the
first few of each: the first (1 - t) n + 1 of the larger, the first (1 - 2 t / (1 + t)) n + 1 of the
smaller. Texts meet on those rare shingles only, so a template that many texts share brings none of
them together. Two things keep the work small and lose nothing: a text whose smallest hashes are
mostly its own has no near copy and is left out at once, and texts that meet are first compared with
few of them, round after round, so that what hangs together is not compared pair by pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import as_bytes, by_arrow, stored
from auditspark.llm.simhash_pivots import components, majority, near_links, shingle_hashes

#: Rounds in which those that meet on a shingle are compared with so many of them only.
ROUNDS, CENTRES = 2, 4
#: Bits in which the fingerprints of candidates differ at most.
RADIUS = 4
#: Smallest hashes of a text by which it is judged to have no near copy.
SAMPLE = 64


def shingles(text: bytes | None, width: int = 5):
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle."""
    import numpy as np

    return np.unique(shingle_hashes(text, width))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``digest`` of the set, its size ``n``, its smallest hashes and ``fp``, the SimHash
    of its members as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                found = shingles(text, width)
                rows.append((xxh3_128_hexdigest(found.tobytes()), len(found),
                             found[:SAMPLE].view("int64").tolist(), majority(found)))
            digest, n, sample, fp = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.string()), pa.array(n, pa.int64()),
                 pa.array(sample, pa.list_(pa.int64())), pa.array(np.array(fp, np.uint64).view(np.int64))],
                ["doc_id", "digest", "n", "sample", "fp"])

    return by_arrow(docs.select("doc_id", "text"), run,
                    f"doc_id {kind}, digest string, n long, sample array<long>, fp long")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(``node``, ``hashes``, ``marks``) of every row: marks are 256 bits, each the parity of the
    number of hashes that fall on it, as four longs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t, width) for t in as_bytes(batch.column(1))]
            odd = [np.packbits((np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(
                np.uint8)).view(np.int64) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                 pa.array(odd, pa.list_(pa.int64()))], ["node", "hashes", "marks"])

    return by_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "node long, hashes array<long>, marks array<long>")


def suspects(distinct: DataFrame, part: int, whole: int) -> DataFrame:
    """The nodes that can have a near copy at all, by their smallest hashes.

    A near copy shares ``part / whole`` of a set, so that much of its smallest hashes, in the mean,
    belong to two sets at least. A set of up to SAMPLE shingles is judged exactly; a larger one is
    left out if the number is 8.5 standard deviations below, a chance of less than 1e-13.
    """
    t = part / whole
    few = math.floor(SAMPLE * t - 8.5 * math.sqrt(SAMPLE * t * (1 - t)))
    needed = F.when(F.col("n") <= SAMPLE, F.ceil(F.col("n") * part / whole)).otherwise(F.lit(max(few, 1)))
    rows = distinct.select("node", "n", F.explode("sample").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("__n")).where("__n > 1").select("h")
    return rows.join(common, "h", "left_semi").groupBy("node", "n").agg(F.count("*").alias("__n")).where(
        F.col("__n") >= needed).select("node", "n")


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """(``u``, ``v``): candidates among ``marked`` (``node``, ``fp``), each node with at most CENTRES.

    Nodes of one fingerprint meet the smallest of them; the smallest ones meet those within RADIUS
    bits, by pivot keys. CENTRES bounds what is compared only: the rare shingles find the others.
    """
    least = stored(marked.groupBy("fp").agg(F.min("node").alias("node")))
    same = marked.join(least.withColumnRenamed("node", "u"), "fp").where("u < node").select(
        "u", F.col("node").alias("v"))
    near = near_links(least, RADIUS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    few = Window.partitionBy("v").orderBy("u")
    return same.unionByName(near.withColumn("__at", F.row_number().over(few)).where(
        F.col("__at") <= CENTRES).drop("__at"))


def alike(pairs: DataFrame, known: DataFrame, part: int, whole: int) -> DataFrame:
    """The ``pairs`` (``u``, ``v``) whose sets have the similarity ``part / whole`` or more."""
    x, y = (known.select(F.col("node").alias(n), F.col("hashes").alias(f"__{n}")) for n in "uv")
    both = F.size(F.array_intersect("__u", "__v")).cast("long")
    total = (F.size("__u") + F.size("__v")).cast("long")
    return pairs.join(x, "u").join(y, "v").where(both * (part + whole) >= total * part).select("u", "v")


def meetings(known: DataFrame, part: int, whole: int) -> DataFrame:
    """Rows (``h``, ``node``, ``n``, ``marks``, ``at``, ``index``): the shingles on which a node meets others.

    Of a node's shingles, rare before common, these are the first ones that a partner at
    ``part / whole`` or more must share one of; ``at`` is the place among all ``n``. The larger of
    two sets is found by any of them, the smaller only by those before place ``index``. Shingles
    that no other node has bring nobody together but count as the rarest.
    """
    rows = known.select("node", F.size("hashes").cast("long").alias("n"), "marks", F.explode("hashes").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(common, "h").groupBy("node").agg(
        F.first("n").alias("n"), F.first("marks").alias("marks"),
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    n, own = F.col("n"), F.col("n") - F.size("order")
    probe = n - F.ceil(n * part / whole) + 1
    index = n - F.ceil(n * 2 * part / (part + whole)) + 1
    return ordered.select("node", "n", "marks", own.alias("own"), index.alias("index"), F.posexplode(
        F.slice("order", F.lit(1), F.greatest(probe - own, F.lit(0)).cast("int")))).select(
        "col.h", "node", "n", "marks", (F.col("own") + F.col("pos")).alias("at"), "index")


def _possible(a: str, b: str, part: int, whole: int) -> Column:
    """Whether sizes, places and marks of two rows of one shingle allow ``part / whole``.

    Marks differ in no more bits than the sets differ in shingles.
    """
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    larger = (x > y) | ((x == y) & (F.col(f"{a}.node") > F.col(f"{b}.node")))
    indexed = F.when(larger, F.col(f"{b}.at") < F.col(f"{b}.index")).otherwise(
        F.col(f"{a}.at") < F.col(f"{a}.index"))
    left = F.least(x - F.col(f"{a}.at"), y - F.col(f"{b}.at"))  # what both can still share from here on
    apart = sum((F.bit_count(F.get(f"{a}.marks", i).bitwiseXOR(F.get(f"{b}.marks", i))) for i in range(4)), F.lit(0))
    return (indexed & (apart * (part + whole) <= (x + y) * (whole - part)) & (F.least(x, y) * whole >= F.greatest(x, y) * part)
            & (left * (part + whole) >= (x + y) * part))


def _open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``part`` of their node, those on shingles where several parts meet, and
    ``top``, the part that holds most of the shingle's nodes."""
    placed = rows.join(components(links), "node", "left").withColumn(
        "part", F.coalesce("component", "node")).drop("component", "top")
    counts = placed.groupBy("h", "part").agg(F.count("*").alias("m")).groupBy("h").agg(
        F.count("*").alias("parts"), F.max(F.struct("m", "part")).alias("top")).where("parts > 1")
    return placed.join(counts.select("h", F.col("top.part").alias("top")), "h")


def star_pairs(rows: DataFrame, turn: int, part: int, whole: int) -> DataFrame:
    """(``u``, ``v``): each node outside a shingle's largest part with CENTRES nodes of it, by hashes
    of shingle and ``turn``. A node that is like some of a group meets many of it in each turn."""
    fields = ["node", "n", "marks", "at", "index"]
    b = rows.where("part = top").groupBy("h").agg(F.array_distinct(F.transform(F.array(*[
        F.min(F.struct(F.xxhash64("node", "h", F.lit(turn * CENTRES + i)).alias("by"), *fields))
        for i in range(CENTRES)]), lambda c: F.struct(*[c[f].alias(f) for f in fields]))).alias("b")).select(
        "h", F.explode("b").alias("b"))
    return rows.where("part <> top").select("h", F.struct(*fields).alias("a")).join(b, "h").where(
        _possible("a", "b", part, whole)).select(
        F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def open_pairs(rows: DataFrame, part: int, whole: int) -> DataFrame:
    """(``u``, ``v``) of different parts, all that may be alike: those outside a shingle's largest
    part meet all of its nodes, those inside meet no others of it."""
    a, b = rows.where("part <> top").alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.part") != F.col("b.part"))
                  & ((F.col("b.part") == F.col("b.top")) | (F.col("a.node") < F.col("b.node")))
                  & _possible("a", "b", part, whole)).select(
        F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def near_copies(docs: DataFrame, width: int = 5, part: int = 4, whole: int = 5) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    The component is the smallest id reachable over pairs whose ``width``-word shingles have a
    Jaccard similarity of ``part / whole`` or more: first over those that SimHash brings together,
    then over all others, for which only shingles on which several parts meet are left. Equal sets are one node, so copies never pair
    up. Blank texts have equal, empty sets. A row with a null id takes the smallest id of its set,
    null if there is none. Rows that repeat an id with different texts are different nodes of one
    id: the least of what either reaches. Ties do not arise, very long texts count whole, an empty
    table gives an empty table, and other columns are not looked at.
    """
    marked = stored(sketches(docs, width))
    distinct = stored(marked.where("doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").cast("long").alias("node"),
        *[F.first(c).alias(c) for c in ("n", "sample", "fp")]))
    likely = stored(suspects(distinct, part, whole))
    known = stored(sets(docs.join(likely.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), width))
    rows = stored(meetings(known, part, whole))
    candidates = stored(simhash_pairs(distinct.join(likely.select("node"), "node").select("node", "fp")))
    links = stored(alike(candidates, known, part, whole))
    for turn in range(ROUNDS):
        rows = stored(_open(rows, links))
        links = stored(links.unionByName(alike(stored(star_pairs(rows, turn, part, whole)), known, part, whole)))
    rest = stored(open_pairs(stored(_open(rows, links)), part, whole))
    links = links.unionByName(alike(rest, known, part, whole))
    classes = distinct.select("digest", "node").join(components(links), "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id"))
    return marked.select("doc_id", "digest").join(classes, "digest", "left").select(
        "doc_id", "component_id")
