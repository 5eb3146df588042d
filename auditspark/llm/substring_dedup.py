"""Exact removal of long repeated word spans through a sparse de Bruijn graph of token k-mers.

Nodes are the k-mers that their own words select (closed syncmers: every window of ``window`` words
holds one, whatever surrounds it); an edge is the words from one node to the next of a document.
Only nodes in two documents or more matter. Where a node has one edge into it, or one out of it,
over the whole corpus, the words on that side are the same wherever the node occurs: joining the
nodes' degrees back to the documents compacts such runs into nonbranching paths. A window inside a
path occurs exactly where the path's nodes do, so their smallest document decides it from source
coordinates alone. Only windows that cross a branch are verified by their own words, as 128-bit
hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import as_bytes, by_arrow, stored

#: Words of a sub-word of a k-mer; a k-mer is a node if its least sub-word stands at an end.
SUB = 3
_BASE = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93
_START, _END = 0x632BE59BD9B4E019, 0x85157AF5D2B4F3C7


def _kmer(window: int) -> int:
    """The longest k for which every window holds a node: its k-mers must outnumber k - SUB."""
    return max(SUB + 1, (window + 1 + SUB) // 2)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Spans:
    """Hashes of any span of one document's words in a few array operations.

    Prefix sums of word hash times a power of an odd base, modulo 2**64; a span's difference is
    divided by the base's power at its start, so equal spans have equal hashes wherever they stand.
    """

    powers: dict[int, tuple] = {}

    def __init__(self, hashes, base: int = _BASE):
        import numpy as np

        n = len(hashes)
        self.hashes = hashes
        have = self.powers.get(base)
        if have is None or len(have[0]) <= n:
            size = 1 << max(10, (n + 1).bit_length())
            inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            power = np.full(size, base, np.uint64)
            inverse[0] = power[0] = 1
            have = self.powers[base] = (np.multiply.accumulate(inverse),
                                        np.multiply.accumulate(power))
        self.power = have[1]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(hashes) * have[0][:n], out=self.prefix[1:])

    def of(self, start, end):
        return _mix((self.prefix[end] - self.prefix[start]) * self.power[start])


def _slide(values, width: int, best):
    """Least or greatest of every ``width`` neighbours, in log2(width) passes."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def _nodes(text: bytes | None, known: _Words, k: int):
    """Number of words, span hashes, places of the nodes and their hashes."""
    import numpy as np

    found = (text or b"").split()
    n = len(found)
    if n < k:
        return n, None, None, None
    spans = _Spans(np.fromiter(map(known.__getitem__, found), np.uint64, n))
    at = np.arange(n - SUB + 1)
    sub = spans.of(at, at + SUB)
    within = k - SUB + 1  # sub-words of a k-mer
    least = _slide(sub, within, np.minimum)
    places = np.flatnonzero((sub[:len(least)] == least) | (sub[within - 1:] == least))
    return n, spans, places, spans.of(places, places + k)


def _edges(docs: DataFrame, window: int) -> DataFrame:
    """Occurrences of nodes: ``doc_id``, ``node`` and the edges ``into`` and ``out`` of it."""
    k = _kmer(window)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = _Words()
        for batch in batches:
            parts = []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, as_bytes(batch.column(1)), strict=True):
                n, spans, places, node = _nodes(text, known, k)
                if n < window:
                    continue
                between = spans.of(places[:-1], places[1:] + k)
                head = spans.of(np.zeros(1, int), places[:1] + k) ^ np.uint64(_START)
                tail = spans.of(places[-1:], np.full(1, n)) ^ np.uint64(_END)
                parts.append((doc, node, np.concatenate([head, between]),
                              np.concatenate([between, tail])))
            if parts:
                columns = [np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)]
                owner = np.repeat(np.array([p[0] for p in parts], np.int64),
                                  [len(p[1]) for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner), *[pa.array(c.view(np.int64)) for c in columns]],
                    ["doc_id", "node", "into", "out"])

    return by_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, node long, into long, out long")


def _marks(docs: DataFrame, window: int) -> DataFrame:
    """Per document, its nodes that other documents hold too: smallest document, branching."""
    edges = _edges(docs, window)
    nodes = edges.groupBy("node").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        (F.min("into") == F.max("into")).alias("one_in"),
        (F.min("out") == F.max("out")).alias("one_out"),
    ).where("first_doc <> last_doc").drop("last_doc")
    # a node that no other document has is not here and joins nothing
    shared = stored(nodes.select("node", "first_doc", (
        F.col("one_in").cast("int") + 2 * F.col("one_out").cast("int")).alias("ways")))
    return edges.select("doc_id", "node").join(shared, "node").groupBy("doc_id").agg(
        F.collect_list(F.struct("node", "first_doc", "ways")).alias("marks"))


def _decide(doc: int, n: int, places, nodes, marks: dict, window: int, k: int):
    """For every window of a document: 1 repeats an earlier document, 0 does not, -1 to be verified."""
    import numpy as np

    found = [marks.get(x) for x in nodes.view(np.int64).tolist()]
    shared = np.array([x is not None for x in found], bool)
    first = np.array([x[0] if x else doc for x in found], np.int64)
    ways = np.array([x[1] if x else 0 for x in found], np.int64)
    count = n - window + 1
    starts = np.arange(count)
    a = np.searchsorted(places, starts)  # nodes a..b stand inside the window
    b = np.searchsorted(places, starts + window - k, side="right") - 1
    gaps = np.concatenate([[0], np.cumsum(~shared)])
    repeated = gaps[b + 1] == gaps[a]  # each of its nodes is in two documents or more
    m = len(places)
    where = np.arange(m)
    # next node that branches on its left, last node that branches on its right
    branch_in = np.minimum.accumulate(np.where(ways & 1, m, where)[::-1])[::-1]
    branch_out = np.maximum.accumulate(np.where(ways & 2, -1, where))
    low, high = np.maximum(a, branch_out[b] + 1), np.minimum(b, branch_in[a] - 1)
    path = repeated & (low <= high)  # some node fixes all words of the window
    out = np.zeros(count, np.int8)
    out[path] = first[low[path]] < doc
    out[repeated & ~path] = -1
    return out


def _repeat_windows(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """Each marked document's windows: runs decided by paths, hashes of those to be verified."""
    k = _kmer(window)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = _Words()
        names = ["doc_id", "tag", "start", "length", "h1", "h2"]
        for batch in batches:
            ids, tags, _, listed = (c.to_pylist() if i != 2 else None
                                    for i, c in enumerate(batch.columns))
            for doc, tag, text, mark in zip(ids, tags, as_bytes(batch.column(2)), listed,
                                            strict=True):
                n, spans, places, nodes = _nodes(text, known, k)
                if n < window:
                    continue
                state = _decide(doc, n, places, nodes, {
                    x["node"]: (x["first_doc"], x["ways"]) for x in mark}, window, k)
                turns = np.flatnonzero(np.diff(np.concatenate([[0], state == 1, [0]]).astype(int)))
                begin, end = turns[::2], turns[1::2]
                check = np.flatnonzero(state == -1)
                total = len(begin) + len(check)
                if not total:
                    continue
                h1 = spans.of(check, check + window).view(np.int64)
                h2 = _Spans(spans.hashes, _SECOND).of(check, check + window).view(np.int64)
                none = [None] * len(begin)
                ones = np.ones(len(check), np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(total, doc, np.int64)), pa.array(np.full(total, tag, np.int64)),
                    pa.array(np.concatenate([begin, check]).astype(np.int32)),
                    pa.array(np.concatenate([end - begin, ones]).astype(np.int32)),
                    pa.array(none + h1.tolist(), pa.int64()),
                    pa.array(none + h2.tolist(), pa.int64())], names)

    joined = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"),
                         "text").join(marks, "doc_id")
    return by_arrow(joined.select("doc_id", "tag", "text", "marks"), run,
                    "doc_id long, tag long, start int, length int, h1 long, h2 long")


def repeated_runs(docs: DataFrame, window: int = 50) -> DataFrame:
    """(``doc_id``, ``tag``, ``start``, ``length``): runs of windows that a smaller document has too.

    ``tag`` is the hash of the text the run stands in, for tables in which ids are not unique.
    """
    windows = stored(_repeat_windows(docs, _marks(docs, window), window))
    decided = windows.where(F.col("h1").isNull()).select("doc_id", "tag", "start", "length")
    verify = windows.where(F.col("h1").isNotNull())
    earliest = verify.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where(
        "first_doc <> last_doc").drop("last_doc")
    found = verify.join(earliest, ["h1", "h2"]).where("first_doc < doc_id")
    return decided.unionByName(found.select("doc_id", "tag", "start", "length"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (word spans) and ``kept_text`` added.

    Needs ``doc_id`` (an integer) and ``text``; columns of added names are replaced. A word goes if
    a window of ``window`` words over it also begins in a document with a smaller id. Texts of fewer
    words, blank and null ones lose nothing. Rows with the same id count as one document: a passage
    repeated only among them stays. A null id is in no order, so nothing is taken from or because
    of such a row. ``kept_text`` joins the kept words by one space. An empty table gives an empty
    table.
    """
    added = ("n_words", "n_removed", "removed", "kept_text")
    kept = [c for c in docs.columns if c not in added]
    known = docs.where(F.col("doc_id").isNotNull())
    runs = repeated_runs(known, window).groupBy(
        F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.collect_list(F.struct("start", "length")).alias("__runs"))
    joined = docs.select(*kept).join(
        runs, (F.col("doc_id").cast("long") == F.col("__id"))
        & (F.xxhash64("text") == F.col("__tag")), "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [cut(t, r, window) for t, r in zip(
                as_bytes(batch.column(batch.schema.get_field_index("text"))),
                batch.column(batch.schema.get_field_index("__runs")).to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(
                zip(*out, strict=True) if out else ([],) * 4,
                (pa.int64(), pa.int64(), spans, pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], *columns], [*kept, *added])

    import pyarrow as pa

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return by_arrow(
        joined.select(*kept, "__runs"), run,
        f"{schema}, n_words bigint, n_removed bigint, "
        "removed array<struct<start: int, end: int>>, kept_text string")


def cut(text: bytes | None, runs: list[dict] | None, window: int) -> tuple:
    """Number of words and of removed words, removed spans, kept words joined by one space."""
    found = (text or b"").split()
    spans: list[list[int]] = []
    for begin, end in sorted((r["start"], r["start"] + r["length"] - 1 + window) for r in runs or ()):
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, min(end, len(found))])
    kept, at = [], 0
    for begin, end in spans:
        kept += found[at:begin]
        at = end
    kept += found[at:]
    return (len(found), len(found) - len(kept), [{"start": b, "end": e} for b, e in spans],
            b" ".join(kept).decode())
