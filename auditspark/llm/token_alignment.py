"""Two tokenizers over one text, aligned: groups of tokens between the bytes where both end a token.

A stretch of text becomes a fragment: the tokens before its first common end (open prefix), whole
groups (closed), the tokens after its last common end (open suffix). Fragments of neighbours compose
associatively, only prefix and suffix meet, so the fragments of a very long text are made in separate
tasks and composed as a tree. Closed groups stay where they were made.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import by_arrow, stored

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: How the byte-level vocabulary parts a text before merging: a fixed value.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more bytes than LONG are cut into stretches of about STRETCH, fragments of their own.
LONG, STRETCH = 65_536, 32_768
#: Fragments composed in one group of a round.
FAN = 16
#: Id pairs whose counts are broadcast at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Within a group, more links than this are counted by distinct ids and not listed.
LISTED = 4_096
_SHIFT = 20  # ids of B have at most 20 bits in an id pair


def _letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256, 257, .."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both vocabularies, read on the driver and shipped to the tasks (about 2 MB)."""

    tokens_a: list[bytes]
    model_b: bytes
    _ready: tuple = field(default=(), repr=False)

    @classmethod
    def read(cls, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Tokenizers:
        with open(byte_bpe, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letters = model["vocab"], _letters()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{byte_bpe}: ids do not follow the order of merges")
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, at in vocab.items():
            tokens[at] = bytes(letters[c] for c in token)
        with open(piece_bpe, "rb") as file:
            return cls(tokens, file.read())

    def ready(self):
        """Encoders and, per id, the bytes, their number and the decimal forms of both vocabularies."""
        if not self._ready:
            import numpy as np
            import sentencepiece
            import tiktoken

            a = tiktoken.Encoding("a", pat_str=PARTS, special_tokens={}, mergeable_ranks={
                t: i for i, t in enumerate(self.tokens_a) if t})
            b = sentencepiece.SentencePieceProcessor(model_proto=self.model_b)
            pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
            tokens_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
            parts = not any(re.search("[^▁]▁", p) for p in pieces)
            sizes = [np.array([len(t) for t in ts], np.int64) for ts in (self.tokens_a, tokens_b)]
            n = max(map(len, sizes))
            forms = np.array([[f"{i}{end}" for i in range(n)] for end in (",", "|", ";", "")], object)
            self._ready = (a, b, tokens_b, sizes, forms, parts)
        return self._ready

    def __getstate__(self):
        return {"tokens_a": self.tokens_a, "model_b": self.model_b, "_ready": ()}

    def encode(self, texts: list[str]):
        """Ids of A and B of each text, None where the bytes of either are not a space and the text."""
        a, b, tokens_b, *_ = self.ready()
        out = []
        for text, y in zip(texts, b.encode(texts, num_threads=1), strict=True):
            whole = " " + text
            x, raw = a.encode_ordinary(whole), whole.encode()
            same = b"".join([tokens_b[i] for i in y]) == raw and b"".join([self.tokens_a[i] for i in x]) == raw
            out.append((x, y) if same else None)
        return out


_SAFE = re.compile(rb"(?<=[!-~]) (?=[A-Za-z])")


def stretches(text: str, size: int, safe: bool = True) -> list[str]:
    """``text`` cut at single spaces before ASCII letters, each left out, ``size`` bytes apart or more.

    Neither vocabulary has a token over such a space, and each puts a space before a text, so the
    tokens of the stretches are the tokens of the text. Without such a space there is one stretch.
    """
    raw, found, at = text.encode(), [], 0
    while safe and len(raw) - at > size and (cut := _SAFE.search(raw, at + size)):
        found.append(raw[at:cut.start()].decode())
        at = cut.end()
    return [*found, raw[at:].decode()]


@dataclass
class Fragment:
    """Tokens that end in a range of bytes: (ids, ends) of A and of B.

    ``meets`` tells whether both end somewhere in the range; if not, all tokens are the prefix.
    ``closed`` lists whole groups of (ids of A, ids of B).
    """

    prefix: tuple
    closed: list
    suffix: tuple
    meets: bool

    @classmethod
    def of(cls, a, ends_a, b, ends_b) -> Fragment:
        common = sorted(set(ends_a) & set(ends_b))
        if not common:
            return cls((list(a), list(b)), [], ([], []), False)
        cuts = [(-1, common[0]), *zip(common, common[1:], strict=False), (common[-1], float("inf"))]
        groups = [([i for i, e in zip(a, ends_a, strict=True) if low < e <= high],
                   [i for i, e in zip(b, ends_b, strict=True) if low < e <= high]) for low, high in cuts]
        return cls(groups[0], groups[1:-1], groups[-1], True)

    def then(self, other: Fragment) -> Fragment:
        """This fragment and its right neighbour as one."""
        both = tuple(x + y for x, y in zip(self.suffix if self.meets else self.prefix, other.prefix, strict=True))
        if self.meets and other.meets:
            return Fragment(self.prefix, [*self.closed, both, *other.closed], other.suffix, True)
        if self.meets:
            return Fragment(self.prefix, self.closed, both, True)
        return Fragment(both, other.closed, other.suffix, other.meets)

    def groups(self) -> list:
        """The groups of a whole text: its beginning closes the prefix, its end the suffix."""
        return [g for g in (self.prefix, *self.closed, self.suffix) if g[0] or g[1]]


EMPTY = Fragment(([], []), [], ([], []), False)


def tables(tokenizers: Tokenizers, encoded: list, closed_only: bool = False):
    """What a batch of stretches holds, found together: per stretch the number of tokens, groups and
    links, the groups as text, the id pairs and how often each is linked; with ``closed_only`` of the
    groups between the first and the last common end, with the tokens of the open prefix beside.
    """
    import numpy as np

    *_, (size_a, size_b), forms, _ = tokenizers.ready()
    n = len(encoded)
    count = [np.array([len(e[s]) if e else 0 for e in encoded], np.int64) for s in (0, 1)]
    ids = [np.array([i for e in encoded if e for i in e[s]], np.int64) for s in (0, 1)]
    doc = [np.repeat(np.arange(n), c) for c in count]
    lengths = [size_a[ids[0]], size_b[ids[1]]]
    ends = [np.cumsum(x) for x in lengths]
    common = np.intersect1d(ends[0], ends[1], assume_unique=True)
    group = [np.searchsorted(common, e) for e in ends]
    of = np.zeros(len(common), np.int64)
    of[group[0]] = doc[0]
    open_tokens = []
    if closed_only:
        # the first group of a stretch may go on to the left, so it is its open prefix
        first = np.searchsorted(of, np.arange(n))
        last = np.searchsorted(of, np.arange(n), side="right")
        for d in range(n):
            inside = [x == first[d] if last[d] > first[d] else np.zeros(len(x), bool) for x in group]
            open_tokens.append([ids[s][inside[s]].tolist() for s in (0, 1)])
        keep = [g != first[d] for g, d in zip(group, doc, strict=True)]
        ids, doc, group = ([x[k] for x, k in zip(y, keep, strict=True)] for y in (ids, doc, group))
        count = [np.bincount(d, minlength=n) for d in doc]
    in_group = [np.bincount(g, minlength=len(common)) for g in group]
    made = in_group[0] * in_group[1]
    links = np.zeros(n, np.int64)
    np.add.at(links, of, made)
    groups = np.bincount(of[made > 0], minlength=n)

    # the groups as text: tokens in order of group, A before B
    place = np.concatenate([group[0] * 2, group[1] * 2 + 1])
    order = np.argsort(place, kind="stable")
    sign, owner = place[order], np.concatenate(doc)[order]
    end = np.full(len(order), 3)
    if len(order):
        end[:-1] = np.where(sign[1:] == sign[:-1], 0, np.where(sign[1:] == sign[:-1] + 1, 1, 2))
        end[:-1][owner[1:] != owner[:-1]] = 3
        odd = (sign[:-1] % 2 == 1) & (sign[1:] == sign[:-1] + 1) & (end[:-1] == 1)
        end[:-1][odd] = 2
    shown = forms[end, np.concatenate(ids)[order]].tolist()
    stop = np.cumsum(count[0] + count[1])
    text = ["".join(shown[a:b]) for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    # every link of a group once; groups with many links by their distinct ids
    many = made > LISTED
    from_b = np.cumsum(in_group[1]) - in_group[1]
    some = ~many[group[0]]
    rep = in_group[1][group[0][some]]
    at = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep) + np.repeat(from_b[group[0][some]], rep)
    key = np.repeat(doc[0][some] << 40 | ids[0][some] << _SHIFT, rep) | ids[1][at]
    keys, times = np.unique(key, return_counts=True)
    if many.any():
        more = {}
        for g in np.flatnonzero(many):
            (a, ca), (b, cb) = (np.unique(ids[s][group[s] == g], return_counts=True) for s in (0, 1))
            found = (of[g] << 40 | a[:, None] << _SHIFT | b[None, :]).ravel()
            for k, m in zip(found.tolist(), (ca[:, None] * cb[None, :]).ravel().tolist(), strict=True):
                more[k] = more.get(k, 0) + m
        keys, back = np.unique(np.concatenate([keys, np.fromiter(more, np.int64)]), return_inverse=True)
        times = np.bincount(back, weights=np.concatenate([times, np.fromiter(more.values(), np.int64)])
                            ).astype(np.int64)
    cut = np.searchsorted(keys >> 40, np.arange(n + 1))
    pair = keys & ((1 << 40) - 1)
    return {"n_a": count[0], "n_b": count[1], "n_groups": groups, "n_links": links, "groups": text,
            "pairs": [pair[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)],
            "times": [times[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], "open": open_tokens}


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _arrow(found: dict):
    import pyarrow as pa

    return [*[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
            pa.array(found["groups"], pa.string()),
            *[pa.array(found[c], pa.list_(pa.int64())) for c in ("pairs", "times")]]


_NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def _short(docs: DataFrame, tokenizers: Tokenizers, long: int, stretch: int) -> DataFrame:
    """Every document aligned; one of more than ``long`` bytes only cut into ``stretches``."""

    def run(batches):
        import pyarrow as pa

        safe = tokenizers.ready()[-1]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                cut = [stretches(t, stretch, safe) if 4 * len(t) > long and len(t.encode()) > long else None
                       for t in texts]
                now = [i for i, c in enumerate(cut) if texts[i] and not (c and len(c) > 1)]
                encoded = [None] * len(texts)
                for i, e in zip(now, tokenizers.encode([texts[i] for i in now]), strict=True):
                    encoded[i] = e
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *_arrow(tables(tokenizers, encoded)),
                     pa.array([c if c and len(c) > 1 else None for c in cut], pa.list_(pa.string()))],
                    ["row", "doc_id", *_NAMES, "stretches"])

    return by_arrow(docs, run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, {_COUNTS}, stretches array<string>")


_OPEN = "prefix_a array<int>, prefix_b array<int>, suffix_a array<int>, suffix_b array<int>, meets boolean"


def _fragments(cut: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """A fragment per stretch: open tokens, and its closed groups as counts, text and pairs."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 20):
                batch = whole.slice(at, 20)
                encoded = tokenizers.encode(batch.column(2).to_pylist())
                found = tables(tokenizers, encoded, closed_only=True)
                # both end a token where a stretch ends, so the suffix is empty; the prefix is the first group
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *_arrow(found),
                     *[pa.array([p[s] for p in found["open"]], pa.list_(pa.int32())) for s in (0, 1)],
                     *[pa.array([[]] * len(encoded), pa.list_(pa.int32()))] * 2,
                     pa.array([e is not None for e in encoded], pa.bool_()),
                     pa.array([e is None for e in encoded], pa.bool_())],
                    ["row", "seq", *_NAMES, "prefix_a", "prefix_b", "suffix_a", "suffix_b", "meets", "bad"])

    return by_arrow(cut, run, f"row long, seq int, {_COUNTS}, {_OPEN}, bad boolean")


def _closing(tokenizers: Tokenizers, groups: list) -> dict:
    """Counts, text and pairs of single groups of (ids of A, ids of B)."""
    import numpy as np

    made = {c: [] for c in _NAMES}
    for a, b in groups:
        (x, m), (y, k) = (np.unique(np.array(ids, np.int64), return_counts=True) for ids in (a, b))
        for c, v in (("n_a", len(a)), ("n_b", len(b)), ("n_groups", 1), ("n_links", len(a) * len(b)),
                     ("groups", f"{','.join(map(str, a))}|{','.join(map(str, b))}"),
                     ("pairs", (x[:, None] << _SHIFT | y[None, :]).ravel()), ("times", (m[:, None] * k[None, :]).ravel())):
            made[c].append(v)
    return made


def _compose(open_ends: DataFrame, tokenizers: Tokenizers, last: bool) -> DataFrame:
    """One round: up to FAN neighbours of a document become one fragment; groups that close between
    them come out as rows of their own, ``seq`` the stretch that they end in, ``half`` before its own."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("seq")
        rows, closed = [], []
        whole, begun, ended = EMPTY, None, 0
        for r in frame.itertuples():
            begun = r.seq if begun is None else begun
            part = Fragment((list(r.prefix_a), list(r.prefix_b)), [], (list(r.suffix_a), list(r.suffix_b)), r.meets)
            whole = whole.then(part)
            closed += [(r.seq, g) for g in whole.closed]
            whole.closed, ended = [], r.last
        if last:
            left = whole.groups()
            # the first of what is left opens the text, a second one ends it
            closed += [(begun if i == 0 else ended + 1, g) for i, g in enumerate(left)]
        else:
            rows.append({"row": key[0], "seq": begun, "last": ended, "prefix_a": whole.prefix[0],
                         "prefix_b": whole.prefix[1], "suffix_a": whole.suffix[0], "suffix_b": whole.suffix[1],
                         "meets": whole.meets, **{c: None for c in _NAMES}})
        made = _closing(tokenizers, [g for _, g in closed])
        for i, (seq, _) in enumerate(closed):
            rows.append({"row": key[0], "seq": seq, "last": None, "prefix_a": None, "prefix_b": None,
                         "suffix_a": None, "suffix_b": None, "meets": None, **{c: made[c][i] for c in _NAMES}})
        out = pd.DataFrame(rows, columns=["row", "seq", "last", "prefix_a", "prefix_b", "suffix_a", "suffix_b",
                                          "meets", *_NAMES])
        for c in ("seq", "last", "n_a", "n_b", "n_groups", "n_links"):
            out[c] = out[c].astype("Int64")
        return out

    return open_ends.groupBy("row", "step").applyInPandas(
        run, f"row long, seq int, last int, {_OPEN}, {_COUNTS}")


def _long(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Pieces of the long documents: rows (``row``, ``seq``, ``half``, counts, text, pairs), in order
    of ``seq``, ``half``; none of a document with a stretch whose bytes differ."""
    cut = docs.where("stretches IS NOT NULL").select("row", F.posexplode("stretches").alias("seq", "stretch"))
    made = stored(_fragments(cut.repartition("row", "seq"), tokenizers))
    bad = made.where("bad").select("row").distinct()
    made = made.join(bad, "row", "left_anti")
    pieces = made.where("n_groups > 0").select("row", "seq", F.lit(1).alias("half"), *_NAMES)
    most = made.agg(F.max("seq")).first()[0]
    ends = made.select("row", "seq", F.col("seq").alias("last"), "prefix_a", "prefix_b", "suffix_a", "suffix_b", "meets")
    step = FAN
    while most is not None:
        final = step > most
        round_ = stored(_compose(ends.withColumn("step", F.floor(F.col("seq") / step)), tokenizers, final))
        pieces = pieces.unionByName(round_.where("n_groups IS NOT NULL").select(
            "row", "seq", F.lit(0).alias("half"), *_NAMES))
        ends = round_.where("n_groups IS NULL").select(ends.columns)
        if final:
            break
        step *= FAN
    return pieces


def align(docs: DataFrame, tokenizers: Tokenizers | None = None, long: int = LONG, stretch: int = STRETCH,
          broadcast: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Alignment of both tokenizers over ``docs`` (``doc_id``, ``text``): documents and pieces.

    Documents, one row per row of ``docs``: ``row`` (a number of the run), ``doc_id``, ``n_a``,
    ``n_b`` tokens, ``n_groups``, ``n_links`` (pairs of tokens of a group), ``n_best`` (links whose
    id pair is held by as many documents as any pair of their A id, ties included), ``count_sum``
    (over links, documents that hold the id pair). Pieces: ``row``, ``seq``, ``half``, ``only``,
    ``groups``: joined by ``;`` in order of ``seq``, ``half`` they are the document's groups,
    ``a,a|b;..``; ``only`` marks a document's single piece.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte (a space and
    the text), have no tokens: zeros and no piece. Repeated rows are documents of their own. A very
    long text is cut only where no token can reach over; without such a place it is encoded whole.
    An empty table gives empty tables; other columns are not looked at.
    """
    tokenizers = tokenizers or Tokenizers.read()
    numbered = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    short = stored(_short(numbered, tokenizers, long, stretch))
    pieces = stored(_long(short, tokenizers))
    held = pieces.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(
        "row", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times"))
    pairs = short.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).unionByName(held)
    counts = stored(pairs.groupBy("pair").agg(F.count("*").alias("docs")))
    best = counts.withColumn("best", F.col("docs") == F.max("docs").over(
        Window.partitionBy(F.shiftright("pair", _SHIFT))))
    if counts.count() <= broadcast:
        best = F.broadcast(best)
    scored = pairs.join(best, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("docs") * F.col("times")).alias("count_sum"))
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    of_long = pieces.groupBy("row").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    documents = short.join(scored, "row", "left").join(of_long, "row", "left")
    nought = F.lit(0).cast("long")
    found = documents.select("row", "doc_id", *[F.coalesce(f"_{c}", c, nought).alias(c) for c in sums], *[
        F.coalesce(c, nought).alias(c) for c in ("n_best", "count_sum")])
    shown = short.where("n_groups > 0").select(
        "row", F.lit(0).alias("seq"), F.lit(1).alias("half"), F.lit(True).alias("only"), "groups")
    return found, shown.unionByName(pieces.select("row", "seq", "half", F.lit(False).alias("only"), "groups"))
