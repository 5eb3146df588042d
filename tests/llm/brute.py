"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    counts = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if counts[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def fingerprint(text):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def component_ids(fps, radius=4):
    """fps: (doc_id, fingerprint) rows; the smallest id reachable of each."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            r = find(i)
            least[r] = min(doc, least.get(r, doc))
    return [least.get(find(i)) for i in range(len(fps))]


def substring(docs, window=50):
    """docs: (doc_id, text) rows; number of words, of removed words, kept text of each."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items, window=13):
    wanted = defaultdict(set)
    for item, text in items:
        w = TERM.findall((text or "").translate(FOLD))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wanted[tuple(w[i:i + k])].add(item)
    lengths = {len(k) for k in wanted}
    out = []
    for _, text in docs:
        w = TERM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (m := wanted.get(tuple(w[i:i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= m
        ids = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def targets(sizes):
    """sizes: source -> words. Reshares until no target passes its cap."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out
