import math

import numpy as np
import pytest

from auditspark.llm import embedding_cells, queries

SCHEMA = "vec_id long, embedding array<double>, label int, node string, rank int"


def brute(rows, cosine=0.93):
    """rows: (vec_id, vector, label); links, component and kept of each, by all pairs."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v / abs(v).max()) / abs(v).max()

    units = [None if label is None else unit(v) for _, v, label in rows]
    links = [[j for j, w in enumerate(units) if i != j and u is not None and w is not None
              and len(u) == len(w) and rows[i][2] == rows[j][2] and u @ w >= cosine]
             for i, u in enumerate(units)]
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in links[todo.pop()] if j not in seen])
            seen.update(new)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(links[i]), least, None if vec is None else vec == least))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def crowd(seed, spread, n, dims=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    centre /= np.linalg.norm(centre)
    return [(centre + rng.normal(size=dims) * spread).tolist() for _ in range(n)]


@pytest.mark.parametrize("cell, block", [(512, 1024), (40, 16), (10, 1024)])
def test_links_match_all_pairs(spark, cell, block):
    vectors = [(v, 1) for v in crowd(1, .02, 120) + crowd(2, .05, 150) + crowd(3, .12, 80)]
    vectors += [(v, 2) for v in crowd(1, .03, 30)] + [(v, 1) for s in range(4, 40) for v in crowd(s, .09, 4)]
    vectors += [vectors[0]] * 40 + [([2 * x for x in vectors[0][0]], 1)]
    rows = [((i * 7919) % 1009, v, label) for i, (v, label) in enumerate(vectors)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    found = embedding_cells.near_vectors(frame, cell=cell, block=block, margin=.37)
    assert got(found) == brute(rows)


def test_whole_table_matches_all_pairs(spark, sf001):
    table = spark.read.parquet(f"{sf001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert got(queries.op13_embedding_dedup(spark, sf001)) == brute(rows)


def test_default_margin_keeps_nine_of_ten_links_at_the_limit(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(700, 24))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = .935 * base + math.sqrt(1 - .935 ** 2) * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    found = embedding_cells.near_vectors(frame, cell=60)
    want = sum(r[1] for r in brute(rows))
    assert .98 * want <= sum(r.n_links for r in found.collect()) <= want


def test_odd_rows(spark):
    v, nan, big = [1.0, 0.0], float("nan"), 1e200
    rows = [(5, v, 1), (5, v, 1), (4, v, 2), (3, v, None), (2, None, 1), (1, [], 1), (0, [0.0, 0.0], 1),
            (9, [nan, 1.0], 1), (8, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (None, [1.0, 0.1], 1),
            (6, [big, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [-1.0, 0.0], 1), (11, [1.0], 1)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    found = got(embedding_cells.near_vectors(frame))
    assert found == brute(rows)
    assert (None, 3, 5, None) in found and (None, 0, None, None) in found
    assert embedding_cells.near_vectors(frame.limit(0)).count() == 0
