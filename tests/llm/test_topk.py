"""Exact top-k against brute force."""

import math

import numpy as np

from tracemill.llm import topk


def brute(rows, queries, k, scale=64):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = set()
    for i, v in queries:
        if i is None or not ok(v):
            continue
        q = [math.floor(scale * x) for x in v]
        scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in whole if j != i and len(w) == len(q))[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


def rows_of(n=400, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dim).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # one common vector: ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [math.nan] * dim), (2004, [math.inf] * dim), (2005, [1.0, -0.01]), (2006, [0.5, 0.2]), (2020, [0.0] * dim), (2040, [1e6] * dim), (None, [1.0] * dim)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLAB", 150)
    monkeypatch.setattr(topk.nearest, "__defaults__", (64,))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rows = rows_of()
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, slab int, score int")
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    for k in (1, 20, 1000):
        got = topk.search(vectors, vectors.filter("vec_id % 20 = 0"), k)
        assert {tuple(r) for r in got.collect()} == brute(rows, queries, k)


def test_empty_and_repeated(spark):
    vectors = spark.createDataFrame([(20, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [0.2, 0.1]), (3, [0.2, 0.1])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(vectors, vectors.filter("vec_id = 20"), 5).collect())
    assert got == [(20, 1, 3, 64 * 12 + 32 * 6), (20, 2, 3, 64 * 12 + 32 * 6)]
    assert topk.search(vectors.limit(0), vectors, 5).count() == 0
    assert topk.search(vectors, vectors.limit(0), 5).count() == 0


def slab_of(v, ids):
    low, width, cells = topk.approximate(v)
    return topk.Slab(v.shape[1], *(x.tobytes() for x in (ids, v, low, width, cells, np.ones(len(ids), np.int64))))


def test_cells_bound_their_vectors():
    v = np.random.default_rng(0).integers(-5000, 5000, (300, 9))
    q = np.random.default_rng(1).integers(-300, 300, (20, 9))
    assert topk.approximate(v)[2].max() < topk.CELLS
    centre, slack = slab_of(v, np.arange(300)).bounds(q, 40, 250)
    assert (np.abs(q @ v[40:250].T - centre) <= slack[:, None]).all()


def test_few_exact_vectors_are_read():
    """The cells settle most candidates, and the kth score of earlier blocks those of later ones."""
    rng = np.random.default_rng(2)
    v, q = rng.integers(-500, 500, (8192, 16)), rng.integers(-500, 500, (10, 16))
    slab = slab_of(v, np.arange(8192))
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            read.append(len(key))
            return np.asarray(self)[key]

    slab.vectors = slab.vectors.view(Counted)
    got = list(topk.nearest(q, np.full(10, -1), slab, 5, 1024))
    assert sum(read) < 0.05 * 8192 * 10
    for i, places, scores in got:
        ids = slab.ids[places]
        want = sorted((-int(s), j) for j, s in enumerate(v @ q[i]))[:5]
        assert [(-s, j) for j, s in zip(ids.tolist(), scores.tolist())] == want


def test_bounds_hold_in_single_precision():
    """Wide values, whose products don't fit the digits of single precision."""
    rng = np.random.default_rng(3)
    v = rng.integers(-(1 << 30), 1 << 30, (200, 300))
    q = rng.integers(-(1 << 20), 1 << 20, (20, 300))
    centre, slack = slab_of(v, np.arange(200)).bounds(q, 0, 200)
    assert (np.abs(q.astype(object) @ v.T.astype(object) - centre) <= slack[:, None]).all()


def test_repeated_rows_are_one_candidate_many_times(spark, monkeypatch):
    """A row that is there very often takes the place of one in its slab."""
    monkeypatch.setattr(topk, "SLAB", 50)
    rows = rows_of(120) + [(7777, [0.9] * 12)] * 500
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = [tuple(r) for r in topk.search(vectors, vectors.filter("vec_id % 20 = 0"), 30).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, queries, 30)
    slabs = topk._slabs(topk.usable(vectors, "vec_id", "embedding", 64).groupBy("id", "v").count().withColumnRenamed("count", "times"), 50, 150)
    assert max(len(r.ids) // 8 for r in slabs.collect()) < 120
