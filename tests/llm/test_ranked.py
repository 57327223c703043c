"""Ranked search against a plain computation."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tracemill.llm import ranked


def terms_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k):
    held = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms_of(t))]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, text in {(i, t) for i, t in items if i is not None}:
        asked.setdefault(i, Counter()).update(terms_of(text))
    out = []
    for i, wanted in asked.items():
        w = {t: times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t, times in wanted.items() if df[t]}
        scored = [(sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total))) for t in w if c[t]), d) for d, c, size in held]
        best = sorted((-s, d is None, d or 0) for s, d in scored if s > 0)[:k]
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(best)]
    return out


def key(row):
    return [(x is None, x or 0) for x in row]


def tables():
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(300)] + ["Ünï", "東京", "X9"]
    prose = lambda n: " ".join(word[int(x)] for x in np.minimum(rng.zipf(1.3, n), len(word)) - 1)
    docs = [(i, prose(int(rng.integers(1, 200)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # copies: ties
    docs += [(2000, ""), (2001, None), (2002, " .,;"), (2003, "W7 w7, w7"), (2004, prose(30_000)), (None, docs[3][1]), (None, "rare"), (17, "again w5"), (17, "again w5")]
    items = [(i, prose(12)) for i in range(25)] + [(100, docs[3][1]), (101, None), (102, "never-heard of"), (103, "w1 " * 50), (104, "rare again"), (105, "w7 ünï ÜNÏ"), (106, "w7"), (106, "w8 w9"), (106, "w7"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20, 1000])
def test_against_plain_computation(spark, monkeypatch, k):
    docs, items = tables()
    monkeypatch.setattr(ranked, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(ranked, "STEP", 8)
    monkeypatch.setattr(ranked, "BLOCK", 9)
    monkeypatch.setattr(ranked, "PART_SHARDS", 1)
    index = ranked.build(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shard int, score int").repartition(3))
    got = ranked.search(index, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(docs, items, k), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(ranked.build(none), items).count() == 0
    index = ranked.build(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert ranked.search(index, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(index, items).collect()] == [(1, 1, 1)]


def grid(rows, columns, cells, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.choice(rows * columns, cells, replace=False)
    return at // columns, at % columns, rng.integers(1, 1_000_000, cells)


@pytest.mark.parametrize("shape", [(1, 1, 1), (300, 40, 900), (5, 700, 1500), (1000, 1000, 1)])
def test_tree_keeps_every_cell(shape):
    """Each path from the root ends at the cell's value, and every node on it is the maximum of its quadrant."""
    row, column, value = grid(*shape)
    treap = ranked.Treap(*ranked.tree(row, column, value))
    depth = len(treap.masks)
    want = {(r, c): v for r, c, v in zip(row.tolist(), column.tolist(), value.tolist())}
    nodes = np.zeros(len(row), np.int64)
    for level in range(depth):
        shift = depth - 1 - level
        nodes = treap.children(level, nodes, (row >> shift & 1) << 1 | column >> shift & 1)
        most = {}
        for (r, c), v in want.items():
            most[r >> shift, c >> shift] = max(v, most.get((r >> shift, c >> shift), 0))
        assert treap.most[level + 1][nodes].tolist() == [most[r >> shift, c >> shift] for r, c in zip(row.tolist(), column.tolist())]
    assert all(treap.most[-1][treap.children(depth - 1, np.array([-1]), np.array([q]))][0] == 0 for q in range(4))


def test_few_documents_are_visited():
    """Best-first descent leaves most ranges closed, also at frequent terms."""
    row, column, value = grid(4000, 3000, 60_000)
    treap = ranked.Treap(*ranked.tree(row, column, value))
    visited, plain_children = [], treap.children
    treap.children = lambda level, nodes, q: visited.append(len(nodes) * (level == len(treap.masks) - 1)) or plain_children(level, nodes, q)
    rows, weights = np.array([3, 900, 2500]), np.array([10, 7, 5])
    score, ids = treap.best(rows, weights, np.arange(3000), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 5)
    sums = np.zeros(3000, np.int64)
    for r, w in zip(rows, weights):
        np.add.at(sums, column[row == r], w * value[row == r])
    assert list(zip(score, ids)) == sorted(((s, i) for i, s in enumerate(sums)), key=lambda x: (-x[0], x[1]))[:5]
    assert sum(visited) < 200
