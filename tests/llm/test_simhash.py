"""SimHash near-dedup against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tracemill.llm import components, near, queries, simhash

DATA = "/root/testdata/sf0.001"


def brute_print(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """prints: {doc_id: int} -> {doc_id: least reachable}"""
    ids = sorted(prints)
    label = {i: i for i in ids}
    values = np.array([prints[i] for i in ids], np.uint64)
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            near = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= radius)
            least = min(label[ids[j]] for j in near)
            for j in near:
                if label[ids[j]] > least:
                    label[ids[j]], changed = least, True
    return label


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    prints = {r[0]: brute_print(r[1]) for r in rows}
    label = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash_near_dedup(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = a[:70] ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64))
    a = np.concatenate([a, near, near ^ np.uint64(5)])
    got = np.unpackbits(simhash.sliced_within(simhash.planes(a), a, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(a)]
    assert (got.astype(bool) == (np.bitwise_count(a[:, None] ^ a[None, :]) <= radius)).all()


def test_finer_blocks_for_more_fingerprints():
    """Whatever 3 bits differ, a mask leaves them out; more fingerprints get masks of more bits."""
    rng = np.random.default_rng(8)
    for count, tables, bits in ((0, 10, 25), (1 << 29, 10, 25), (1 << 30, 20, 31), (1 << 36, 20, 31), (1 << 37, 35, 36), (1 << 44, 35, 36)):
        masks = [m & (1 << 64) - 1 for m in simhash._masks(3, count)]
        assert len(masks) == tables and min(m.bit_count() for m in masks) >= bits
        for _ in range(300):
            apart = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not apart & m for m in masks)


@pytest.mark.parametrize(("bucket", "count"), [(512, None), (8, None), (8, 1 << 33), (8, 1 << 40)])
def test_large_groups_of_near_copies(spark, monkeypatch, bucket, count):
    monkeypatch.setattr(simhash, "_BUCKET", bucket)
    masks = simhash._masks
    monkeypatch.setattr(simhash, "_masks", lambda radius, n=0: masks(radius, count or n))
    monkeypatch.setattr(simhash, "_SMALL", 4)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(150)]
    prints = np.unique([base[i % 3] ^ f for i, f in enumerate(flips)] + base.tolist()).astype(np.uint64)
    ids = rng.permutation(len(prints)) + 10
    nodes = spark.createDataFrame([(int(p.view(np.int64)), int(i)) for p, i in zip(prints, ids)], "fp long, node long")
    label = brute_components({int(i): int(p) for i, p in zip(ids, prints)})
    got = {r[0]: r[1] for r in components.stars(simhash.links(nodes)).collect()}
    assert got == {i: c for i, c in label.items() if i != c}


def test_edge_cases_and_keeping_one(spark):
    rows = [(5, "a b c d"), (3, "A B  C\nd"), (None, "a b c d"), (9, None), (8, ""), (7, "\t "), (6, "x"), (6, "x"), (11, "y z"), (4, "q " * 3000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, u int")
    got = {(r["doc_id"], r["fp"] == 0, r["component_id"]) for r in simhash.components(docs).collect()}
    assert got == {(5, False, 3), (3, False, 3), (None, False, None), (9, True, 7), (8, True, 7), (7, True, 7), (6, False, 6), (11, False, 11), (4, False, 4)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["11", "3", "4", "6", "7", "None"]
    assert simhash.components(docs.limit(0)).count() == 0


def test_keep_one_of_similar_documents(spark):
    """Nearly all pairs of 0.8 or more meet, and what goes has a partner that is much alike."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    label = {r["doc_id"]: r["component_id"] for r in simhash.components(docs, similarity=0.8).collect()}
    exact = {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()}
    sets, by = {}, {}
    for i, t in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        for x in sets[i]:
            by.setdefault(x, []).append(i)
    shared = {}
    for own in by.values():
        for a in own:
            for b in own:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    near = [p for p, j in alike.items() if j >= 0.8]
    assert sum(label[a] == label[b] for a, b in near) >= 0.9 * len(near)
    linked = {i for p, j in alike.items() if j >= 0.6 for i in p}
    assert all(i in linked or label[i] == exact[i] for i in label)
    assert all(label[i] == label[c] for i, c in exact.items())
    kept = {r[0] for r in simhash.keep_one(docs, similarity=0.8).collect()}
    assert kept == {i for i, c in label.items() if i == c}


def test_similar_documents_meet_by_their_fingerprints(spark, monkeypatch):
    """Where no two documents share a band, those of one or nearly one fingerprint are still linked, if they are alike."""
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 900)]
    texts = {4: " ".join(words), 2: " ".join(words[:-5] + ["end"] * 5), 9: " ".join(words).upper(), 6: "again " * 300 + " ".join(words[:60]), 7: "again " * 300 + " ".join(words[100:160])}
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert 0 < (prints[4] ^ prints[2]).bit_count() <= 3 and prints[6] == prints[7]
    prints_of = near._prints
    monkeypatch.setattr(near, "_prints", lambda docs: prints_of(docs).withColumn("keys", F.array().cast("array<bigint>")))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r[0]: r[1] for r in simhash.components(docs, similarity=0.8).collect()} == {4: 2, 2: 2, 9: 2, 6: 6, 7: 7}
    assert {r[0]: r[1] for r in near.components(docs, 0.8).collect()} == {4: 4, 2: 2, 9: 4, 6: 6, 7: 7}
