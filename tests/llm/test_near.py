"""Near copies against brute force on whole sets of shingles."""

import re

import numpy as np
import pytest

from tracemill.llm import near, simhash


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def brute_labels(texts, least=0.8):
    ids = sorted(texts)
    sets, label = {i: brute_set(texts[i]) for i in ids}, {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and label[a] != label[b]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= least:
                    low, high = sorted((label[a], label[b]))
                    label = {i: low if x == high else x for i, x in label.items()}
    return label


def edited(words, places, tag):
    out = list(words)
    for k in places:
        out[k] = f"{tag}x{k}"
    return " ".join(out)


def test_a_star_of_1000_copies_with_the_original_in_the_middle(spark):
    """Copies are 0.85 to the original and about 0.74 to each other: only links to the original hold."""
    rng = np.random.default_rng(0)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 129)]
    own = brute_set(" ".join(words))
    texts = {500: " ".join(words)}
    for i in [*range(500), *range(501, 1001)]:
        texts[i] = edited(words, [int(rng.integers(10, 60)), int(rng.integers(70, 120))], i)
    to_first = [len(own & brute_set(t)) / len(own | brute_set(t)) for i, t in texts.items() if i != 500]
    assert min(to_first) >= 0.8 and len(brute_set(texts[0]) & brute_set(texts[1])) / len(brute_set(texts[0]) | brute_set(texts[1])) < 0.8
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r[0]: r[1] for r in simhash.components(docs, similarity=0.8).select("doc_id", "component_id").collect()} == dict.fromkeys(texts, 0)
    assert [r[0] for r in simhash.keep_one(docs, similarity=0.8).select("doc_id").collect()] == [0]


def test_recall_of_the_bands_does_not_depend_on_the_number_of_documents():
    """Pairs at 0.8 or little more share a key, and one band is shared as often as five minima are."""
    rng = np.random.default_rng(1)
    met, hits = [], []
    for _ in range(3000):
        both = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.unique(np.append(both, rng.integers(0, 1 << 63, 20, dtype=np.uint64))) for _ in range(2))
        assert near.alike(a, b) == 0.8
        same = near.keys(a) == near.keys(b)
        met.append(same.any())
        hits.append(same.mean())
    assert all(met) and abs(np.mean(hits) - 0.8**5) < 0.01
    apart = [near.keys(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(2)]
    assert not (apart[0] == apart[1]).any() and (apart[0] % near.BANDS == np.arange(near.BANDS)).all()


def test_links_hold_exactly_at_the_limit(spark):
    """On both sides of 0.8, long texts and short; and a shingle repeated over half of a text doesn't make it a copy."""
    rng = np.random.default_rng(2)
    texts, n = {}, 0
    for size in (5, 8, 9, 60, 400, 2000):
        for k in range(1, 1 + min(12, size // 3)):
            words = [f"s{x}" for x in rng.integers(0, 10**9, size)]
            cut = max(1, round(size * (0.17 + 0.006 * k)))
            texts[n], texts[n + 1] = " ".join(words), " ".join(words[cut // 2 :] + [f"q{x}" for x in rng.integers(0, 10**9, cut // 5)])
            n += 2
    for k in range(3):
        texts[n + k] = "again " * 300 + " ".join(f"o{x}" for x in rng.integers(0, 10**9, 120))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len({r[1] for r in simhash.components(docs.filter(f"doc_id >= {n}")).select("doc_id", "component_id").collect()}) == 1
    got = {r[0]: r[1] for r in simhash.components(docs, similarity=0.8).select("doc_id", "component_id").collect()}
    want = brute_labels(texts)
    assert got == want and 10 < len(set(want.values())) < len(want)


def test_forest_connects_what_links_connect(monkeypatch, spark):
    """Whatever the sizes of buckets and chunks, and with labels given before."""
    rng = np.random.default_rng(3)
    texts = {}
    for f in range(3):
        words = [f"f{f}w{x}" for x in range(100)]
        for i in range(90):
            texts[len(texts)] = edited(words, rng.choice(100, rng.integers(0, 5), replace=False), i)
    monkeypatch.setattr(near, "_SMALL", 3)
    monkeypatch.setattr(near, "_CHUNK", 8)
    docs = spark.createDataFrame([(i * 7 % 271, t) for i, t in texts.items()], "doc_id long, text string")
    want = brute_labels({i * 7 % 271: t for i, t in texts.items()})
    assert {r[0]: r[1] for r in simhash.components(docs, similarity=0.8).select("doc_id", "component_id").collect()} == want


def test_nulls_repeats_and_no_words(spark):
    rows = [(5, "a b c d"), (3, "A B  C\nd"), (None, "a b c d"), (9, None), (8, ""), (7, "\t "), (6, "x"), (6, "x"), (6, "y z"), (11, "y z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, same int")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.components(docs, similarity=0.8).collect()}
    assert got == {(5, 3), (3, 3), (None, None), (9, 7), (8, 7), (7, 7), (6, 6), (11, 6)}
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs, similarity=0.8).collect()) == ["3", "6", "7", "None"]
    assert simhash.components(docs.limit(0), similarity=0.8).count() == 0


def templated(n, own, rng, template=60):
    """Texts that share the beginning and have ``own`` words of their own."""
    head = " ".join(f"t{i}" for i in range(template))
    return {i: f"{head} " + " ".join(f"o{x}" for x in rng.integers(0, 10**9, own)) for i in range(n)}


def test_texts_of_one_template_never_meet(monkeypatch, spark):
    """About half alike: they fill buckets together, but have less than 0.8 in common with all others together. What is alike among them is found."""
    rng, seen = np.random.default_rng(4), {}
    shared, blocks = near._shared, near._blocks
    monkeypatch.setattr(near, "_shared", lambda *a: seen.setdefault("shared", shared(*a)))
    monkeypatch.setattr(near, "_blocks", lambda named, *a: seen.setdefault("met", []).append(named.count()) or blocks(named, *a))
    texts = templated(1500, 56, rng)
    for i in range(0, 200, 10):  # pairs at a little over 0.8
        words = texts[i].split()
        texts[5000 + i] = " ".join(words[:-10] + [f"e{x}" for x in rng.integers(0, 10**9, 8)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r[0]: r[1] for r in simhash.components(docs, similarity=0.8).select("doc_id", "component_id").collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i in texts}
    buckets = {k for t in texts.values() for k in near.keys(near.shingles(t.encode())).tolist()}
    assert len(buckets) < 0.98 * len(texts) * near.BANDS  # many share a key with others
    assert 2 <= seen["shared"].count() <= 40 and sum(seen.get("met", [])) < 40 * near.BANDS


@pytest.mark.parametrize("own", [8, 12, 16, 30])
def test_templates_near_the_limit(spark, monkeypatch, own):
    """From templates that are nearly all of a text to such that are less: the same links as by trying all pairs."""
    monkeypatch.setattr(near, "_SMALL", 4)
    monkeypatch.setattr(near, "_CHUNK", 16)
    texts = templated(90, own, np.random.default_rng(own))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r[0]: r[1] for r in simhash.components(docs, similarity=0.8).select("doc_id", "component_id").collect()} == brute_labels(texts)
