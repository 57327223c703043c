"""Fingerprints and edits against a plain computation."""

import hashlib
import math

import numpy as np
import pytest

from tracemill.llm import fingerprints


def plain_digest(data, buckets=fingerprints.BUCKETS):
    counts = [0] * buckets
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
        counts[(h ^ h >> 13) % buckets] += 1
    ranked = sorted(counts)
    cuts = [ranked[buckets * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(n > q for q in cuts) for n in counts]
    packed = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, buckets, 4)]
    return bytes([min(255, int(8 * math.log2(len(data) + 1))), *packed]), codes


def plain_likeness(a, b):
    (x, cx), (y, cy) = plain_digest(a), plain_digest(b)
    apart = sum(6 if abs(i - j) == 3 else abs(i - j) for i, j in zip(cx, cy)) + min(64, 2 * abs(x[0] - y[0]))
    return 1 - min(apart, fingerprints.MOST) / fingerprints.MOST


def plain(rows):
    rows = sorted(((i, (t or "")) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()[:8]))
    out = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        own, new = t.encode(), changed.encode()
        out.append((i, len(t), hashlib.sha256(new).hexdigest(), plain_digest(own)[0].hex(), plain_digest(new)[0].hex(), plain_likeness(own, new), plain_likeness(own, after.encode())))
    return out


def key(row):
    return [(x is None, x if x is not None else 0) for x in row]


def rows_of(n=150):
    rng = np.random.default_rng(3)
    texts = ["", None, "a", "ab", "abc", "é東京𝄞 " * 9, "same text in many rows " * 3, "x" * 5000]
    out = [(int(i * 7 % n) * 3, texts[i % 11] if i % 11 < len(texts) else "".join(rng.choice(list("abcdeé \n"), int(rng.integers(1, 900))))) for i in range(n)]
    return out + [(None, "no id"), (None, None), (12, "again"), (12, "again"), (12, "other")]


@pytest.mark.parametrize("rows", [rows_of(), rows_of(2)[:2], [(5, "alone, so next to itself")], [(1, None), (2, None)], [(9, "equal ids")] * 5])
def test_against_plain_computation(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, data string").repartition(3)
    got = fingerprints.compare_edited(docs)
    assert got.columns == fingerprints.RESULT
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_many_ranges(spark, monkeypatch):
    """Ranges of few documents, some of them empty, meet at their ends."""
    monkeypatch.setattr(fingerprints, "RANGE", 4)
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    assert sorted((tuple(r) for r in fingerprints.compare_edited(docs).collect()), key=key) == sorted(plain(rows_of()), key=key)


def test_long_text_in_steps(monkeypatch):
    data = np.random.default_rng(0).integers(97, 101, 10_000).astype(np.uint8).tobytes()
    whole = fingerprints.digests([data])
    monkeypatch.setattr(fingerprints, "_STEP", 333)
    assert fingerprints.digests([data]) == whole == [plain_digest(data)[0]]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.compare_edited(none).count() == 0 and fingerprints.fingerprint(none).count() == 0


def test_likeness_tells_edits_from_strangers(spark):
    """On whole documents, the edited text is nearly always nearer than the next document; equal texts have likeness 1."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = fingerprints.compare_edited(docs).collect()
    different = [r for r in rows if r.near_next < 1]
    assert sum(r.near_edited > r.near_next for r in different) > 0.97 * len(different)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert {r.doc_id: r.fingerprint for r in rows} == {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
