"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import regex

from tracemill.llm import importance


def features_of(text, n=2):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, min_words=20, share=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    split = [(d, *features_of(t, n)) for d, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in split for f in fs), Counter(bucket(f) for x in target for f in features_of(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, words, fs in split:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((-r[3], r[0] is not None, r[0] or 0, i) for i, r in enumerate(rows) if r[4] >= min_words)
    place = {a[3]: k + 1 for k, a in enumerate(able[: len(able) * share // 100])}
    return [(*r[:4], place.get(i)) for i, r in enumerate(rows)]


def key(row):
    return [(x is None, x or 0) for x in row]


TEXTS = ["", None, " ,;\n", "one", "Ünï-CODE ÜÑÏ 東京 x1y2", "a  b\tA_B " * 40, "the quick brown fox jumps over the lazy dog " * 7, "tail " * 70_000, "\x00\x7f é é " * 30]


def rows_of():
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else " ".join(f"w{(i * j) % 17} Common" for j in range(i))) for i in range(90)]
    return rows + [(7, "the same text " * 20)] * 3 + [(None, "lost id " * 15), (None, None)]


@pytest.mark.parametrize("share", [25, 100, 0])
def test_against_plain_computation(spark, share):
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows_of()], "doc_id long, text string, score int, rank int, able int").repartition(5)
    target = ["the lazy dog and the fox", "Common w3", None, ""]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), share=share)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows_of(), target, share=share), key=key)


def test_longer_grams_and_fewer_buckets(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    target = ["w1 Common w2 common", "lost id"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=3, buckets=97, min_words=2)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows_of(), target, 3, 97, 2), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in importance.resample(some, none).collect()) == brute([(1, "a b " * 20), (2, None)], [])


def test_spans_overlap():
    one, two = importance.patterns(2)
    assert [m.group() for m in two.finditer(b"a bc d e", overlapped=True)] == [b"a bc", b"bc d", b"d e"]
    assert [m.span() for m in one.finditer(b"ab c", overlapped=True)] == [(0, 2), (3, 4)]
    assert isinstance(one, regex.Pattern)
