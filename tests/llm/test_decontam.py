"""Decontamination against full alignment of every document with every item."""

import numpy as np
import pytest

from tracemill.llm import decontam, queries

DATA = "/root/testdata/sf0.001"


def least_edits(item: bytes, text: bytes) -> int:
    """Sellers' matrix, column by column over the whole text."""
    rows = np.arange(len(item) + 1)
    cost, best = rows.copy(), len(item)
    pattern = np.frombuffer(item, np.uint8)
    for c in text:
        new = np.empty_like(cost)
        new[0] = 0
        new[1:] = np.minimum(cost[:-1] + (pattern != c), cost[1:] + 1)
        cost = np.minimum.accumulate(new - rows) + rows
        best = min(best, int(cost[-1]))
    return best


def edited(rng, text: str, n: int) -> str:
    for _ in range(n):
        i = int(rng.integers(0, len(text)))
        text = [text[:i] + "#" + text[i:], text[:i] + text[i + 1 :], text[:i] + "?" + text[i + 1 :]][int(rng.integers(0, 3))]
    return text


@pytest.mark.parametrize("step", [1 << 18, 200])
def test_against_full_alignment(spark, monkeypatch, step):
    monkeypatch.setattr(decontam, "_STEP", step)
    rng = np.random.default_rng(4)
    syllables = ["the ", "on", "er ", "é", "st ", "ing ", "a", "rr"]
    some = lambda n: "".join(rng.choice(syllables, n))
    items = [(i, some(int(rng.integers(6, 60)))) for i in range(12)] + [(90, "zq"), (91, "  "), (92, None), (93, "the   On")]
    docs = [(1, None), (2, ""), (3, "a zQ b")]
    for k in range(70):
        body = some(int(rng.integers(0, 200)))
        source = items[k % 12][1]
        piece = edited(rng, source.upper() if k % 3 == 0 else source.replace(" ", "\n "), int(rng.integers(0, len(source) // 6 + 1)))
        at = int(rng.integers(0, len(body) + 1))
        docs.append((100 + k, body[:at] + piece + body[at:]))
    docs.append(docs[5])
    wanted = []
    for d, t in docs:
        text = decontam.normal(t)
        for i, x in items:
            item = decontam.normal(x)
            if item and text and (e := least_edits(item, text)) <= decontam.budget(len(item)):
                wanted.append((d, i, e))
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(frame, bench).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(wanted)
    by_id = dict(docs)
    for r in got[:40]:
        assert least_edits(decontam.normal(dict(items)[r[1]]), decontam.normal(by_id[r[0]])[r[3] : r[4]]) == r[2]
    bad = {d for d, *_ in wanted}
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r[0] for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "abc def ghi jkl")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(docs, none).count() == 0 and decontam.clean(docs, none).count() == 1
    assert decontam.matches(docs.limit(0), spark.createDataFrame([(1, "abc def ghi")], none.schema)).count() == 0


def test_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc def ghi jkl mno"), (2, "pqr stu vwx yz one two"), (3, "none of these are here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "abc def ghi jkl"), (2, "stu vwx yz one")], "item_id long, text string")
    monkeypatch.setattr(decontam, "SHARD", 16)
    assert sorted(tuple(r)[:3] for r in decontam.matches(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0)]
    assert [r[0] for r in decontam.clean(docs, bench).collect()] == [3]


def test_query_on_whole_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = [(r[0], decontam.normal(r[1])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op7_benchmark_decontamination(spark, DATA).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if x in decontam.normal(t)}
    assert exact <= set(got) and all(got[p] == 0 for p in exact)
    text = {d: decontam.normal(t) for d, t in docs}
    short = [d for d in text if len(text[d]) < 900][:25]
    for d in {*short, *(p[0] for p in got)}:
        for i, x in items:
            if len(text[d]) < 3000 or (d, i) in got:
                e = least_edits(x, text[d])
                assert ((d, i) in got) == (e <= decontam.budget(len(x))) and got.get((d, i), e) == e


def test_no_pair_is_aligned_twice(monkeypatch):
    """Overlapping bands are one region: a text that holds an edited item once gives one alignment, an exact one none."""
    rng = np.random.default_rng(8)
    item = bytes(rng.integers(97, 123, 200, dtype=np.uint8))
    edited_item = item[:50] + b"#" + item[51:120] + item[122:]
    seen = []
    least = decontam.least_edits
    monkeypatch.setattr(decontam, "least_edits", lambda items, texts, low, high, most: seen.extend(zip(texts, items)) or least(items, texts, low, high, most))
    index = decontam.Index([(1, item)])
    pad = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(0, 300, 40)]
    got = list(decontam.search(index, [a + edited_item + b for a, b in zip(pad, pad[::-1])]))
    assert len(seen) == len(set(seen)) == 40 and [g[2] for g in got] == [3] * 40
    assert [g[3:] for g in got] == [(len(a), len(a) + len(edited_item)) for a in pad]
    seen.clear()
    assert [g[2] for g in decontam.search(index, [a + item for a in pad])] == [0] * 40 and not seen


def test_repeated_grams_count_once():
    """A text that repeats one q-gram of an item on one diagonal band doesn't reach the bound by it."""
    item = b"abcdefgh" + b"xyzuvwrst" * 3
    index = decontam.Index([(1, item)])
    data = np.frombuffer(b"zzzzzzzz".join([item[:8]] * 60), np.uint8)
    assert not len(index.regions(data, np.zeros(len(data), np.int64)))


def test_long_items(spark):
    rng = np.random.default_rng(9)
    item = bytes(rng.integers(97, 123, 6000, dtype=np.uint8))
    text = bytearray(b"head " + item + b" tail")
    for k in range(60):
        text[30 + 90 * k] = 35
    assert [g[2] for g in decontam.search(decontam.Index([(1, item)]), [bytes(text)])] == [60]
