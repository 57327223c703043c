"""Substring and suffix-array dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tracemill.llm import anchors, exchange, hashing, queries, substring_dedup, suffix_dedup

DATA = "/root/testdata/sf0.001"


def brute_words(rows, window):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen, out = set(), []
    gone = [[False] * len(w) for w in words]
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[k][i : i + window] = [True] * window
            seen.add(key)
    for (doc_id, _), w, g in zip(rows, words, gone):
        out.append((doc_id, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)))
    return sorted(out, key=repr)


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return sorted(out, key=repr)


def small(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "é", "longer", "word,", "x", " y"]
    passage = " ".join(rng.choice(vocabulary, 30))
    rows = [(None, passage), (7, None), (8, ""), (9, "  \t\n"), (10, "one")]
    for i in range(60):
        body = list(rng.choice(vocabulary, rng.integers(1, 60)))
        if i % 3 == 0:
            body.insert(int(rng.integers(0, len(body))), passage)
        rows.append((100 - i, "\n".join([" ".join(body), " ".join(rng.choice(vocabulary, 3))])))
    rows += [rows[20], (rows[21][0], rows[22][1]), (500, "ab " * 400), (501, "a" * 900), (502, rows[30][1])]
    return rows


@pytest.fixture(params=[4 << 20, 1500])
def batch_bytes(request, monkeypatch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", request.param)
    monkeypatch.setattr(substring_dedup, "PART_BYTES", request.param)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", request.param)
    return request.param


def local(steps, rows, batches):
    """The exchange without Spark: rows by batch, answers by part."""
    tables = {}
    for b in range(batches):
        own = [(i, None if x is None else x.encode()) for i, x in rows if hash(i) % batches == b]
        if own:
            tables[b] = pa.table({"batch": pa.array([b] * len(own), pa.int64()), "doc_id": pa.array([r[0] for r in own], pa.int64()), "data": pa.array([r[1] for r in own], pa.binary())})

    def told(sent, answer):
        codes = {b: {} for b in tables}
        whole = pa.concat_tables(sent)
        for p in sorted(set(whole.column("part").to_pylist())):
            for b, q, c in zip(*(col.to_pylist() for col in answer(p, whole.filter(pc.equal(whole.column("part"), p))).columns)):
                codes[b][q] = c
        return codes

    first = told([steps.ask_texts(b, t) for b, t in tables.items()], lambda p, t: steps.answer_texts(t))
    second = told([steps.ask_windows(b, t, first[b]) for b, t in tables.items()], steps.answer_windows)
    done = [steps.finish(t, *steps.flagged(t, first[b], second[b])) for b, t in tables.items()]
    return sorted((tuple(r.values()) for t in done for r in t.to_pylist()), key=repr)


def no_prefixes():
    return {w: np.zeros(substring_dedup._BINS, bool) for w in (1, 2)}


@pytest.mark.parametrize("hot", [0, 1, 2, 4096])
@pytest.mark.parametrize("step", [1 << 18, 97])
def test_every_way_through_the_exchange(monkeypatch, hot, step):
    """Hot grams and others, one batch and many, few parts and many, long documents in pieces."""
    monkeypatch.setattr(anchors, "_STEP", step)
    for seed, batches, parts in ((3, 1, 1), (4, 5, 3), (5, 40, 50)):
        rows = small(seed)
        rows += [(900, " ".join(r[1] or "" for r in rows[5:40])), (901, "!" + " ".join(r[1] or "" for r in rows[5:40]))]
        assert local(substring_dedup.exchange(no_prefixes(), parts, 6, 3, hot), rows, batches) == brute_words(rows, 6)
        cuts = np.sort(np.random.default_rng(seed).integers(0x2000000000000000, 0x7800000000000000, parts - 1).astype(np.uint64))
        assert local(suffix_dedup.exchange(cuts, parts, 60, 16, hot), rows, batches) == brute_bytes(rows, 60)


def test_weak_hashes_merge_nothing(monkeypatch):
    """Windows whose hashes are all the same are told apart by their bytes."""
    monkeypatch.setattr(hashing, "range_hashes", lambda data, start, end, step=0: np.zeros(len(start), np.uint64))
    rows = small(7)
    assert local(substring_dedup.exchange(no_prefixes(), 3, 6, 3), rows, 4) == brute_words(rows, 6)
    assert local(suffix_dedup.exchange(np.zeros(0, np.uint64), 1, 60, 16), rows, 4) == brute_bytes(rows, 60)


@pytest.mark.parametrize("weak", [False, True])
def test_nodes_are_those_of_the_tree(monkeypatch, weak):
    """Windows in the order of their bytes, runs of equal ones as the internal nodes of that depth with all their leaves, and
    the depth at which neighbouring nodes part; also where all hashes are the same."""
    if weak:
        monkeypatch.setattr(hashing, "range_hashes", lambda data, start, end, step=0: np.zeros(len(start), np.uint64))
    rng = np.random.default_rng(1)
    base = bytes(rng.choice(list(b"ab\0"), 1500).tolist())
    data = np.frombuffer(base + base[100:900] + base[300:500] + base, np.uint8)
    start = np.arange(len(data) - 40)
    size = np.where(start % 5 == 0, 11, 12 + 20 * (start % 2))
    order, node, common = anchors.nodes(data, start, size)
    text = [data[i : i + n].tobytes() for i, n in zip(start.tolist(), size.tolist())]
    assert [text[i] for i in order] == sorted(text)
    kinds = sorted(set(text))
    assert [text[i] for i in order] == [kinds[n] for n in node]
    shared = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert common.tolist() == [shared(x, y) for x, y in zip(kinds, kinds[1:])] and max(common) > 16


def test_maximal_repeats():
    """By name: repeats that can't be made longer on either side, with all their places."""
    assert anchors.maximal_repeats(b"xabcdyabcdzabc", 3) == {(b"abcd", (1, 6)), (b"abc", (1, 6, 11))}
    text = bytes(np.random.default_rng(2).choice(list(b"abc"), 300).tolist())
    want = set()
    for n in range(4, 40):
        places = {}
        for i in range(len(text) - n + 1):
            places.setdefault(text[i : i + n], []).append(i)
        for x, at in places.items():
            ends, begins = {text[p + n : p + n + 1] for p in at}, {text[p - 1 : p] if p else None for p in at}
            if len(at) > 1 and (len(ends) > 1) and len(begins) > 1:
                want.add((x, tuple(at)))
    assert want and anchors.maximal_repeats(text, 4) == want


def test_an_edge_that_all_documents_share(monkeypatch):
    """Every document has a passage and goes on in its own way, so that the grams at its edge have as many texts as there are
    documents. No part gets much more than others, in either step."""
    rng, batches, parts = np.random.default_rng(6), 40, 16
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 8))) for i in range(4000)]
    steps, sent, most = substring_dedup.exchange(no_prefixes(), parts, 20, 8, 64), {}, []
    for name in ("ask_texts", "ask_windows"):
        made = getattr(steps, name)
        monkeypatch.setattr(steps, name, lambda *a, made=made, name=name: sent.setdefault(name, []).append(t := made(*a)) or t)
    got = local(steps, rows, batches)
    assert sum(r[2] for r in got) == 30 * 3999
    for name in ("ask_texts", "ask_windows"):
        whole = pa.concat_tables(sent[name])
        size = {}
        for p, x in zip(whole.column("part").to_pylist(), whole.column("payload").to_pylist()):
            size[p] = size.get(p, 0) + len(x)
        most.append(max(size.values()) / (sum(size.values()) / len(size)))
    assert max(most) < 3, most
    assert sum(k >= parts for k in size) == parts  # the windows of hot grams are dealt over parts of their own


def test_multikey_order():
    rng = np.random.default_rng(2)
    symbols = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order, run = anchors.multikey(symbols)
    keys = list(zip(*(s.tolist() for s in symbols)))
    got = [keys[i] for i in order]
    assert got == sorted(keys) and [a == b for a, b in zip(got, got[1:])] == (run[1:] == run[:-1]).tolist()


def test_equal_grams_never_lie_across_a_boundary():
    """A lead that fills several ranges is cut by its gram; between different leads the splitters decide."""
    cuts = np.array([5, 9, 9, 9, 12], np.uint64)
    lead = np.repeat(np.array([1, 5, 9, 9, 10, 20], np.uint64), 1000)
    gram = np.random.default_rng(3).integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2)
    part = suffix_dedup.range_of(cuts, lead, gram)
    assert (part == suffix_dedup.range_of(cuts, lead, gram)).all() and set(part[lead == 9].tolist()) == {1, 2, 3, 4}
    assert set(part[lead == 1].tolist()) == {0} and set(part[lead == 5].tolist()) == {0, 1} and set(part[lead == 10].tolist()) == {4} and set(part[lead == 20].tolist()) == {5}


def test_prefixes_grow_until_a_group_fits(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(["a", "b"] * 30 if i % 2 else rng.choice(words, 60))) for i in range(200)], "doc_id long, text string")
    full = substring_dedup.full_prefixes(docs, 20, 8, 500)
    assert list(full) == [1, 2, 4, 8] and all(x.sum() in (1, 2) for x in full.values())
    own = substring_dedup._Words([b"a b a b a b a b a b", b"w1 w2 w3 w4 w5 w6 w7 w8"])
    group = substring_dedup.group_of(own, np.array([0, 1, 10]), np.array([1 << 40, 2 << 40, 3 << 40], np.uint64), full, 1000003)
    assert group[:2].tolist() == [(1 << 20) % 1000003, (2 << 20) % 1000003] and group[2] == int(hashing.mix(np.array([own.bins(1, np.array([10]))[0] * 64 + 1], np.uint64))[0] % np.uint64(1000003))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, batch int, part string")


@pytest.mark.parametrize("hot", [1, 4096])
def test_small(spark, batch_bytes, hot):
    rows = small()
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(frame(spark, rows), 6, 3, hot).collect()), key=repr)
    assert got == brute_words(rows, 6)
    got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.remove_repeats(frame(spark, rows), 60, 16, hot).collect()]
    assert sorted(got, key=repr) == brute_bytes(rows, 60)


def test_empty(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_queries_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = sorted((tuple(r) for r in queries.op6_substring_dedup(spark, DATA).collect()), key=repr)
    assert got == [(*r[:3], sha(r[3].encode())) for r in brute_words(rows, 20)]
    got = sorted((tuple(r) for r in queries.op8_suffix_array_dedup(spark, DATA).collect()), key=repr)
    assert got == sorted(((*r[:4], sha(r[4])) for r in brute_bytes(rows, 400)), key=repr)
