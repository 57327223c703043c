"""Recall through trigrams against recall that tries every message."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.jobs.fixtures import frame
from tracemill.operators import recall_index as R
from tracemill.operators.memory import recall_topk
from tracemill.sources.tables import MESSAGES

DATA = "/root/testdata/sf0.001"
QUERIES = ["abc", "ABC", "b", "", "%", "_", "a%c", "abc%xyz", "ab_d", "abcd_fgh%xyz", "\\abc", "100%", "é東京𝄞", "zzz", "abcabcabc", None, "%%abc__", "xyz%abc"]
TEXTS = ["xabcx", "ABCD and fgh, then xyz", "abXd", "abcdefgh..xyz", "\\abc", "100 abc", "é東京𝄞!", "", None, "aaaa", "abcabcabc", "xyz abc"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tables(spark):
    data = [(f"{s}_{i}", s, i, "user", TEXTS[i % len(TEXTS)], TEXTS[(i * 5 + 1) % len(TEXTS)] if i % 2 else "", 100 - i % 7, "null") for s in ("s", "t") for i in range(40)]
    m = spark.createDataFrame(data + data[:3] + [("n", None, 1, "user", "abc", "", 1, "null")], MESSAGES)
    q = spark.createDataFrame([(s, i, x) for s in ("s", "t", "none", None) for i, x in enumerate(QUERIES)], "session_id string, q_seq long, q string")
    return m, q


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("k", [1, 3, 1000])
def test_equals_recall(spark, monkeypatch, block, k):
    monkeypatch.setattr(R, "BLOCK", block)
    m, q = tables(spark)
    assert rows(R.recall_indexed(R.build_recall_index(m), m, q, k)) == rows(recall_topk(m, q, k))


@pytest.mark.parametrize("name", ["recall_queries", "long_queries"])
def test_equals_recall_on_the_fixtures(spark, name):
    m, q = frame(spark, DATA, "messages"), frame(spark, DATA, name)
    assert rows(R.recall_indexed(R.build_recall_index(m), m, q)) == rows(recall_topk(m, q))


def test_fewer_rows_are_tried(spark):
    m = frame(spark, DATA, "messages").cache()
    q = frame(spark, DATA, "long_queries").filter(F.size(R.query_grams(F.col("q"))) > 0).cache()
    tried = R.candidates(R.build_recall_index(m), q).count()
    pairs, hits = m.join(q.select("session_id"), "session_id").count(), recall_topk(m, q, 1 << 30).count()
    print({"messages tried": tried, "pairs": pairs, "hits": hits})
    assert hits <= tried < pairs / 2


def test_empty_tables(spark):
    m, q = tables(spark)
    index = R.build_recall_index(m.limit(0))
    assert R.recall_indexed(index, m.limit(0), q).count() == 0
    assert R.recall_indexed(R.build_recall_index(m), m, q.limit(0)).count() == 0


def test_a_row_of_the_index_is_a_page(spark):
    m = frame(spark, DATA, "messages")
    index = R.build_recall_index(m)
    pages = m.select("session_id", F.floor(F.col("seq") / R.PAGE)).distinct().count()
    assert index.count() <= pages + spark.sparkContext.defaultParallelism < m.count()


def test_pages_in_several_rows_and_repeated_messages(spark):
    m, q = tables(spark)
    m = m.unionByName(m).unionByName(m)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        index = R.build_recall_index(m).localCheckpoint()
        assert index.count() > m.select("session_id", F.floor(F.col("seq") / R.PAGE)).distinct().count()
        assert rows(R.recall_indexed(index, m, q, 1000)) == rows(recall_topk(m, q, 1000))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("span", [4, 64, 1 << 20])
def test_slots_hold_every_trigram(spark, monkeypatch, span):
    """By a plain loop, over spans that part a text; and the hash of a trigram is the one that queries ask with."""
    monkeypatch.setattr(R, "SPAN", span)
    texts = [("Abcdé東京𝄞\nz" * 9, ""), (None, "aBc"), ("ab", None), ("", "𝄞𝄞𝄞x"), ("q" * 300 + "END", "end")]
    places = [-70, -3, 0, 31, 32]
    given = pa.RecordBatch.from_pydict({"session_id": ["s"] * 5, "block": [s // R.BLOCK for s in places], "seq": places, "content": pa.array([a for a, _ in texts], pa.string()), "reasoning_content": pa.array([b for _, b in texts], pa.string())})
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = {(s, i): {t[j : j + 3] for j in range(len(t) - 2)} for s, both in zip(places, texts) for i, t in enumerate((x or "").translate(lower) for x in both)}
    every = sorted(set().union(*grams.values()))
    hashes = dict(spark.createDataFrame([(g,) for g in every], "g string").select("g", R._hash(F.col("g"))).collect())
    held = {k: set() for k in grams}
    for piece in R._cut(given):
        for page in R._pages(piece).to_pylist():
            assert len(page["slots"]) == 1 << page["bits"]
            for (s, i), own in held.items():
                if s // R.PAGE == page["page"]:
                    own |= {g for g in every if page["slots"][hashes[g] >> (R.WIDE - page["bits"])] >> (s % R.PAGE * 2 + i) & 1}
    assert all(grams[k] <= held[k] for k in grams)
    assert not held[0, 0] and not held[-3, 0]
