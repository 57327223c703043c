"""Stored messages: saves are whole or not at all."""

import pytest
from pyspark.sql import functions as F

from tracemill.sources import tables
from tracemill.sources.store import ConflictError, MessageStore


def turns(spark, n, text, sessions=20, start=0):
    rows = [(f"{i % sessions}_{start + i}", f"s{i % sessions}", start + i, "user", f"{text}{i}", "", 100 + i, "null", 1) for i in range(n)]
    return spark.createDataFrame(rows, tables.MESSAGES + ", write_seq int")


@pytest.fixture
def store(spark, tmp_path):
    out = MessageStore(spark, f"file://{tmp_path}/m", buckets=8)
    assert out.save(turns(spark, 60, "a")) == 1
    return out


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_saves_replace_by_id(spark, store):
    before = rows(store.read())
    again = turns(spark, 20, "b").filter("session_id in ('s1', 's2')")
    twice = again.union(again.withColumns({"write_seq": F.lit(9), "content": F.concat("content", F.lit("!"))}))
    assert store.save(twice.union(turns(spark, 1, "new", start=500))) == 2
    got = {r.id: r.content for r in store.read().collect()}
    assert len(got) == 61 and got["1_1"] == "b1!" and got["2_2"] == "b2!" and got["3_3"] == "a3" and got["0_500"] == "new0"
    assert rows(store.read(1)) == before and store.versions() == [1, 2]
    assert store.read().schema == spark.createDataFrame([], tables.MESSAGES).schema


def test_untouched_buckets_keep_their_files(spark, store):
    files = set(store.read().inputFiles())
    store.save(turns(spark, 1, "b"))
    now = set(store.read().inputFiles())
    assert len({f.rsplit("/", 2)[1] for f in now - files}) == 1 and len(now & files) >= len(files) - 2


def test_a_failed_save_leaves_the_old_version(spark, store, monkeypatch):
    before, files = rows(store.read()), sorted(store.read().inputFiles())
    bad = turns(spark, 20, "b").withColumn("content", F.when(F.col("seq") < 19, F.col("content")).otherwise(F.raise_error(F.lit("broken row"))))
    with pytest.raises(Exception, match="broken row"):
        store.save(bad)
    assert rows(store.read()) == before and store.versions() == [1]

    def lost(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(store, "_commit", lost)  # all data is written, the version isn't
    with pytest.raises(RuntimeError):
        store.save(turns(spark, 20, "b"))
    again = MessageStore(spark, store.path, buckets=8)
    assert rows(again.read()) == before and sorted(again.read().inputFiles()) == files


def test_two_saves_from_one_version(spark, store, monkeypatch):
    """The second one fails whole, and can be tried again."""
    other = MessageStore(spark, store.path, buckets=8)
    commit, once = store._commit, []

    def raced(number, folders):
        if not once:
            once.append(other.save(turns(spark, 20, "first")))
        commit(number, folders)

    monkeypatch.setattr(store, "_commit", raced)
    with pytest.raises(ConflictError):
        store.save(turns(spark, 20, "second"))
    assert {r.content[:5] for r in store.read().filter("seq < 20").collect()} == {"first"}
    assert store.save(turns(spark, 20, "second")) == 3
    assert {r.content[:6] for r in store.read().filter("seq < 20").collect()} == {"second"}


def test_sessions_and_vacuum(spark, store):
    store.save(turns(spark, 20, "b"))
    some = store.read_sessions(spark.createDataFrame([("s3",), ("none",)], "session_id string"))
    assert {r.session_id for r in some.collect()} == {"s3"} and len({f.rsplit("/", 2)[1] for f in some.inputFiles()}) <= 2
    want = rows(store.read())
    store.vacuum()
    assert store.versions() == [2] and rows(store.read()) == want
    folders = set(store.folders().values())
    assert {f.rsplit("/", 3)[1] for f in store.read().inputFiles()} == folders


def test_empty_saves_and_tables(spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/e")
    assert store.read().count() == 0 and store.save(turns(spark, 5, "x").limit(0)) == 0 and store.versions() == []
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, 1), ("i", None, 1, "user", "x", "", 1, "null", 1)], tables.MESSAGES + ", write_seq int")
    assert store.save(odd) == 1 and store.read().count() == 2


def test_messages_in_buckets(spark, tmp_path):
    m = turns(spark, 30, "a").drop("write_seq")
    tables.write_messages(m, f"file://{tmp_path}/b", buckets=4)
    tables.write_messages(m, f"file://{tmp_path}/plain")
    for name in ("b", "plain"):
        back = tables.read_messages(spark, f"file://{tmp_path}/{name}")
        assert back.columns == m.columns and rows(back) == rows(m)
    tables.write_messages(m.filter("session_id = 's1'").withColumn("content", F.lit("new")), f"file://{tmp_path}/b", buckets=4)
    assert {r.content for r in tables.read_messages(spark, f"file://{tmp_path}/b").filter("session_id = 's1'").collect()} == {"new"}
