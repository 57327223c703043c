"""Files of the bounded-text query follow the documents, and a refused file isn't dropped."""

import pytest

from tracemill.jobs import plan_queries
from tracemill.sources import files

DATA = "/root/testdata/sf0.001"


def test_files_follow_the_documents(spark, monkeypatch):
    read, seen = files.read_requested, []

    def watched(spark, requests, base, max_bytes=files.MAX_BYTES):
        seen.append((max_bytes, [r[0] for r in spark.read.format("binaryFile").load(f"{base}/docs").select("length").collect()]))
        return read(spark, requests, base, max_bytes)

    monkeypatch.setattr(files, "MAX_BYTES", 1 << 18)
    monkeypatch.setattr(files, "read_requested", watched)
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    out = plan_queries.a5_read_bounded_text(spark, DATA)
    want = documents.selectExpr("doc_id", "md5(replace(text, chr(10), ' ')) text_md5")
    assert sorted(tuple(r) for r in out.collect() if r[0] is not None) == sorted(map(tuple, want.collect()))
    assert len(seen[0][1]) > 10 and max(seen[0][1]) <= seen[0][0] < 1 << 20


def test_a_refused_file_is_an_error(spark, monkeypatch):
    read = files.read_requested
    monkeypatch.setattr(files, "read_requested", lambda spark, requests, base, max_bytes=0: read(spark, requests, base, 10))
    with pytest.raises(Exception, match="file too large"):
        plan_queries.a5_read_bounded_text(spark, DATA).collect()
