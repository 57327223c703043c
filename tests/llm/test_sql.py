"""Queries with SQL against DuckDB."""

import duckdb
import pandas as pd
import pytest

from tests.test_oracle import TABLES
from tests.test_oracle import rows as rows_of
from tracemill.llm import line_dedup, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = rows_of(queries.QUERIES[name](spark, DATA).toPandas())
    assert got[1] and got == rows_of(con.sql(queries.ORACLE_SQL[name]).df())


def test_lines_with_nulls(spark):
    """The SQL of op 1 on null texts and sources, repeated rows and blank lines."""
    rows = [(i % 9, None if i % 4 == 0 else f"s{i % 3}", None if i % 7 == 3 else "\n".join(["shared", "", f"own {i}", " "][: i % 5])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = line_dedup.drop_boilerplate(docs).selectExpr("doc_id", "source", "lines_total", "lines_dropped", "md5(text) kept_md5")
    frame = pd.DataFrame(rows, columns=["doc_id", "source", "text"])
    con = duckdb.connect()
    con.register("documents", frame)
    want = rows_of(con.sql(queries.OP1_SQL).df())
    assert rows_of(out.toPandas()) == want and any(r[2] for r in want[1])
