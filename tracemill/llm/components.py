"""Connected components of an edge table, by alternating large and small stars until nothing changes.

Each half-round is a partial minimum per node and a join back, over the table of edges; nothing is collected. Minima and
edges are written to the shared folder, so lineage stays one step long and both sides of a join are plain scans, which
adaptive execution can split where one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (u, v): every node that isn't its component's least, with that least node. Loops may be there."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter("u <> v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
