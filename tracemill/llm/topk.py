"""Exact top-k by inner product with vector-approximation files.

Vectors become integers floor(scale * x); equal rows are one candidate with a number of times. Candidates are dealt into slabs
by a hash; a slab is one row that holds its vectors and, made once, their approximation: each dimension cut into at most
``CELLS`` cells of equal width, one byte a component. Queries are blocks, a stated query set against all rows. A slab's task
reads the slab, once, and then streams all query blocks past it. The scan of the cells, a product of single-precision weights
and bytes, gives every candidate's bounds; exact vectors are then read in order of the upper bound until the kth exact score
so far is above it, which makes the query's answer for the slab certain. A slab sends at most k rows a query, and a window
keeps the best k.

Scale: slabs and blocks bound every task's memory, whatever rows repeat; the work is queries x candidates, as the contract
asks; what crosses to a worker is each slab once and the queries once a slab; nothing is broadcast; rows between stages are at
most k x queries x slabs.

Defined cases: null vectors, empty vectors, and vectors with null or non-finite components take no part; vectors meet
only vectors of the same number of dimensions; ties go to the smaller id; fewer candidates than k give all; a query isn't
its own candidate: rows with its id are left out; repeated rows are candidates each, and one query; integers are meant to
stay under 2**31 and scores under 2**63; null ids take no part; an empty table gives an empty table; other columns, also
ones called ``rank``, ``score``, ``dim`` or ``slab``, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
SLAB = 16384
BLOCK = 2048
QUERY_BLOCK = 256
CELLS = 64
NAMES = ["dim", "slab", "ids", "exact", "low", "width", "cells", "times"]
FOUND = "query_id long, vec_id long, score long, times long"


def integers(vector: str, scale: int) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, as integers."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    kept = vectors.filter(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad))
    return kept.select(F.col(vec_id).cast("long").alias("id"), integers(vector, scale).alias("v"))


def _slabs(rows: DataFrame, size: int, count: int) -> DataFrame:
    """(dim, slab, ids, exact, low, width, cells, times): the vectors of a slab and their approximation, as bytes of one row."""

    def pack(table: pa.Table) -> pa.Table:
        ids, dim = table.column("id").to_numpy(), table.column("dim")[0].as_py()
        vectors = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        ids, vectors, times = ids[order], vectors[order], table.column("times").to_numpy()[order]
        low, width, cells = approximate(vectors)
        kind = "<i4" if np.abs(vectors).max() < 1 << 31 else "<i8"
        data = (ids.astype("<i8"), vectors.astype(kind), low.astype("<i8"), width.astype("<i8"), cells, times.astype("<i8"))
        return pa.table([pa.array([dim], pa.int32()), pa.array([table.column("slab")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], NAMES)

    slabs = max(1, -(-count // size))
    dealt = rows.select("id", "v", "times", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(slabs)).cast("int").alias("slab"))
    return dealt.groupBy("dim", "slab").applyInArrow(pack, f"dim int, slab int, {', '.join(f'{c} binary' for c in NAMES[2:])}")


class Slab:
    """A slab read back: ids ascend; vectors stay as they were written until they are asked for."""

    def __init__(self, dim: int, ids: bytes, exact: bytes, low: bytes, width: bytes, cells: bytes, times: bytes):
        self.times = np.frombuffer(times, "<i8")
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(exact, f"<i{len(exact) // max(1, len(self.ids) * dim)}").reshape(-1, dim)
        self.low, self.width = np.frombuffer(low, "<i8"), np.frombuffer(width, "<i8")
        self.cells = np.frombuffer(cells, np.uint8).reshape(-1, dim)

    def bounds(self, queries: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the middles of the cells of vectors a to b, and how far from these the scores may be, by query."""
        half, weight = (self.width - 1) / 2, queries * self.width.astype(np.float64)
        middle = (queries @ (self.low + half))[:, None] + weight.astype(np.float32) @ self.cells[a:b].astype(np.float32).T
        # what rounding may hide: of each weight, each product and each sum in single precision, and of the rest in double
        size = np.abs(weight).sum(1) * CELLS
        return middle, np.abs(queries) @ half + size * (len(half) + 2) * 2.0**-23 + 1e-9 * (size + np.abs(queries) @ np.abs(self.low + half))


def approximate(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each dimension where its cells begin and their width, and the cell of each component."""
    low, high = vectors.min(0), vectors.max(0)
    width = np.maximum(1, -(-(high - low + 1) // cells))
    return low, width, ((vectors - low) // width).astype(np.uint8)


def nearest(queries: np.ndarray, own: np.ndarray, slab: Slab, k: int, step: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best different rows of a slab: index, places in the slab, scores. The cells are scanned ``step``
    vectors at a time; the kth score so far bounds what is read of the rest."""
    ids = [np.zeros(0, np.int64)] * len(queries)
    scores = [np.zeros(0, np.int64)] * len(queries)
    for a in range(0, len(slab.ids), step):
        b = min(len(slab.ids), a + step)
        centre, slack = slab.bounds(queries, a, b)
        for i, query in enumerate(queries):
            upper = centre[i] + slack[i]
            others = slab.ids[a:b] != own[i]
            least = [scores[i].min()] if len(scores[i]) == k else []
            if others.sum() > k:
                certain = upper[others]
                least.append(np.partition(certain, len(certain) - k)[len(certain) - k] - 2 * slack[i])
            left = np.flatnonzero(others & (upper >= max(least)) if least else others)
            left = left[np.argsort(-upper[left], kind="stable")]
            done = 0
            while done < len(left) and not (len(scores[i]) == k and scores[i].min() > upper[left[done]]):
                read = left[done : done + 4 * k] + a
                done += len(read)
                found, score = np.append(ids[i], read), np.append(scores[i], slab.vectors[read].astype(np.int64) @ query)
                best = np.lexsort((slab.ids[found], -score))[:k]
                ids[i], scores[i] = found[best], score[best]
    yield from ((i, ids[i], scores[i]) for i in range(len(queries)) if len(ids[i]))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each row of queries among vectors."""
    rows = usable(vectors, vec_id, vector, scale).groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))
    asked = usable(queries, vec_id, vector, scale).distinct().withColumn("times", F.lit(1).cast("long"))
    n, m = rows.count(), asked.count()
    count = max(1, -(-n // SLAB))
    slabs = _slabs(rows, SLAB, n).withColumn("asks", F.lit(False))
    blocks = _slabs(asked, QUERY_BLOCK, m).select("dim", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slab"), "ids", "exact", F.lit(True).alias("asks"))
    both = slabs.unionByName(blocks, allowMissingColumns=True).repartition(count, "dim", "slab").sortWithinPartitions("dim", "slab", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, slab = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, number, *parts, asks = (column[i] for column in batch.columns)
                here = dim.as_py(), number.as_py()
                if not asks.as_py():
                    at, slab = here, Slab(here[0], *(x.as_py() for x in parts))
                elif at == here:
                    own = np.frombuffer(parts[0].as_py(), "<i8")
                    wanted = np.frombuffer(raw := parts[1].as_py(), f"<i{len(raw) // (len(own) * at[0])}").astype(np.int64).reshape(-1, at[0])
                    found = list(nearest(wanted, own, slab, k))
                    if found:
                        query, place = np.repeat(own[[f[0] for f in found]], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found])
                        yield pa.RecordBatch.from_pydict({"query_id": query, "vec_id": slab.ids[place], "score": np.concatenate([f[2] for f in found]), "times": slab.times[place]})

    found = both.select(*NAMES, "asks").mapInArrow(meet, FOUND)
    found = found.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(True), F.least("times", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
