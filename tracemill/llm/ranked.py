"""Ranked lexical search with K2-treaps over the grid of terms and documents.

Documents are dealt into shards of about ``SHARD_BYTES`` of text. A shard is a grid: its terms are rows, by falling document
frequency, its documents are columns, by falling length, and a cell's value is the impact of the term in the document. The
grid is kept as a quadtree: a node has four bits, one for each quadrant that isn't empty, and the largest impact in it,
stored as what it falls short of its parent's; empty quadrants take no room. Nodes of a level lie in Morton order, so a
child's place is a running count of bits.

A search starts at the root with one path per row that the item asks for, and descends all of them at once: a step halves
the document ranges with the highest bounds, the weighted sum of the maxima that the paths find there. Ranges whose bound is
below the kth score are dropped; single documents have their exact score. A task carries an item's k best from shard to shard.

``build`` gives the index, one row a shard, for every term of every document; ``search`` reads the collection's statistics from
it, so the same index answers any items.

Scale: texts are read once, where they lie, and never move. The index is dealt into parts of about ``PART_SHARDS`` shards, and
items into blocks of at most ``BLOCK``; a part meets a block in one task, which holds one shard and the block at a time and sends
at most k rows an item. Document frequencies are taken from the shards' terms, only for terms asked for. A frequent term is
one row in each shard, so nothing is dealt by term but one number a shard.

Defined cases: null and empty texts, and texts without terms, are no documents for the statistics and never found; items
without known terms give no rows; rows of one item_id with different texts are one item with all their terms, equal rows count
once, and a null item_id takes no part; repeated documents are documents each; a null doc_id comes last among ties and is
returned as null (2**63 - 1 stands for it, which no id should be); scores stay under 2**63; a very long text is a shard of its
own; empty tables give an empty table; other columns, also ones called ``term``, ``shard`` or ``score``, are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import partitions, written
from tracemill.llm.terms import text_bytes, words

K = 20
SHARD_BYTES = 16 << 20
SHARD_DOCS = 1 << 16
PART_SHARDS = 8
BLOCK = 4096
STEP = 256
_NO_ID = np.iinfo(np.int64).max
_BITS = np.array([bin(x).count("1") for x in range(16)], np.int64)
POSTINGS = "shard long, doc_ids array<long>, lengths array<long>, terms array<string>, df array<long>, grid binary"
INDEX = "shard long, n_docs long, n_terms long, doc_ids array<long>, terms array<string>, df array<long>, top long, sizes array<long>, tree binary"
FOUND = "item_id long, doc_id long, score long"


class _Gather:
    """Documents of a shard on their way to a grid."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.lengths, self.tf, self.rows = 0, [], [], [], []
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)

    def add(self, doc_id: int | None, data: bytes | None) -> None:
        if found := words(data):
            counted = Counter(found)
            self.bytes += len(data)
            self.ids.append(doc_id)
            self.lengths.append(len(found))
            self.rows.append(np.fromiter(map(self.vocabulary.__getitem__, counted), np.int64, len(counted)))
            self.tf.append(np.fromiter(counted.values(), np.int64, len(counted)))

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def row(self, shard: int) -> pa.RecordBatch:
        """The grid with its rows and columns in order: row, column and frequency of each cell."""
        row, tf = np.concatenate(self.rows), np.concatenate(self.tf)
        frequency, terms = np.bincount(row), list(self.vocabulary)
        by_frequency, by_length = np.argsort(-frequency, kind="stable"), np.argsort(-np.array(self.lengths), kind="stable")
        place, column = np.argsort(by_frequency), np.repeat(np.argsort(by_length), [len(r) for r in self.rows])
        cells = np.stack([place[row], column, tf]).astype("<u4").tobytes()
        values = ([self.ids[i] for i in by_length], [self.lengths[i] for i in by_length], [terms[i] for i in by_frequency], frequency[by_frequency])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        lists = [pa.array([v], pa.list_(t)) for v, t in zip(values, kinds)]
        lists[2] = lists[2].cast(pa.list_(pa.string()))
        grid = pa.array([zstandard.ZstdCompressor(level=1).compress(cells)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *lists, grid], ["shard", "doc_ids", "lengths", "terms", "df", "grid"])


def postings(docs: DataFrame) -> DataFrame:
    """One row a shard: its documents, terms and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gather = TaskContext.get().partitionId() << 32, _Gather()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                gather.add(doc_id, data.as_py())
                if gather.full():
                    yield gather.row(shard)
                    shard, gather = shard + 1, _Gather()
        if gather.ids:
            yield gather.row(shard)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, POSTINGS)


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at even places of 64."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def tree(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, list[int], bytes]:
    """The quadtree of cells: its maximum, the number of nodes by level from the root down, and the nodes, compressed."""
    code = _spread_bits(row) << np.uint64(1) | _spread_bits(column)
    order = np.argsort(code)
    code, value, levels = code[order], value[order], []
    for _ in range(max(1, int(max(row.max(), column.max())).bit_length())):
        above, quadrant = code >> np.uint64(2), np.left_shift(1, (code & np.uint64(3)).astype(np.uint8), dtype=np.uint8)
        start = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        most, children = np.maximum.reduceat(value, start), np.diff(start, append=len(code))
        levels.append((np.bitwise_or.reduceat(quadrant, start), np.repeat(most, children) - value))
        code, value = above[start], most
    masks = np.concatenate([m for m, _ in reversed(levels)])
    falls = np.concatenate([f for _, f in reversed(levels)])
    nibbles = np.append(masks, np.zeros(len(masks) % 2, np.uint8)).reshape(-1, 2)
    raw = (nibbles[:, 0] << 4 | nibbles[:, 1]).astype(np.uint8).tobytes() + falls.astype("<u4").tobytes()
    return int(value[0]), [len(m) for m, _ in reversed(levels)], zstandard.ZstdCompressor(level=1).compress(raw)


class Treap:
    """A tree read back. ``masks[i]`` and ``first[i]`` are the nodes of level i from the root and where their children begin in the
    next level; ``most[i]`` are the maxima. The last entry of each stands for an empty node, which is number -1."""

    def __init__(self, top: int, sizes: list[int], packed: bytes):
        raw, n = zstandard.ZstdDecompressor().decompress(packed), sum(sizes)
        nibbles, falls = np.frombuffer(raw, np.uint8, -(-n // 2)), np.frombuffer(raw, "<u4", offset=-(-n // 2))
        every = np.stack([nibbles >> 4, nibbles & 15], 1).reshape(-1)[:n]
        self.masks, self.first, self.most, a, b = [], [], [np.array([top, 0], np.int64)], 0, 0
        for size in sizes:
            mask = every[a : a + size]
            children = _BITS[mask]
            total = int(children.sum())
            self.masks.append(np.append(mask, np.uint8(0)))
            self.first.append(np.append(np.cumsum(children) - children, 0))
            self.most.append(np.append(np.repeat(self.most[-1][:-1], children) - falls[b : b + total], 0))
            a, b = a + size, b + total

    def children(self, level: int, nodes: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        mask = self.masks[level][nodes]
        there = mask >> quadrant & 1
        return np.where(there, self.first[level][nodes] + _BITS[mask & ((1 << quadrant) - 1)], -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of ``best`` (scores, ids) and this grid's columns, by the weighted sum of the rows' values."""
        depth = len(self.masks)
        start = (np.array([int(weights.sum() * self.most[0][0])]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64))
        open_ranges: list[list[tuple]] = [[start]] + [[] for _ in range(depth - 1)]
        while True:
            least = best[0][-1] if len(best[0]) == k else 1
            highest = [max((int(x[0].max()) for x in level if len(x[0])), default=0) for level in open_ranges]
            level = max(range(depth), key=lambda i: (highest[i], i))
            if highest[level] < least:
                return best
            bound, column, nodes = (np.concatenate(x) for x in zip(*open_ranges[level])) if len(open_ranges[level]) > 1 else open_ranges[level][0]
            left = np.flatnonzero(bound >= least)
            if len(left) > STEP:
                left = left[np.argpartition(-bound[left], STEP)]
            rest = left[STEP:]
            open_ranges[level] = [(bound[rest], column[rest], nodes[rest])] if len(rest) else []
            column, nodes, bit = column[left[:STEP]], nodes[left[:STEP]], (rows >> (depth - 1 - level) & 1) << 1
            nodes = np.concatenate([self.children(level, nodes, bit), self.children(level, nodes, bit | 1)])
            bound, column = self.most[level + 1][nodes] @ weights, np.concatenate([column << 1, column << 1 | 1])
            kept = np.flatnonzero((bound >= least) & (bound > 0))
            bound, column = bound[kept], column[kept]
            if level + 1 < depth:
                if len(kept):
                    open_ranges[level + 1].append((bound, column, nodes[kept]))
            elif len(kept):
                score, found = np.append(best[0], bound), np.append(best[1], ids[column])
                order = np.lexsort((found, -score))[:k]
                best = score[order], found[order]


def build(docs: DataFrame) -> DataFrame:
    """The index: a written table with one row a shard."""
    grids = written(postings(docs))
    n, total = statistics(grids.select(F.size("doc_ids").alias("n_docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_terms")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column("lengths")[i].values.to_numpy()
                cells = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("grid")[i].as_py()), "<u4").reshape(3, -1).astype(np.int64)
                m = 100 - 25 + 25 * lengths * n // total
                top, sizes, packed = tree(cells[0], cells[1], 1_000_000_000 * cells[2] // (1000 * cells[2] + 12 * m[cells[1]]))
                made = {"n_docs": pa.array([len(lengths)], pa.int64()), "n_terms": pa.array([int(lengths.sum())], pa.int64()), "top": pa.array([top], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "tree": pa.array([packed], pa.binary())}
                made |= {c: batch.column(c).slice(i, 1) for c in ("shard", "doc_ids", "terms", "df")}
                yield pa.RecordBatch.from_pydict({f: made[f] for f in _INDEX_NAMES})

    return written(grids.mapInArrow(run, INDEX))


_INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]


def statistics(shards: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have."""
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return n, total


def asked_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t.decode(), n) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(words(data)).items()]
            columns = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["item_id", "term", "times"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).filter("item_id is not null").distinct()
    return texts.mapInArrow(run, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def weighted_items(index: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, terms, weights): an item's terms that any document holds, weighted by rarity and repeats."""
    n, _ = statistics(index)
    asked = asked_terms(items)
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1).cast("double"))) * F.col("times")
    found = asked.join(df, "term").select("item_id", F.struct("term", weight.alias("weight")).alias("t"))
    listed = found.groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents, ties by ascending doc_id."""
    spark = index.sparkSession
    wanted = written(weighted_items(index, items))
    parts, blocks = max(partitions(spark), -(-index.count() // PART_SHARDS)), max(1, -(-wanted.count() // BLOCK))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part, block = F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    grids = index.select(part, every(blocks, "block"), F.col("shard").alias("key"), "terms", F.col("doc_ids").alias("numbers"), "top", "sizes", "tree")
    asked = wanted.select(every(parts, "part"), block, F.col("item_id").alias("key"), "terms", F.col("weights").alias("numbers"))
    both = asked.unionByName(grids, allowMissingColumns=True).withColumn("grid", F.col("tree").isNotNull())
    dealt = both.repartition(parts * blocks, "part", "block").sortWithinPartitions("part", "block", "grid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if (at := (row["part"].as_py(), row["block"].as_py())) != task.at:
                    yield from task.found()
                    task = _Task(k, at)
                if row["grid"].as_py():
                    task.meet(row)
                else:
                    task.ask(row)
        yield from task.found()

    found = dealt.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


class _Task:
    """A block of items and their best documents so far."""

    def __init__(self, k: int, at: tuple[int, int] | None = None):
        self.k, self.at, self.vocabulary, self.items = k, at, {}, []
        self.best: list[tuple[np.ndarray, np.ndarray]] = []

    def ask(self, row: dict[str, pa.Scalar]) -> None:
        numbers = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in row["terms"].as_py()]
        self.items.append((row["key"].as_py(), np.array(numbers, np.int64), row["numbers"].values.to_numpy()))
        self.best.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))

    def meet(self, row: dict[str, pa.Scalar]) -> None:
        if not self.items:
            return
        treap = Treap(row["top"].as_py(), row["sizes"].as_py(), row["tree"].as_py())
        ids = row["numbers"].values.fill_null(_NO_ID).to_numpy()
        place = pc.index_in(pa.array(list(self.vocabulary), pa.string()), value_set=row["terms"].values.cast(pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        for i, (_, terms, weights) in enumerate(self.items):
            rows = place[terms]
            if (held := rows >= 0).any():
                self.best[i] = treap.best(rows[held], weights[held], ids, self.best[i], self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        rows = [(item[0], None if d == _NO_ID else d, s) for item, best in zip(self.items, self.best) for s, d in zip(best[0].tolist(), best[1].tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])
