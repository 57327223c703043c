"""Substring dedup over words with prefix-partitioned suffix trees.

Every run of ``window`` words is the label of a path of that depth in the suffix tree of the corpus; a run repeats where an
internal node lies at that depth or deeper. The tree is never built whole. Suffixes travel in blocks that share an anchor, a
gram of ``GRAM`` words (see ``anchors``), and a block goes to the group of its anchor's prefix: of 1, 2, 4 or 8 words, the
shortest whose group fits in memory (counted over all documents first); where none does, of the whole gram. In a group all
suffixes of its blocks are sorted by their bytes, and the depth to which neighbours agree gives its subtree's internal nodes;
those as deep as the window are its repeats. The leaves of a node are the places of one repeat; all but the first, in (doc_id,
start) order, are later copies. Their words go.

Equality is that of bytes; only blocks that are equal as a whole, and the windows of hot grams, are known by 128-bit hashes.
Prefixes are counted in 4 tables of ``_BINS`` bins: from about 1,000 groups on (36 GiB of text), all bins are full and the
whole gram decides.

Defined cases: null and empty texts have no words and keep an empty text; texts of fewer words than the window keep all; a
repeat inside one document counts; repeated doc_ids are ordered by their texts, and the later row is a copy of the earlier;
doc_id null is smallest; an empty table gives an empty table; other columns are ignored; a very long text is one row, and its
task needs about ten times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import anchors as A
from tracemill.llm import exchange as X
from tracemill.llm import hashing as H
from tracemill.llm.common import text_bytes

WINDOW = 20
GRAM = 8
PREFIXES = (1, 2, 4, 8)
PART_BYTES = 6 << 20
_BINS = 4096
KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


class _Words:
    """The words of some documents, joined by one space: their places, hashes, and where each document's stop."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        start, end, self.hash = H.word_hashes(data)
        self.stops = np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]), "left")
        # each word with the one separator byte behind it
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] += 1
        edge[end + 1] -= 1
        kept = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        self.end = np.cumsum(end - start + 1) - 1
        self.start = self.end - (end - start)
        kept[self.end] = 0x20
        self.data = kept
        self.sums = H.prefix(self.hash)

    def bins(self, words: int, at: np.ndarray) -> np.ndarray:
        """The bins of the ``words`` words from each place."""
        return (H.ranges(self.sums, at, at + words) % np.uint64(_BINS)).astype(np.int64)


def _usable(gram: int) -> list[int]:
    return [p for p in PREFIXES if p <= gram]


def full_prefixes(docs: DataFrame, window: int, gram: int, limit: int) -> dict[int, np.ndarray]:
    """By prefix length, the bins that hold more than ``limit`` suffixes; counted over all documents."""
    levels = _usable(gram)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(levels), _BINS), np.int64)
        for batch in batches:
            texts, group, size = [x for x in batch.column(0).to_pylist() if x], [], 0
            for i, x in enumerate(texts):
                group, size = [*group, x], size + len(x)
                if size >= 1 << 19 or i + 1 == len(texts):
                    own = _Words(group)
                    at = np.arange(max(0, len(own.hash) - window + 1))
                    for k, words in enumerate(levels):
                        total[k] += np.bincount(own.bins(words, at), minlength=_BINS)
                    group, size = [], 0
        level, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"level": pa.array(level, pa.int32()), "bin": pa.array(bin_, pa.int32()), "n": pa.array(total[level, bin_], pa.int64())})

    counted = docs.select(F.encode(F.col("text").cast("string"), "UTF-8").alias("data")).mapInArrow(count, "level int, bin int, n long")
    out = {words: np.zeros(_BINS, bool) for words in levels}
    for level, bin_ in counted.groupBy("level", "bin").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).select("level", "bin").collect():
        out[levels[level]][bin_] = True
    return out


def group_of(words: _Words, at: np.ndarray, gram: np.ndarray, full: dict[int, np.ndarray], parts: int) -> np.ndarray:
    """The group of each anchor: by its shortest prefix whose bin isn't full, else by the whole gram."""
    out = (gram >> np.uint64(20)) % np.uint64(parts)
    todo = np.arange(len(at))
    for n, over in full.items():
        bins = words.bins(n, at[todo])
        here = ~over[bins]
        out[todo[here]] = H.mix((bins[here] * 64 + n).astype(np.uint64)) % np.uint64(parts)
        todo = todo[~here]
    return out.astype(np.int64)


def exchange(full: dict[int, np.ndarray], parts: int, window: int = WINDOW, gram: int = GRAM, hot: int = A.HOT) -> A.Repeats:
    """The steps on batches and groups, as functions of their rows."""

    def made(table: pa.Table) -> tuple[A.Blocks, np.ndarray]:
        rows = X.rows_of(table)
        words = _Words([r[1] or b"" for r in rows])
        blocks = A.Blocks(words.data, lambda a, b: words.hash[a:b], words.stops, window, gram, (words.start, words.end))
        blocks.own = words
        ids = np.array([X.NO_ID if r[0] is None else r[0] for r in rows], np.int64)
        return blocks, ids[blocks.doc]

    def part(blocks: A.Blocks, of: np.ndarray) -> np.ndarray:
        return group_of(blocks.own, blocks.anchor[of], blocks.gram[of], full, parts)

    def window_bytes(data: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = data == 0x20
        first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
        first[1:], last[:-1] = gap[:-1], gap[1:]
        stop = np.cumsum(size)
        first[stop - size] = last[stop - 1] = True
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = n + window - 1
        at = A.spans(np.cumsum(words) - words, n)
        return start[at], end[at + window - 1] - start[at]

    def finish(table: pa.Table, blocks: A.Blocks, copies: np.ndarray) -> pa.Table:
        words, n = blocks.own, len(blocks.own.start)
        keep = np.cumsum(np.bincount(copies, minlength=n + 1) - np.bincount(copies + window, minlength=n + 1))[:-1] == 0
        size = words.end - words.start + 1
        out = words.data[np.repeat(keep, size)].tobytes()
        at = np.concatenate([[0], np.cumsum(np.where(keep, size, 0))])
        left = np.concatenate([[0], np.cumsum(keep)])
        stops = np.concatenate([[0], words.stops])
        texts = [out[a : max(a, b - 1)] for a, b in zip(at[stops[:-1]].tolist(), at[stops[1:]].tolist())]
        n_words, kept = np.diff(stops), np.diff(left[stops])
        ids = [r[0] for r in X.rows_of(table)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - kept, pa.int64()), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    return A.Repeats(made, part, window_bytes, finish, parts, True, hot)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    gram = min(gram, window)
    if window < 5:
        raise ValueError("runs of at least 5 words are looked for")
    total = text_bytes(docs)
    parts = X.part_count(docs, total, PART_BYTES, 2)
    full = full_prefixes(docs, window, gram, max(1, total // 6 // parts // 4))
    return exchange(full, parts, window, gram, hot).run(X.batched(docs, X.batch_count(docs, total)), KEPT)
