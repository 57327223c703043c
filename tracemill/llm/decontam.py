"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and items are lowered, white space becomes single spaces, and both are compared as UTF-8 bytes. A document holds an
item of m bytes if one of its substrings is within ``budget(m)`` edits of it. An occurrence with e edits keeps at least
m - q + 1 - q * e of the item's q-grams, on diagonals that lie within e of each other: hits are counted in overlapping
diagonal bands of 2 (e + 1), one every e + 1, so one band holds them all. Bands that reach the bound are verified by an
alignment within the band.

Scale: one pass over the documents, no shuffle and no join. The index of the items goes with the tasks in shards of at
most ``SHARD`` bytes of item text (or one longer item). More items mean more shards, each with a pass of its own that is
run and written before the next shard is fetched, so neither the driver nor a plan ever holds two of them.

Defined cases: null and empty texts hold nothing; null or empty items are not looked for; items of under q bytes, and the
part of the budget that would make the bound less than one, are exact; the same text under two item_ids gives both; repeated
rows are reported each; empty tables give empty results; ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import text_bytes, written

Q = 8
RATE = 0.1
SHARD = 1 << 20
FOUND = "doc_id long, item_id long, edits int, start long, end long"
_STEP = 1 << 18
_BITS = 20
_RUN = 8
_CELLS = 1 << 18
_FAR = 1 << 28
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits that an item of m bytes may have: the rate, or what leaves the lemma's bound at one or more."""
    return max(0, min(int(m * rate), (m - q) // q))


def _codes(data: np.ndarray, q: int) -> np.ndarray:
    """Each q-gram as a number; q is at most 8."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (max(0, len(data) - q + 1), 8), (1, 1))
    return np.ascontiguousarray(eight).view("<u8").reshape(-1) & np.uint64((1 << 8 * q) - 1)


class Index:
    """q-grams of a shard's items, with their places."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = RATE):
        self.q, self.items = q, items
        self.budget = np.array([budget(len(x), q, rate) for _, x in items], np.int64)
        self.need = np.array([len(x) - q + 1 - q * e for (_, x), e in zip(items, self.budget)], np.int64)
        codes = [_codes(np.frombuffer(x, np.uint8), q) for _, x in items]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.times = np.unique(code[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.keys)] = True
        self.short = [i for i, (_, x) in enumerate(items) if len(x) < q]
        self.reach = max((len(x) for _, x in items), default=0)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in data, items and places in them that share a q-gram."""
        codes = _codes(data, self.q)
        at = np.flatnonzero(self.maybe[self._slot(codes)])
        k = np.searchsorted(self.keys, codes[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == codes[at] if len(self.keys) else np.zeros(len(at), bool)
        at, k = at[same], k[same]
        times = self.times[k]
        posting = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - self.first[k], times)
        return np.repeat(at, times), self.item[posting], self.place[posting]

    def regions(self, data: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Rows (piece, item, lowest and highest diagonal) of the bands that reach the bound; bands that overlap are one
        region, up to ``_RUN`` bands. piece: of each byte. A band counts each q-gram of the item once, however often the
        text repeats it."""
        at, item, place = self.hits(data)
        band = (at - place + self.reach) // (self.budget[item] + 1)
        key = (piece[at].astype(np.int64) * max(1, len(self.items)) + item) << 32
        lower = np.flatnonzero(band > 0)
        key, place = np.concatenate([key | band, (key | band)[lower] - 1]), np.concatenate([place, place[lower]])
        keys, of, n = np.unique(key, return_inverse=True, return_counts=True)
        item_of = lambda k: (k >> 32) % max(1, len(self.items))
        many = (n >= self.need[item_of(keys)])[of]
        of, place = of[many], place[many]
        of, place = of[order := np.lexsort((place, of))], place[order]
        once = np.ones(len(of), bool)
        once[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
        good = keys[np.bincount(of[once], minlength=len(keys)) >= self.need[item_of(keys)]] if len(keys) else keys
        if not len(good):
            return np.zeros((0, 4), np.int64)
        run = np.concatenate([[0], np.cumsum(good[1:] != good[:-1] + 1)])
        first = np.flatnonzero(np.diff(run, prepend=-1))
        inside = np.arange(len(good)) - first[run]
        first = np.flatnonzero(inside % _RUN == 0)
        last = np.append(first[1:], len(good)) - 1
        i, low, high = item_of(good[first]), good[first] & 0xFFFFFFFF, good[last] & 0xFFFFFFFF
        step = self.budget[i] + 1
        return np.stack([(good[first] >> 32) // len(self.items), i, low * step - self.reach, (high + 2) * step - 1 - self.reach], 1)


def _band(text: bytes, low: int, size: int) -> np.ndarray:
    """text[low : low + size], 256 outside of it."""
    data = np.full(size, 256, np.int32)
    a, b = max(0, low), min(len(text), low + size)
    if b > a:
        data[a - low : b - low] = np.frombuffer(text, np.uint8, b - a, a)
    return data


def least_edits(items: list[bytes], texts: list[bytes], low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each item its least edits to a substring of its text between the diagonals low and high; over ``most`` where
    there is none within it. One banded alignment for all: rows are the items' bytes, a row holds every band's columns."""
    m = np.array([len(x) for x in items])
    order = np.argsort(-m, kind="stable")
    width = int((high - low + 1 + 2 * most).max())
    kind, far = (np.int16, np.int16(1 << 13)) if width < 1 << 12 else (np.int32, np.int32(_FAR))
    low = low - most
    data = np.stack([_band(texts[j], int(low[j]), width + int(m.max())) for j in order]).astype(kind)
    pattern = np.zeros((len(items), int(m.max())), kind)
    for r, j in enumerate(order):
        pattern[r, : m[j]] = np.frombuffer(items[j], np.uint8)
    out = most + 1
    ramp = np.arange(width + 1, dtype=kind)
    column = low[order][:, None] + ramp  # cell k of row i ends before text position low + i + k
    cost = np.where((column >= 0) & (column <= np.array([len(texts[j]) for j in order])[:, None]), 0, far).astype(kind)
    outside = np.where(data > 255, far, 0).astype(kind)
    size, limit = m[order], most[order]
    for i in range(int(m.max())):
        while len(order) and size[-1] == i:  # the shortest items end first
            out[order[-1]] = min(int(cost[-1].min()), int(limit[-1]) + 1)
            order, size, limit, cost, data, pattern, outside = (x[:-1] for x in (order, size, limit, cost, data, pattern, outside))
        if i % 8 == 0 and not (alive := cost.min(1) <= limit).all():
            order, size, limit, cost, data, pattern, outside = (x[alive] for x in (order, size, limit, cost, data, pattern, outside))
        if not len(order):
            return out
        best = np.full_like(cost, far)
        np.add(cost[:, :-1], data[:, i : i + width] != pattern[:, i : i + 1], out=best[:, :-1])
        best[:, :-1] += outside[:, i : i + width]
        np.minimum(best[:, :-1], cost[:, 1:] + kind(1), out=best[:, :-1])  # the item's byte has no partner
        best -= ramp
        cost = np.minimum(np.minimum.accumulate(best, axis=1) + ramp, far)  # text bytes without partner, from the left
    for r, j in enumerate(order):
        out[j] = min(int(cost[r].min()), int(limit[r]) + 1)
    return out


def align(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int]:
    """Least edits, with where they start and end, of a pair that ``least_edits`` has found to be within ``most``."""
    width, m = high - low + 1 + 2 * most, len(item)
    low -= most
    data = _band(text, low, width + m)
    ramp = np.arange(width + 1)
    origin = low + ramp
    cost = np.where((origin >= 0) & (origin <= len(text)), 0, _FAR)
    for i, byte in enumerate(item):
        piece = data[i : i + width]
        take, over = cost[:-1] + (piece != byte) + np.where(piece > 255, _FAR, 0), cost[1:] + 1
        best, start = np.append(np.minimum(take, over), _FAR), np.append(np.where(take <= over, origin[:-1], origin[1:]), 0)
        k = np.minimum.accumulate((best - ramp) * (width + 2) + ramp) % (width + 2)
        cost, origin = np.minimum(best[k] + ramp - k, _FAR), start[k]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), int(low + m + end)


def _verified(index: Index, regions: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, int] | None]:
    """Of each region (text, item, low, high) the least edits, start and end, or None."""
    low, high = np.array([r[2] for r in regions]), np.array([r[3] for r in regions])
    most = index.budget[[r[1] for r in regions]]
    items = [index.items[r[1]][1] for r in regions]
    order = np.lexsort(([len(x) for x in items], high - low))
    found = np.zeros(len(regions), np.int64)
    at = 0
    while at < len(order):
        cells = (high - low + 1 + 2 * most)[order[at:]].cumsum() + np.array([len(items[j]) for j in order[at:]]).cumsum()
        chosen = order[at : at + max(1, int(np.searchsorted(cells, _CELLS)))]
        found[chosen] = least_edits([items[j] for j in chosen], [regions[j][0] for j in chosen], low[chosen], high[chosen], most[chosen])
        at += len(chosen)
    for j, (text, _, a, b) in enumerate(regions):
        yield align(items[j], text, a, b, int(most[j])) if found[j] <= most[j] else None


def search(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end): for each text and item that it holds, the best place (fewest edits, then first)."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(k: int, i: int, found: tuple[int, int, int] | None) -> None:
        if found and found < best.get((k, i), (1 << 30,)):
            best[k, i] = found

    def some(group: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"\0".join(p for _, _, p in group), np.uint8)
        size = np.array([len(p) for _, _, p in group]) + 1
        base = np.cumsum(size) - size
        doubtful = []
        for j, i, low, high in index.regions(data, np.repeat(np.arange(len(group)), size)).tolist():
            k, at, text = group[j]
            item, most = index.items[i][1], int(index.budget[i])
            low, high = low - int(base[j]), high - int(base[j])
            a = max(0, low - most)
            found = text.find(item, a, max(a, high + most + len(item)))
            if found >= 0:
                keep(k, i, (0, at + found, at + found + len(item)))
            elif most:
                doubtful.append((k, at, (text, i, low, high)))
        for (k, at, region), got in zip(doubtful, _verified(index, [r for *_, r in doubtful])):
            keep(k, region[1], got and (got[0], at + got[1], at + got[2]))

    group: list[tuple[int, int, bytes]] = []
    held = 0
    for k, text in enumerate(texts):
        for i in index.short:
            if (at := text.find(index.items[i][1])) >= 0:
                keep(k, i, (0, at, at + len(index.items[i][1])))
        for at in range(0, max(1, len(text)), _STEP):
            part = text[at : at + _STEP + 2 * index.reach]
            if held + len(part) > 2 * _STEP and group:
                some(group)
                group, held = [], 0
            group.append((k, at, part))
            held += len(part) + 1
    if group:
        some(group)
    for (k, i), (edits, start, end) in sorted(best.items()):
        yield k, i, edits, start, end


def shards(benchmark: DataFrame, q: int = Q, rate: float = RATE) -> Iterator[Index]:
    """Indexes of the items, one shard at a time."""
    items, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").toLocalIterator():
        if item := normal(text):
            if items and size + len(item) > SHARD:
                yield Index(items, q, rate)
                items, size = [], 0
            items.append((item_id, item))
            size += len(item)
    if items:
        yield Index(items, q, rate)


def _done(benchmark: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Writes a pass where there are more; a single one stays a part of its caller's plan."""
    return written if text_bytes(benchmark) > SHARD else lambda df: df


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, start, end (bytes of the normal text): one row for each document and item it holds."""

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], index.items[i][0], e, a, b) for k, i, e, a, b in search(index, [normal(x.as_py()) for x in batch.column(1)])]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "edits", "start", "end"])

        return run

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    done = _done(benchmark)
    for index in shards(benchmark, q, rate):
        out = out.union(done(asked.mapInArrow(finder(index), FOUND)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item."""

    def sieve(index: Index, text: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {k for k, *_ in search(index, [normal(x.as_py()) for x in batch.column(text)])}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)]))

        return run

    done = _done(benchmark)
    for index in shards(benchmark, q, rate):
        docs = done(docs.mapInArrow(sieve(index, docs.columns.index("text")), docs.schema))
    return docs
