"""Exact repeats of windows (runs of bytes or of words), settled in blocks that share an anchor.

To sort each suffix of 100 TB by itself would write the input hundreds of times. The anchor of a window is the leftmost
least-hashed gram in it, and a block is a run of windows of one document with one anchor. Equal windows have equal anchors at
the same distance, so they lie in blocks of one gram, and a block goes where its anchor's leading symbols send it:

1. a batch of documents sends the distinct texts of its blocks as 128-bit hashes, dealt by that hash, and of each gram the
   smallest ``LEAST`` hashes of its texts, dealt by gram; parts answer for each text whether other batches have it and whether
   this batch owns it, and for each gram whether it has more than one text, and more than ``HOT``;
2. texts that their batch owns, of grams with more than one text, are sent as bytes, once each; a part brings all their windows
   into the order of their bytes and measures how far neighbours agree. Neighbours that agree over a whole window are an
   internal node as deep as a window, or deeper, of the suffix tree, and its leaves the places of one repeat. A bit for each
   window goes back to its batch.

A gram with over ``HOT`` texts (the edges of a passage that very many documents share) is no group of its own in any step: what
is gathered of it in the first is ``LEAST`` numbers a batch, and its windows go one by one, by a 128-bit hash of the window, to
parts of their own. (How many texts a gram has is estimated from the smallest hashes from ``LEAST`` on; results don't depend on
it.) Every step is a pure function of its rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import exchange as X
from tracemill.llm import hashing as H

HOT = 4096
LEAST = 8
_STEP = 1 << 18
_LOW = np.uint64((1 << 21) - 1)


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of byte ranges: shape (n, 2)."""
    from xxhash import xxh3_128_digest

    view = memoryview(data)
    out = b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(out, "<u8").reshape(-1, 2)


class Blocks:
    """The blocks of the documents of a batch.

    ``data`` is canonical text; its symbols are its bytes or, with ``words``, the byte ranges given by their begins and
    ends. ``hashes(a, b)`` are the hashes of symbols a to b, ``stops`` where each document's symbols stop. Windows are
    numbered by their first symbol."""

    def __init__(self, data: np.ndarray, hashes: Callable[[int, int], np.ndarray], stops: np.ndarray, window: int, gram: int, words: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.words, self.window = data, words, window
        n = len(words[0]) if words else len(data)
        found = [self._some(hashes, stops, a, min(n, a + _STEP + window - 1), window, gram) for a in range(0, max(0, n - window + 1), _STEP)]
        self.first, self.last, self.anchor, self.gram = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4))
        self.gram = self.gram.astype(np.uint64)
        self.doc = np.searchsorted(stops, self.first, "right")
        raw = data.tobytes()
        low, high = self.ranges(self.first, self.last + window)
        self.text = digests(raw, low, high)
        # distinct texts, by gram and then by first place
        order = np.lexsort((self.first, self.text[:, 1], self.text[:, 0], self.gram))
        new = np.ones(len(order), bool)
        new[1:] = (self.gram[order][1:] != self.gram[order][:-1]) | (self.text[order][1:] != self.text[order][:-1]).any(1)
        self.of = np.empty(len(order), np.int64)  # of each block its text
        self.of[order] = np.cumsum(new) - 1
        self.texts = order[new]  # of each text its first block
        self.times = np.bincount(self.of, minlength=len(self.texts))

    @staticmethod
    def _some(hashes: Callable[[int, int], np.ndarray], stops: np.ndarray, a: int, b: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
        i, j = np.searchsorted(stops, [a, b - 1], "right")
        own = np.repeat(np.arange(i, j + 1), np.diff(np.minimum(stops[i : j + 1], b), prepend=a))
        grams = H.windows(H.prefix(hashes(a, b)), gram)
        least = H.sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        at = np.flatnonzero(own[: len(least)] == own[window - 1 : window - 1 + len(least)])
        anchor = (least[at] & _LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[at[1:]] != own[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        return at[first] + a, at[last] + a, anchor[first] + a, grams[anchor[first]]

    def ranges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of the symbols from a to b."""
        return (self.words[0][a], self.words[1][b - 1]) if self.words else (a, b)

    def lead(self, blocks: np.ndarray) -> np.ndarray:
        """The leading eight bytes of the blocks' anchors, as numbers in the order of bytes."""
        return words8(self.data, self.ranges(self.anchor[blocks], self.anchor[blocks] + 1)[0]).byteswap()

    def size(self, blocks: np.ndarray) -> np.ndarray:
        """Windows of each block."""
        return self.last[blocks] - self.first[blocks] + 1

    def windows(self, blocks: np.ndarray) -> np.ndarray:
        """First symbols of the blocks' windows, block by block."""
        return spans(self.first[blocks], self.size(blocks))


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each span, one after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def words8(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as numbers; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[at]).view("<u8").reshape(-1)


def multikey(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of strings given symbol by symbol, and the run of equal strings each place is in. Each
    symbol sorts only the runs that the ones before it left equal."""
    order = np.arange(len(symbols[0]))
    run = np.zeros(len(order), np.int64)
    for symbol in symbols:
        size = np.bincount(run) if len(run) else run
        open_ = np.flatnonzero(size[run] > 1)
        own = order[open_]
        order[open_] = own = own[np.lexsort((symbol[own], run[open_]))]
        new = np.zeros(len(order), bool)
        new[1:] = run[1:] != run[:-1]
        apart = np.zeros(len(open_), bool)
        apart[1:] = symbol[own][1:] != symbol[own][:-1]
        new[open_] |= apart
        run = np.cumsum(new)
    return order, run


def agreement(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many bytes data[a : a + size] and data[b : b + size] have in common from their beginnings on, for each pair."""
    out = size.copy()
    live, step = np.arange(len(a)), 0
    while len(live):
        apart = words8(data, a[live] + step) ^ words8(data, b[live] + step)
        low = apart & (~apart + np.uint64(1))  # the lowest bit that differs is in the first byte that does
        first = np.where(apart == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[live] = np.minimum(size[live], step + first)
        live = live[(apart == 0) & (size[live] > step + 8)]
        step += 8
    return out


def in_order(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of different strings data[start : start + size] by their bytes, by multikey quicksort with symbols of eight
    bytes; a string comes before those that it begins."""
    order = np.arange(len(start))
    run, step = np.zeros(len(order), np.int64), 0
    open_ = np.arange(len(order) if len(order) > 1 else 0)
    while len(open_):
        own = order[open_]
        left = size[own] - step
        symbol = words8(data, start[own] + np.minimum(step, size[own])).byteswap()
        symbol &= np.where(left >= 8, ~np.uint64(0), ~(~np.uint64(0) >> (8 * np.clip(left, 0, 7)).astype(np.uint64)))
        by = np.lexsort((np.minimum(left, 8), symbol, run[open_]))
        order[open_], symbol, left = own[by], symbol[by], np.minimum(left[by], 8)
        new = np.zeros(len(order), bool)
        new[1:] = run[1:] != run[:-1]
        apart = np.zeros(len(open_), bool)
        apart[1:] = (symbol[1:] != symbol[:-1]) | (left[1:] != left[:-1])
        new[open_] |= apart
        run = np.cumsum(new)
        step += 8
        many = np.bincount(run)[run[open_]] > 1
        open_ = open_[many & (left >= 8)]
    return order


def nodes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows data[start : start + size] in the order of their bytes; of each place in that order its node: windows of one
    node are equal, byte by byte, and those of different nodes aren't; and of each two neighbouring nodes how many bytes
    they agree in: the depth of the inner node of the tree that parts them.

    Windows of one hash and one size are brought together first; where neighbours among them aren't equal, which takes a
    collision, the bytes alone part them. The order is then made of one window of each node."""
    hashed = H.range_hashes(data, start, start + size)
    order = np.lexsort((size, hashed))
    new = np.ones(len(order), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (size[order][1:] != size[order][:-1])
    pair = np.flatnonzero(~new[1:])
    a, b = order[:-1][pair], order[1:][pair]
    if (agreement(data, start[a], start[b], size[a]) < size[a]).any():
        raw, known = data.tobytes(), {}
        of = np.array([known.setdefault(raw[i : i + n], len(known)) for i, n in zip(start.tolist(), size.tolist())], np.int64)
        order = np.argsort(of, kind="stable")
        new = np.append(True, of[order][1:] != of[order][:-1])[: len(order)]
    heads = order[new]
    place = np.empty(len(heads), np.int64)
    sorted_heads = in_order(data, start[heads], size[heads])
    place[sorted_heads] = np.arange(len(heads))
    node = place[np.cumsum(new) - 1]
    by = np.argsort(node, kind="stable")
    heads = heads[sorted_heads]
    common = agreement(data, start[heads[:-1]], start[heads[1:]], np.minimum(size[heads[:-1]], size[heads[1:]]))
    return order[by], node[by], common


def maximal_repeats(data: bytes, window: int) -> set[tuple[bytes, tuple[int, ...]]]:
    """The maximal repeats of at least ``window`` bytes of a small text with all their places: inner nodes of the suffix tree that
    deep, whose leaves don't all follow the same byte. For looking at what the groups find, not for their work."""
    buffer = np.frombuffer(data, np.uint8)
    start = np.arange(len(buffer))
    order = in_order(buffer, start, len(buffer) - start)
    depth = agreement(buffer, order[:-1], order[1:], len(buffer) - np.maximum(order[:-1], order[1:]))
    out, open_ = set(), []  # open nodes: depth, and where their leaves begin in the order
    for i, d in enumerate([*depth.tolist(), 0]):
        first = i
        while open_ and open_[-1][0] > d:
            deep, first = open_.pop()
            places = sorted(order[first : i + 1].tolist())
            if len({data[p - 1 : p] for p in places}) > 1 or places[0] == 0:
                out.add((data[places[0] : places[0] + deep], tuple(places)))
        if d >= window and (not open_ or open_[-1][0] < d):
            open_.append((d, first))
    return out


def settled(order: np.ndarray, run: np.ndarray, doc: np.ndarray | None, place: np.ndarray | None) -> np.ndarray:
    """Of each window whether its node has other leaves; with doc and place, whether a leaf before it in that order."""
    size = np.bincount(run) if len(run) else run
    many = size[run] > 1
    out = np.zeros(len(order), bool)
    if doc is None:
        out[order[many]] = True
        return out
    own, of = order[many], run[many]
    by = np.lexsort((place[own], doc[own], of))
    later = np.zeros(len(own), bool)
    later[1:] = of[by][1:] == of[by][:-1]
    out[own[by]] = later
    return out


def _both(first: pa.Table, second: pa.Table, name: str) -> pa.Table:
    """The bytes of two tables (batch, part, bytes) in one row a batch and part."""
    one, two = ({(b, p): x for b, p, x in zip(*(c.to_pylist() for c in t.columns))} for t in (first, second))
    keys = sorted(one.keys() | two.keys())
    data = [struct.pack("<I", len(x := one.get(k, b""))) + x + two.get(k, b"") for k in keys]
    return pa.table([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(data, pa.binary())], ["batch", "part", name])


def _parted(data: bytes) -> tuple[bytes, bytes]:
    n = struct.unpack_from("<I", data)[0]
    return data[4 : 4 + n], data[4 + n :]


class Repeats:
    """The exchange. ``made`` turns a batch's table into its Blocks and the doc_id of each block; ``part`` gives the parts of
    blocks; ``window_bytes(data, sizes, numbers of windows)`` gives the starts and sizes of the windows of the texts that
    data joins; ``finish(table, blocks, first symbols)`` makes a batch's result. With ``later``, windows count that occur
    before, by (doc_id, place); else windows that occur elsewhere."""

    def __init__(self, made: Callable, part: Callable, window_bytes: Callable, finish: Callable, parts: int, later: bool, hot: int):
        self.made, self.part, self.window_bytes, self.finish = made, part, window_bytes, finish
        self.parts, self.later, self.hot = parts, later, hot

    def text_parts(self, blocks: Blocks) -> np.ndarray:
        return (blocks.text[blocks.texts, 0] % np.uint64(self.parts)).astype(np.int64)

    def grams(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's grams, where their texts begin, how many they are, and the grams' parts."""
        gram, first, n = np.unique(blocks.gram[blocks.texts], return_index=True, return_counts=True)  # texts are in the order of grams
        return gram, first, n, (H.mix(gram.copy()) % np.uint64(self.parts)).astype(np.int64)

    def ask_texts(self, batch: int, table: pa.Table) -> pa.Table:
        blocks, ids = self.made(table)
        gram, begin, n, gram_part = self.grams(blocks)

        def texts(i: np.ndarray) -> bytes:
            first = blocks.texts[i]
            docs = ids[first].astype("<i8").tobytes() if self.later else b""
            return struct.pack("<I", len(i)) + np.packbits(blocks.times[i] > 1).tobytes() + blocks.text[first].astype("<u8").tobytes() + docs

        def least(i: np.ndarray) -> bytes:
            few = np.minimum(n[i], LEAST)
            hashes = blocks.text[blocks.texts[spans(begin[i], few)], 0]  # the texts of a gram are in the order of their hashes
            return struct.pack("<I", len(i)) + few.astype("u1").tobytes() + gram[i].astype("<u8").tobytes() + hashes.astype("<u8").tobytes()

        return _both(X.send(batch, self.text_parts(blocks), texts), X.send(batch, gram_part, least), "payload")

    def answer_texts(self, table: pa.Table) -> pa.Table:
        first, second = (table.set_column(2, "payload", pa.array(x, pa.binary())) for x in zip(*map(_parted, table.column("payload").to_pylist())))
        return _both(self.answer_owners(first), self.answer_grams(second), "codes")

    def answer_owners(self, table: pa.Table) -> pa.Table:
        """Two bits for each text: repeated, owned."""
        texts, more, docs, counts = [], [], [], []
        for x in table.column("payload"):
            x = x.as_buffer()
            n = struct.unpack_from("<I", x)[0] if len(x) else 0
            at = min(len(x), 4) - (-n // 8)
            more.append(np.unpackbits(np.frombuffer(x, np.uint8, -(-n // 8), min(len(x), 4)))[:n])
            texts.append(np.frombuffer(x, "<u8", 2 * n, at).reshape(-1, 2))
            docs.append(np.frombuffer(x, "<i8", n, at + 16 * n) if self.later else np.zeros(0, np.int64))
            counts.append(n)
        text, more = np.concatenate(texts), np.concatenate(more).astype(bool)
        owner = np.concatenate(docs) if self.later else np.repeat(table.column("batch").to_numpy(), counts)
        order = np.lexsort((owner, text[:, 1], text[:, 0]))
        t = text[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]).any(1)
        which = np.cumsum(new) - 1
        planes = np.zeros((2, len(order)), bool)
        planes[:, order] = (np.bincount(which)[which] > 1) | more[order], new
        return X.answer(table, counts, *planes)

    def answer_grams(self, table: pa.Table) -> pa.Table:
        """Two bits for each gram: of several texts, of more than are kept together."""
        grams, few, hashes, counts = [], [], [], []
        for x in table.column("payload"):
            x = x.as_buffer()
            if not len(x):
                counts.append(0)
                continue
            n = struct.unpack_from("<I", x)[0]
            few.append(np.frombuffer(x, "u1", n, 4))
            grams.append(np.frombuffer(x, "<u8", n, 4 + n))
            hashes.append(np.frombuffer(x, "<u8", int(few[-1].sum()), 4 + 9 * n))
            counts.append(n)
        none = np.zeros(0, np.uint64)
        gram, few, hashed = np.concatenate([none, *grams]), np.concatenate([none, *few]).astype(np.int64), np.concatenate([none, *hashes])
        known, of = np.unique(gram, return_inverse=True)
        own = np.repeat(of, few)
        order = np.lexsort((hashed, own))
        own, hashed = own[order], hashed[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]) | (hashed[1:] != hashed[:-1])
        own, hashed = own[new], hashed[new]
        n = np.bincount(own, minlength=len(known))
        texts = n.astype(np.float64)  # all of them where they are few
        many = np.flatnonzero(n >= LEAST)
        nth = hashed[(np.cumsum(n) - n)[many] + LEAST - 1].astype(np.float64) / 2.0**64
        texts[many] = np.maximum(LEAST, (LEAST - 1) / np.maximum(nth, 2.0**-64))
        return X.answer(table, counts, n[of] > 1, texts[of] > self.hot)

    def routed(self, blocks: Blocks, codes: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """The answers (repeated, owned) by text, the blocks to send, and which of them are hot."""
        told = {p: _parted(c) for p, c in codes.items()}
        repeated, owned = X.answers({p: c[0] for p, c in told.items()}, self.text_parts(blocks), 2)
        _, _, n, gram_part = self.grams(blocks)
        mixed, hot = np.repeat(X.answers({p: c[1] for p, c in told.items()}, gram_part, 2), n, axis=1)
        asked = owned & mixed
        return repeated, owned, asked, hot[asked]

    def parts_of(self, blocks: Blocks, sent: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each window that is sent, and the hashes of hot ones."""
        size = blocks.size(sent)
        part = np.repeat(self.part(blocks, sent), size)
        at = np.repeat(hot, size)
        first = blocks.windows(sent)[at]
        label = digests(blocks.data.tobytes(), *blocks.ranges(first, first + blocks.window)) if len(first) else np.zeros((0, 2), np.uint64)
        part[at] = self.parts + (label[:, 0] % np.uint64(self.parts)).astype(np.int64)
        return part, label

    def ask_windows(self, batch: int, table: pa.Table, codes: dict[int, bytes]) -> pa.Table:
        blocks, ids = self.made(table)
        *_, asked, hot = self.routed(blocks, codes)
        sent = blocks.texts[asked]
        part, label = self.parts_of(blocks, sent, hot)
        cold = sent[~hot]
        raw = blocks.data.tobytes()

        def texts(i: np.ndarray) -> bytes:
            own = cold[i]
            low, high = blocks.ranges(blocks.first[own], blocks.last[own] + blocks.window)
            where = ids[own].astype("<i8").tobytes() + blocks.first[own].astype("<i8").tobytes() if self.later else b""
            return struct.pack("<I", len(i)) + (high - low).astype("<u4").tobytes() + blocks.size(own).astype("<u4").tobytes() + where + b"".join([raw[a:b] for a, b in zip(low.tolist(), high.tolist())])

        size = blocks.size(sent)
        is_hot = np.repeat(hot, size)
        place, own_ids = blocks.windows(sent)[is_hot], np.repeat(ids[sent], size)[is_hot]

        def labels(i: np.ndarray) -> bytes:
            where = own_ids[i].astype("<i8").tobytes() + place[i].astype("<i8").tobytes() if self.later else b""
            return struct.pack("<I", len(i)) + label[i].astype("<u8").tobytes() + where

        return pa.concat_tables([X.send(batch, self.part(blocks, cold), texts), X.send(batch, part[is_hot], labels)])

    def answer_windows(self, part: int, table: pa.Table) -> pa.Table:
        """A bit for each window."""
        docs, places, counts = [], [], []
        held: list = []
        ends: list = []
        for x in table.column("payload"):
            x = x.as_buffer()
            n = struct.unpack_from("<I", x)[0]
            if part >= self.parts:
                held.append(np.frombuffer(x, "<u8", 2 * n, 4).reshape(-1, 2))
                if self.later:
                    docs.append(np.frombuffer(x, "<i8", n, 4 + 16 * n))
                    places.append(np.frombuffer(x, "<i8", n, 4 + 24 * n))
                counts.append(n)
                continue
            size, own = np.frombuffer(x, "<u4", n, 4).astype(np.int64), np.frombuffer(x, "<u4", n, 4 + 4 * n).astype(np.int64)
            at = 4 + 8 * n
            if self.later:
                docs.append(np.repeat(np.frombuffer(x, "<i8", n, at), own))
                places.append(spans(np.frombuffer(x, "<i8", n, at + 8 * n), own))
                at += 16 * n
            held.append(np.frombuffer(x, np.uint8, int(size.sum()), at))
            ends.append((size, own))
            counts.append(int(own.sum()))
        doc, place = (np.concatenate(docs), np.concatenate(places)) if self.later else (None, None)
        if part >= self.parts:
            label = np.concatenate(held)
            order, run = multikey([label[:, 0], label[:, 1]])
        else:
            start, size = self.window_bytes(data := np.concatenate(held), np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
            order, run, _ = nodes(data, start, size)
        return X.answer(table, counts, settled(order, run, doc, place))

    def flagged(self, table: pa.Table, first: dict[int, bytes], second: dict[int, bytes]) -> tuple[Blocks, np.ndarray]:
        """The batch's blocks and the first symbols of its windows that count."""
        blocks, _ = self.made(table)
        repeated, owned, asked, hot = self.routed(blocks, first)
        sent = blocks.texts[asked]
        bits = X.answers(second, self.parts_of(blocks, sent, hot)[0])[0] if len(sent) else np.zeros(0, bool)
        if self.later:
            stays = np.zeros(len(blocks.of), bool)  # the first block of a text that the batch owns
            stays[blocks.texts] = owned
            whole = np.flatnonzero(~stays)
        else:
            whole = np.flatnonzero(repeated[blocks.of]) if len(blocks.of) else blocks.of
        return blocks, np.concatenate([blocks.windows(whole), blocks.windows(sent)[bits]])

    def run(self, batches: DataFrame, schema: str) -> DataFrame:
        def codes_of(told: pa.Table, step: int) -> dict[int, bytes]:
            rows = zip(told.column("step").to_pylist(), told.column("part").to_pylist(), told.column("codes").to_pylist())
            return {p: c for s, p, c in rows if s == step}

        def one(key: tuple, table: pa.Table) -> pa.Table:
            return self.ask_texts(key[0].as_py(), table)

        def told(table: pa.Table) -> pa.Table:
            return self.answer_texts(table)

        def two(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            return self.ask_windows(key[0].as_py(), table, codes_of(told, 1))

        def three(key: tuple, table: pa.Table) -> pa.Table:
            return self.answer_windows(key[0].as_py(), table)

        def last(table: pa.Table, told: pa.Table) -> pa.Table:
            return self.finish(table, *self.flagged(table, codes_of(told, 1), codes_of(told, 2)))

        grouped = batches.groupBy("batch")
        texts = grouped.applyInArrow(one, X.SENT).groupBy("part").applyInArrow(told, X.ANSWERED).withColumn("step", F.lit(1))
        sent = grouped.cogroup(texts.groupBy("batch")).applyInArrow(two, X.SENT)
        windows = sent.groupBy("part").applyInArrow(three, X.ANSWERED).withColumn("step", F.lit(2))
        return grouped.cogroup(texts.union(windows).groupBy("batch")).applyInArrow(last, schema)
