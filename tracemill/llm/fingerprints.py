"""Document fingerprints: quartile bucket digests, and what becomes of them when a document is edited.

Every byte triplet of a text is hashed into one of ``BUCKETS`` counters. A counter becomes two bits: how many of the three
quartiles of all counters it exceeds. A digest is one byte for the logarithm of the length in front of these bits. Two digests
differ by the distance of their two bits in each bucket, opposite ends counting double, and by their lengths, bounded; the
likeness is what is left of ``MOST``, as a share.

``compare_edited`` also compares each document with its edited text, whose second half comes from the next document in order of
doc_id. Digests are made where texts lie. Texts then move once, compressed, into ranges of doc_id, where they are read in
order as a stream: a task holds two documents at a time. Only the last document of a range and the first one of the next
meet in a join, one row a range.

Scale: one shuffle of the compressed texts; a range holds about ``RANGE`` documents, so a task's sort stays bounded; the
driver sees one doc_id a range; nothing is broadcast. No step groups documents by content, so copies don't make hot keys.

Defined cases: a null text is an empty one; texts of fewer than three bytes have no triplets and digests of their length
alone; null doc_ids come first; rows of the same doc_id follow by the sha256 of their texts; a document that is alone is its
own next one; very long texts are counted in steps, by one task; an empty table gives an empty table; other columns, also ones
called ``fingerprint``, ``data`` or ``part``, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import partitions, written
from tracemill.llm.terms import text_bytes

BUCKETS = 512
MOST = 2 * BUCKETS
RANGE = 65_536
_STEP = 1 << 20
_GROUP = 256
_COST = np.array([0, 1, 2, 6], np.int64)
LENGTH_COST, LENGTH_MOST = 2, 64
MOVED = "part int, doc_id long, tie binary, n_chars long, digest binary, data binary"
PAIRED = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, data binary"
WHOLE, FIRST, LAST = 0, 1, 2
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def triplet_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many byte triplets of a text fall into each bucket."""
    out = np.zeros(buckets, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for a in range(0, max(0, len(whole) - 2), _STEP):
        d = whole[a : a + _STEP + 2].astype(np.uint32)
        h = (d[:-2] | d[1:-1] << 8 | d[2:] << 16) * np.uint32(2654435761)
        h ^= h >> 15
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> 13
        out += np.bincount(h % buckets, minlength=buckets)
    return out


def digests(texts: list[bytes], buckets: int = BUCKETS) -> list[bytes]:
    """The digest of each text: a length byte, then two bits a bucket."""
    out = []
    for a in range(0, len(texts), _GROUP):
        group = texts[a : a + _GROUP]
        counts = np.stack([triplet_counts(t, buckets) for t in group])
        quartiles = np.partition(counts, [buckets // 4 * k - 1 for k in (1, 2, 3)], axis=1)[:, [buckets // 4 * k - 1 for k in (1, 2, 3)]]
        code = (counts[:, :, None] > quartiles[:, None, :]).sum(2).astype(np.uint8).reshape(len(group), -1, 4)
        packed = (code << np.array([6, 4, 2, 0], np.uint8)).sum(2).astype(np.uint8)
        out += [bytes([min(255, int(8 * math.log2(len(t) + 1)))]) + p.tobytes() for t, p in zip(group, packed)]
    return out


def likeness(a: list[bytes], b: list[bytes], most: int = MOST) -> np.ndarray:
    """From 1 for equal digests down to 0 for those that differ by ``most`` or more, pair by pair."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1).astype(np.int16) for v in (a, b))
    apart = np.minimum(LENGTH_COST * np.abs(x[:, 0] - y[:, 0]).astype(np.int64), LENGTH_MOST)
    for shift in (6, 4, 2, 0):
        apart += _COST[np.abs((x[:, 1:] >> shift & 3) - (y[:, 1:] >> shift & 3))].sum(1)
    return 1 - np.minimum(apart, most) / most


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def edited(text: str, following: str) -> bytes:
    """The text with its last half replaced by as much of the beginning of the next one, or all of it."""
    half = len(text) // 2
    return (text[: len(text) - half] + following[:half]).encode("utf-8", "surrogateescape")


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_MOVED = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.binary()), ("n_chars", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())])
_PAIRED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
                     ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("data", pa.binary())])


def ranges(docs: DataFrame) -> list[int]:
    """The doc_ids at which a new range begins: one for about ``RANGE`` documents, and one for a shuffle partition."""
    parts = max(partitions(docs.sparkSession), -(-docs.count() // RANGE))
    if parts == 1:
        return []
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], 10 * max(1000, parts))).first()[0]
    return sorted(set(cuts or []))


def digested(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """Each document with its range, its digest and its compressed text."""
    limits = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for a in range(0, batch.num_rows, _GROUP):
                ids, texts = batch.column(0).slice(a, _GROUP).to_pylist(), [x or b"" for x in batch.column(1).slice(a, _GROUP).to_pylist()]
                part = [0 if i is None else int(np.searchsorted(limits, i, "right")) for i in ids]
                rows = [(p, i, hashlib.sha256(t).digest()[:8], len(_decoded(t)), d, pack(t)) for p, i, t, d in zip(part, ids, texts, digests(texts))]
                yield _arrow(rows, _MOVED)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, MOVED)


def _compared(pairs: list[tuple]) -> list[tuple]:
    """Rows of results from (doc_id, n_chars, digest, text, next digest, next text)."""
    changed = [edited(text, following) for *_, text, _, following in pairs]
    own, new, after = [p[2] for p in pairs], digests(changed) if changed else [], [p[4] for p in pairs]
    ends = zip(pairs, changed, new, likeness(own, new).tolist(), likeness(own, after).tolist())
    return [(WHOLE, None, p[0], p[1], hashlib.sha256(text).hexdigest(), p[2], d, x, y, None) for p, text, d, x, y in ends]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads ranges in order: results of all documents but the last of a range, and both ends of each range."""
    unpack, last = zstandard.ZstdDecompressor().decompress, None
    for batch in batches:
        for a in range(0, batch.num_rows, _GROUP):
            pairs, rows = [], []
            for part, doc_id, _, n_chars, digest, data in zip(*(c.to_pylist() for c in batch.slice(a, _GROUP).columns)):
                text = _decoded(unpack(data))
                if last and last[0] == part:
                    pairs.append((*last[1:4], last[4], digest, text))
                else:
                    rows += [(LAST, last[0], last[1], last[2], None, last[3], None, None, None, last[5])] if last else []
                    rows.append((FIRST, part, None, None, None, digest, None, None, None, data))
                last = (part, doc_id, n_chars, digest, text, data)
            yield _arrow(rows + _compared(pairs), _PAIRED)
    if last:
        yield _arrow([(LAST, last[0], last[1], last[2], None, last[3], None, None, None, last[5])], _PAIRED)


def _ends_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        yield _arrow(_compared([(i, n, d, _decoded(unpack(x)), e, _decoded(unpack(y))) for i, n, d, x, e, y in rows]), _PAIRED)


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next: a document's likeness
    to its edited text and to the next document."""
    cuts = ranges(docs)
    moved = digested(docs, cuts).repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id", "tie")
    paired = written(moved.mapInArrow(_paired, PAIRED))
    first = paired.filter(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("fingerprint").alias("after"), F.col("data").alias("following"))
    everywhere = Window.partitionBy()  # one row a range
    order = first.select(F.col("next").alias("part"), F.coalesce(F.lead("next").over(Window.orderBy("next")), F.min("next").over(everywhere)).alias("next"))
    met = paired.filter(F.col("kind") == LAST).join(order, "part").join(first, "next").select("doc_id", "n_chars", "fingerprint", "data", "after", "following")
    out = paired.filter(F.col("kind") == WHOLE).select(*RESULT).union(met.mapInArrow(_ends_met, PAIRED).select(*RESULT))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document, without moving texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _GROUP):
                rows = batch.slice(a, _GROUP)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "fingerprint": pa.array([d.hex() for d in digests([x or b"" for x in rows.column(1).to_pylist()])], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
