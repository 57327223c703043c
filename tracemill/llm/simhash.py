"""SimHash near-dedup with bit-sliced comparison.

A document's fingerprint has a bit for each of 64 majorities over the hashes of its word shingles; fingerprints link at
``radius`` differing bits or fewer, and a component is what links connect.

Scale: equal fingerprints are one node, so a group of copies is one row before anything is compared. With 3 differing
bits, two of five bit blocks are untouched: each distinct fingerprint goes to the 10 tables of block pairs and is compared
within its bucket only. Where there are so many fingerprints that buckets of these 25 bits would be large, blocks are finer: 3 of
6 (32 bits, 20 tables), then 4 of 7 (36 bits, 35 tables), with the same links. A bucket of over ``_BUCKET`` rows is dealt into chunks, and every pair of chunks is a bucket of its
own: nothing is dropped, and no task gets the whole. Within a bucket, bit planes stand vertically, 64 fingerprints a word;
carry-save counters add one plane to all distances at once, and words whose 64 distances all exceed the radius are left.
A bucket sends the spanning stars of its links only, never all pairs.

With a ``similarity``, links of fingerprints are candidates: fingerprints three bits apart don't tell whether documents share that
much of their shingles, so ``near`` takes each on the whole sets. Many that do share as much are further apart than any
radius finds: those are left to the bands of ``near``, which leave out what fingerprints have connected.

Defined cases: letters A-Z are lowered, nothing else; words are split at space and 0x09-0x0D; fewer words than a shingle
are one shingle; no words or a null text give fingerprint zero, which links like any other; rows with a null doc_id get a
fingerprint and a null component_id; a very long text is hashed whole by one task, 65,536 shingles at a time; repeated rows share fingerprint and component; other columns are ignored by
``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import near
from tracemill.llm.common import written
from tracemill.llm.components import stars

SHINGLE = 3
RADIUS = 3
SEED = 42
_BUCKET = 512
_SMALL = 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint."""
    from xxhash import xxh64_digest

    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    start = np.cumsum([0, *(len(w) + 1 for w in words)])
    n = max(1, len(words) - shingle + 1)
    ends = (start[min(shingle, len(words)) :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    start = start.tolist()
    for i in range(0, n, 65536):
        digests = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(start[i : min(n, i + 65536)], ends[i : i + 65536])])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py() or b"", shingle, seed) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data")).mapInArrow(run, "doc_id long, fp long")


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: (64, words); bit j of word w is that bit of fingerprint 64 * w + j."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def sliced_within(vertical: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each query and word of 64 fingerprints, the bits of those at ``radius`` or less. Counters hold up to radius."""
    places = max(1, radius.bit_length())
    out = np.zeros((len(queries), vertical.shape[1]), np.uint64)
    q, w = (x.reshape(-1) for x in np.indices(out.shape))
    counters = [np.zeros(len(q), np.uint64) for _ in range(places)]
    over = np.zeros(len(q), np.uint64)
    full = ~np.uint64(0)
    asked = np.where(planes_of(queries), full, np.uint64(0))  # (64, queries)
    start = np.uint64((1 << places) - 1 - radius)  # counters start so that they overflow beyond the radius
    for k in range(places):
        if int(start) >> k & 1:
            counters[k] |= full
    for bit in range(64):
        carry = vertical[bit][w] ^ asked[bit][q]
        for k in range(places):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % 8 == 7:
            live = over != full
            if not live.all():
                q, w, over, counters = q[live], w[live], over[live], [c[live] for c in counters]
            if not len(q):
                return out
    out[q, w] = ~over
    return out


def planes_of(prints: np.ndarray) -> np.ndarray:
    return (prints[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1)).astype(bool)


def _group_stars(prints: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning stars (node, least node) of one bucket's links."""
    n = len(prints)
    vertical = planes(prints)
    label = np.arange(n)
    for i in range(0, n, 256):
        near = np.unpackbits(sliced_within(vertical, prints[i : i + 256], radius).view(np.uint8), axis=1, bitorder="little")[:, :n]
        for row in near:
            own = np.unique(label[np.flatnonzero(row)])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    linked = np.flatnonzero(label != np.arange(n))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, nodes)
    ends = {*linked.tolist(), *label[linked].tolist()}
    return [(int(nodes[i]), int(least[label[i]])) for i in ends if nodes[i] != least[label[i]]]


def _links(radius: int):
    """Rows sorted by bucket -> edges. Small buckets are compared together, by distance in the sorted order."""

    def some(bucket: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
        edges, new = [], np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(new, len(bucket)))
        for at, n in zip(new[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
            edges += _group_stars(prints[at : at + n], nodes[at : at + n], radius)
        small = np.repeat(size <= _SMALL, size)
        for step in range(1, min(_SMALL, int(size.max()))):
            i = np.flatnonzero(small[:-step] & (bucket[step:] == bucket[:-step]))
            if len(i):
                apart = planes(prints[i] ^ prints[i + step])
                hit = np.unpackbits(sliced_within(apart, np.zeros(1, np.uint64), radius).view(np.uint8), bitorder="little")[: len(i)]
                i = i[hit.astype(bool)]
                edges += zip(nodes[i].tolist(), nodes[i + step].tolist())
        return edges

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if last:
                yield made(some(*(x[:last] for x in held)))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield made(some(*held))

    def made(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return stream


def _masks(radius: int, count: int = 0) -> list[int]:
    """Masks of all choices of the blocks that ``radius`` differing bits leave untouched, as signed longs: as few blocks as give
    ``count`` fingerprints buckets of some ``_SMALL`` on average, and radius + 4 at most."""
    for blocks in range(radius + 2, radius + 5):
        if 64 * (blocks - radius) // blocks >= math.log2(max(1, count / _SMALL)):
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(own, blocks - radius))]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (fp distinct, node) -> edges (u, v) that connect what links connect."""
    each = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(radius, nodes.count()))))
    keyed = nodes.select("fp", "node", F.explode(each).alias("b")).select("fp", "node", "b.t", "b.key")
    hot = written(keyed.groupBy("t", "key").count().filter(F.col("count") > _BUCKET).select("t", "key", F.ceil(F.col("count") / _BUCKET).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(chunk, o).alias("i"), F.greatest(chunk, o).alias("j")))
    dealt = (
        keyed.join(hot, ["t", "key"], "left")
        .withColumn("p", F.explode(F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(mates)))
        .select(F.xxhash64("t", "key", "p.i", "p.j").alias("bucket"), "fp", "node")
    )
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_links(radius), "u long, v long")


def _nodes(prints: DataFrame) -> DataFrame:
    """(fp, node): distinct fingerprints with their least doc_id."""
    return prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))


def candidates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Pairs of doc_ids (u, v) that connect what fingerprints link: each document and the least of its fingerprint, and the stars
    of ``links``."""
    prints = written(fingerprints(docs, shingle, seed))
    nodes = written(_nodes(prints))
    own = prints.join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).filter("u <> v")
    return own.union(links(nodes, radius)).distinct()


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, similarity: float | None = None) -> DataFrame:
    """doc_id, fp (signed long), component_id: the least doc_id that links lead to. With ``similarity``, (doc_id,
    component_id) by links of at least that similarity, those of ``candidates`` first and then those that ``near`` finds."""
    if similarity is not None:
        return near.components(docs, similarity, written(candidates(docs, shingle, radius, seed)))
    prints = written(fingerprints(docs, shingle, seed))
    nodes = written(_nodes(prints))
    roots = stars(links(nodes, radius))
    named = written(nodes.join(roots.select(F.col("u").alias("node"), "v"), "node", "left").select("fp", F.coalesce("v", "node").alias("component_id")))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, similarity: float | None = None) -> DataFrame:
    """The documents of docs that are the first of their component; rows with a null doc_id stay."""
    found = written(components(docs, shingle, radius, seed, similarity).filter("doc_id = component_id").groupBy("doc_id").count())
    once = found.select(F.col("doc_id").alias("__sh_id"), (F.col("count") > 1).alias("__sh_more"))
    # the same join at every size: ids of all documents aren't to be broadcast
    kept = docs.join(once.hint("merge"), F.col("doc_id").cast("long") == F.col("__sh_id"), "left").filter(F.col("doc_id").isNull() | F.col("__sh_id").isNotNull())
    if not found.filter("count > 1").limit(1).count():
        return kept.drop("__sh_id", "__sh_more")
    again = kept.filter("__sh_more").withColumn("__sh_row", F.row_number().over(Window.partitionBy("__sh_id").orderBy(F.xxhash64(*docs.columns)))).filter("__sh_row = 1")
    return kept.filter("not coalesce(__sh_more, false)").drop("__sh_id", "__sh_more").union(again.drop("__sh_id", "__sh_more", "__sh_row"))
