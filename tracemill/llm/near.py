"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least ``similarity``, and what
such links connect.

Pairs given as ``first`` (``simhash`` gives those its fingerprints link) are tried first; what they leave apart meets by MinHash
bands: 32 keys a document, each of the minima of 5 hash functions over its shingles. Two
documents of similarity s share a key with a chance of 1 - (1 - s**5)**32, which doesn't depend on how many there are: all
but 3 in a million pairs at 0.8, and fewer are missed above. No fingerprint, sketch or estimate decides: each link is taken
on the whole sets of both documents (64-bit hashes of the shingles).

Scale: equal sets are one node, so a group of copies is one row before anything is compared. Keys of one node are left.
Where up to ``_SMALL`` nodes share a key, all their pairs are checked. A larger bucket is settled in two rounds: first each
member is checked against one drawn for the bucket, in 8 of the bands. The members of buckets that these links leave apart
stay only if as much of their set as ``similarity`` says is in the sets of other members too, which two sets that are alike
have in common; texts of one template with enough of their own go here, at the cost of what they hold, and nothing that is
alike does. Every pair of those left in a bucket that isn't connected yet is checked, chunk against chunk, by tasks
that hold the sets of two chunks and send a spanning forest of the links they found, never all pairs.

Defined cases: letters A-Z are lowered, nothing else; words are split at space and 0x09-0x0D; fewer words than a shingle
are one shingle; texts without words, and null texts, have the empty set, and equal sets are alike; repeated rows are one node; a very long text is hashed whole by one task; an
empty table gives an empty table; other columns are ignored; rows with a null doc_id
get a null component_id.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import hashing as H
from tracemill.llm.common import written
from tracemill.llm.components import stars

SHINGLE = 5
BANDS = 32
ROWS = 5
_SMALL = 24
_CHUNK = 512
_FIRST = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_draw = random.Random(42)
_ODD = np.array([_draw.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    _, _, words = H.word_hashes(np.frombuffer(text.translate(_LOWER), np.uint8))
    return np.unique(H.windows(H.prefix(words), min(shingle, len(words)))) if len(words) else words


def keys(own: np.ndarray) -> np.ndarray:
    """A key of each band as signed longs; the number of the band is in its low bits."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 256):
        low = np.minimum(low, (own[i : i + 256] * _ODD[:, None]).min(1))
    out = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = H.mix(out + column)
    return (out & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def forest(nodes: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what the links between nodes of different labels connect."""
    _, label, members = np.unique(label, return_inverse=True, return_counts=True)
    size = np.array([len(s) for s in sets])
    begin = np.append(0, np.cumsum(size))
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]  # the nodes of each shingle, one shingle after the other
    first = np.append(0, np.cumsum(np.bincount(col)))
    edges = []
    for i in np.flatnonzero(label != members.argmax()):  # of two labels, one isn't the largest
        own = col[begin[i] : begin[i + 1]]
        n = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((label != label[i]) & (both >= similarity * np.maximum(1, size + size[i] - both) - 1e-6)):
            if label[j] != label[i] and alike(sets[i], sets[j]) >= similarity:
                edges.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return edges


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, same, keys): ``same`` is a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingles(x.as_py() or b"") for x in batch.column(1)]
            same = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "same", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data")).mapInArrow(run, "doc_id long, same binary, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, own) of the documents whose doc_id is a node, each distinct pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x.as_py() or b"").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "own"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data"))
    return texts.join(nodes, "node", "left_semi").mapInArrow(run, "node long, own binary").distinct()


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are alike."""
    one, two = (sets.select(F.col("node").alias(c), F.col("own").alias(s)) for c, s in (("u", "a"), ("v", "b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= similarity for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    n = [F.octet_length("a"), F.octet_length("b")]
    able = F.least(*n) + F.lit(1e-6) >= F.lit(similarity) * F.greatest(*n)  # the sizes alone rule out the rest
    return pairs.join(one, "u").join(two, "v").filter(able).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _apart(named: DataFrame) -> DataFrame:
    """The groups (key) of rows (key, node, label) that have several labels: all, most (rows of the most frequent label), main."""
    each = named.groupBy("key", "label").count()
    return each.groupBy("key").agg(F.sum("count").alias("all"), F.max("count").alias("most"), F.max_by("label", F.struct("count", "label")).alias("main")).filter("all > most")


def _shared(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes of members (node) that may be alike to another: at least ``similarity`` of their shingles are in others too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1).slice(a, 256)]
                size = [len(x) for x in own]
                columns = np.repeat(batch.column(0).slice(a, 256).to_numpy(), size), np.repeat(size, size).astype(np.int32), np.concatenate(own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "n", "shingle"])

    listed = members.join(sets, "node").select("node", "own").mapInArrow(run, "node long, n int, shingle long")
    common = written(listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    held = listed.join(common, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("n"))
    return held.filter(F.col("held") + F.lit(1e-6) >= F.lit(similarity) * F.col("n")).select("node")


def _left(large: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links (u, v) within the buckets (key, node) that ``roots`` leaves apart."""
    named = written(large.join(roots.select(F.col("u").alias("node"), "v"), "node", "left").select("key", "node", F.coalesce("v", "node").alias("label")))
    members = written(named.join(_apart(named), "key", "left_semi").select("node").distinct())
    if not members.limit(1).count():
        return None
    able = written(named.join(written(_shared(members, sets, similarity)), "node", "left_semi"))
    groups = written(_apart(able))
    return _blocks(able, groups, sets, similarity) if groups.limit(1).count() else None


def _blocks(named: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between rows (key, node, label) of different labels in ``groups``. Members of the most frequent label of a
    group meet all others, and those meet each other too."""
    plan = written(groups.select("key", "main", F.ceil((F.col("all") - F.col("most")) / _CHUNK).cast("int").alias("rest"), F.ceil(F.col("most") / _CHUNK).cast("int").alias("mains")))
    main, drawn = F.col("label") == F.col("main"), F.xxhash64("node", F.lit(7))
    own = F.when(main, F.col("rest") + F.pmod(drawn, F.col("mains"))).otherwise(F.pmod(drawn, F.col("rest"))).cast("int")
    mates = F.sequence(F.lit(0), F.when(main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1))
    dealt = named.join(plan, "key").withColumn("own_chunk", own).withColumn("mate", F.explode(mates))
    dealt = written(dealt.select(F.xxhash64("key", F.least("own_chunk", "mate"), F.greatest("own_chunk", "mate")).alias("block"), "node", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            block = held.column(0).to_numpy()
            last = int(np.searchsorted(block, block[-1])) if len(block) else 0  # the last block may go on
            if last:
                yield made(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield made(held)

    def made(rows: pa.Table) -> pa.RecordBatch:
        block, nodes, label = (rows.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(block)]
        edges = []
        for a, z in zip(cuts, cuts[1:]):
            if (label[a:z] != label[a]).any():
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column(3).slice(a, z - a)]
                edges += forest(nodes[a:z], label[a:z], sets, similarity)
        u, v = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.join(sets, "node").select("block", "node", "label", "own").repartition("block").sortWithinPartitions("block").mapInArrow(run, "u long, v long")


def _tried(prints: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs of nodes (u, v), u > v, of pairs of documents (u, v)."""
    of = prints.filter("doc_id is not null").join(nodes.select("same", "node"), "same").select("doc_id", "node").distinct()
    one, two = (of.select(F.col("doc_id").alias(c), F.col("node").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    return first.join(one, "u").join(two, "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()


def components(docs: DataFrame, similarity: float, first: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id: the least doc_id that links lead to. ``first`` holds pairs of doc_ids (u, v) that are tried before
    the bands, which then leave out what the links among these connect."""
    prints = written(_prints(docs))
    nodes = written(prints.filter("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").count().filter("count > 1"))
    buckets = written(keyed.join(shared, "key").select("key", "node", "count"))
    met = buckets.select("node")
    tried = None if first is None else written(_tried(prints, nodes, first))
    if tried is not None:
        met = met.union(tried.select(F.explode(F.array("u", "v"))))
    sets = written(_sets(docs, written(met.distinct())))
    roots = None if tried is None else stars(_checked(tried, sets, similarity))
    if roots is not None:
        labelled = written(buckets.join(roots.select(F.col("u").alias("node"), "v"), "node", "left").select("key", "node", "count", F.coalesce("v", "node").alias("label")))
    else:
        labelled = buckets.withColumn("label", F.col("node"))
    small, large = labelled.filter(F.col("count") <= _SMALL), labelled.filter(F.col("count") > _SMALL).select("key", "node", "label")
    one, two = (small.select("key", F.col("node").alias(n), F.col("label").alias(c)) for n, c in (("u", "a"), ("v", "b")))
    pairs = one.join(two, "key").filter("u > v and a <> b").select("u", "v")
    some = large.filter(F.col("key").bitwiseAND(BANDS - 1) < _FIRST)
    drawn = written(some.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", "key")).alias("d")).select("key", F.col("d.node").alias("v"), F.col("d.label").alias("b")))
    stars_of = some.join(drawn, "key").filter("label <> b").select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).filter("u <> v")
    found = _checked(written(pairs.union(stars_of).distinct()), sets, similarity)
    roots = stars(found if roots is None else roots.union(found))
    if (more := _left(large.select("key", "node"), roots, sets, similarity)) is not None:
        roots = stars(roots.union(more))
    named = written(nodes.join(roots.select(F.col("u").alias("node"), "v"), "node", "left").select("same", F.coalesce("v", "node").alias("component_id")))
    return prints.join(named, "same", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
