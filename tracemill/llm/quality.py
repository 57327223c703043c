"""Quality classifier: supervised subword embeddings.

Each word, word pair and byte n-gram of a text has a learned vector in a hashed table; a document is the mean of its
vectors and goes through a softmax. A pair is hashed by the difference of its words, so that any immediate repetition is
one feature. Training is numpy stochastic gradient descent over a bounded, documented sample of labelled rows: at most
``per_class`` of each label in hash order, at most ``max_bytes`` of text, and no text of over ``max_text`` bytes (if not given, a
64th of ``max_bytes``: 384 KiB), so that a few very long ones aren't all that is learned from. At scoring time the two-class softmax
of a mean is the mean of one number per bucket, so every text is scored whole by table lookups, in one pass without a shuffle.

Defined cases: null and empty texts have no features and score the bias alone; labels that are null, neither 0 nor 1, or
differ for one doc_id are left out; without both labels in the sample every score is 0.5; repeated rows score alike, and
of rows that share a doc_id the shortest (then least) text is learned from, once; a very long text is scored whole, a slice at
a time; an empty table gives an empty table; columns called ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import hashing as H

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 5)
EPOCHS = 6
RATE = 2.0
PER_CLASS = 2500
MAX_BYTES = 24 << 20
THRESHOLD = 0.7
_STEP = 1 << 18


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # one number per bucket: the difference of the two classes' outputs for its vector
    bias: float
    grams: tuple[int, ...] = GRAMS


def features(text: bytes, buckets: int, grams: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Bucket ids of a text's features, repeats included, some at a time. Slices overlap, so no n-gram is lost."""
    mask = np.uint64(buckets - 1)
    data = np.frombuffer(text, np.uint8)
    for low in range(0, len(data), _STEP):
        sums = H.byte_prefix(data[low : low + _STEP + max(grams) - 1])
        for n in grams:
            yield (H.windows(sums, n)[:_STEP] & mask).astype(np.int32)
    _, _, words = H.word_hashes(data)
    yield (words & mask).astype(np.int32)
    if len(words) > 1:
        yield (H.mix(words[1:] - words[:-1] + np.uint64(7)) & mask).astype(np.int32)


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(np.concatenate([np.zeros(0, np.int32), *features(text, BUCKETS, GRAMS)]), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    bags = [(*_bag(text), label) for text, label in rows]
    if {b[2] for b in bags} != {0, 1}:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    share = np.bincount([b[2] for b in bags], minlength=2) / len(bags)
    steps = epochs * len(bags)
    for step in range(steps):
        if step % len(bags) == 0:
            order = rng.permutation(len(bags))
        ids, weight, label = bags[order[step % len(bags)]]
        own = vectors[ids]
        hidden = weight @ own
        out = output @ hidden + bias
        p = np.exp(out - out.max())
        error = p / p.sum()
        error[label] -= 1
        error *= np.float32(rate * (1 - step / steps) / (2 * share[label]))
        back = error @ output
        output -= np.outer(error, hidden)
        bias -= error * np.float32(0.1)
        vectors[ids] = own - weight[:, None] * back * np.float32(len(ids) ** 0.5)
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, max_text: int | None = None) -> list[tuple[bytes, int]]:
    """Texts and labels to train on; the bounds hold whatever the tables' size. Whole texts only."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("q_id")).agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other").select("q_id", F.col("label").cast("int").alias("label"))
    text = F.encode(F.col("text").cast("string"), "UTF-8")
    short = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= (max_bytes // 64 if max_text is None else max_text))).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"), text.alias("data"))
    # repeated rows are drawn once, so that many of one document don't take the places of others
    drawn = short.join(known, short["doc_id"] == known["q_id"]).groupBy("doc_id", "label").agg(F.min("size").alias("size")).withColumn("h", F.xxhash64("doc_id"))
    first = [drawn.filter(F.col("label") == label).orderBy("h", "doc_id").limit(per_class) for label in (0, 1)]
    picked: dict[int, int] = {}
    room = [max_bytes // 2] * 2
    for r in sorted(first[0].union(first[1]).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= room[r["label"]]:
            room[r["label"]] -= r["size"]
            picked[r["doc_id"]] = r["label"]
    if not picked:
        return []
    own = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(list(picked), pa.int64())})))  # at most per_class ids a label
    found = short.join(own, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("size", "data")).alias("least")).select("doc_id", "least.data")
    return [(bytes(data), picked[i]) for i, data in found.sort("doc_id").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, max_text: int | None = None) -> Model:
    """docs: the rows that may be learned from. Only text and quality are learned from; doc_id only joins and draws."""
    return train(sample(docs, labels, per_class, max_bytes, max_text))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for x in batch.column(batch.num_columns - 1):
                total, n = 0.0, 0
                for ids in features(x.as_py() or b"", len(model.table), model.grams):
                    total += float(model.table[ids].sum(dtype=np.float64))
                    n += len(ids)
                scores.append(1 / (1 + np.exp(-np.clip(model.bias + total / max(1, n), -700, 700))))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    asked = docs.select(*[f"`{c}`" for c in rest], F.encode(F.col("text").cast("string"), "UTF-8").alias("__qc_data"))
    schema = docs.select(*[f"`{c}`" for c in rest]).withColumn("score", F.lit(0.0)).schema
    return asked.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
