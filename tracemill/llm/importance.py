"""Target-distribution importance resampling over hashed word n-grams.

A document's features are all its runs of 1 to ``n`` consecutive words. Separators are collapsed to single spaces, and one
regular expression for each length, with lookarounds at word boundaries and ``overlapped=True``, emits the spans of the
n-grams; a span's crc32 gives its bucket. The logarithm of target over corpus frequency is a bucket's gain, a document's
weight is the mean gain of its features, and the highest weights plus Gumbel noise, fixed by doc_id, are drawn: a sample
without replacement in proportion to the importance.

Scale: texts are scanned once, where they lie. A task writes the bucket counts of each document, and one histogram of all
it read; the histograms are summed with map-side combine, so ``buckets`` numbers for each of corpus and target reach the
driver, whatever their sizes. Scores are integers in a range of some ten thousands: their counts say how many documents stand
above each score, and ranks within a score are counted where its documents are. No sort sees all documents.

Defined cases: null and empty texts have no features, weight 0, and aren't drawn; a null doc_id draws its noise as an empty
id and comes first among ties; repeated rows are documents each; very long texts are scanned whole, their matches in blocks;
an empty target has only the smoothed counts; an empty table gives an empty table; other columns, also ones called ``score``,
``rank`` or ``weight``, are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import written
from tracemill.llm.terms import spaced, text_bytes

GRAMS = 2
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 25
SEED = 7
_BLOCK = 1 << 16
SCANNED = "doc_id long, n_words long, n_features long, counts binary, histogram array<long>"


def patterns(n: int) -> list[regex.Pattern]:
    """For each length up to n, what matches a run of that many words at every place where one starts."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (k - 1)) for k in range(1, n + 1)]


def bucket_counts(data: bytes | None, scan: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words a text has, the buckets of its features, and how often each."""
    text, found, words = b" ".join(spaced(data).split()), np.zeros(buckets, np.int64), 0
    for k, pattern in enumerate(scan):
        matches = (zlib.crc32(m[0]) for m in pattern.finditer(text, overlapped=True))
        while len(block := np.fromiter(itertools.islice(matches, _BLOCK), np.int64)):
            found += np.bincount(block % buckets, minlength=buckets)
            words += len(block) if k == 0 else 0
    at = np.flatnonzero(found)
    return words, at, found[at]


def scan(docs: DataFrame, n: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """A row per document with its bucket counts, and rows with a histogram of all that a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, compiled = np.zeros(buckets, np.int64), patterns(n)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, at, count = bucket_counts(text.as_py(), compiled, buckets)
                total[at] += count
                packed = np.diff(at, prepend=0).astype("<u4").tobytes() + count.astype("<u4").tobytes()
                rows.append((doc_id, words, int(count.sum()), packed, None))
            yield _batch(rows)
        yield _batch([(None, None, None, None, total.tolist())])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, SCANNED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_words", "n_features", "counts", "histogram"])


def total(scanned: DataFrame, buckets: int) -> np.ndarray:
    """The summed histogram: at most ``buckets`` rows."""
    out = np.zeros(buckets, np.int64)
    for b, n in scanned.filter("histogram is not null").select(F.posexplode("histogram").alias("b", "n")).groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed target frequency over the smoothed corpus frequency, for each bucket."""
    n, own, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (own + n) / ((s + 1) * (wanted + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for packed, features in zip(batch.column("counts").to_pylist(), batch.column("n_features").to_pylist()):
                gap, count = np.frombuffer(packed, "<u4").astype(np.int64).reshape(2, -1)
                weights.append(int(gain[np.cumsum(gap)] @ count) // features if features else 0)
            kept = {c: batch.column(c) for c in ("doc_id", "n_words", "n_features")}
            yield pa.RecordBatch.from_pydict(kept | {"weight": pa.array(weights, pa.int64())})

    return scanned.filter("histogram is null").drop("histogram").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank counts from 1 in the order drawn, and is null for those that aren't."""
    scanned = written(scan(docs, n, buckets))
    gain = gains(total(scanned, buckets), total(scan(target.withColumn("doc_id", F.lit(None).cast("long")), n, buckets), buckets))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weigh(scanned, gain).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= min_words))
    counts = scored.filter("able").groupBy("score").count()
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are scores
    levels = counts.select(F.col("score"), F.lit(True).alias("able"), F.coalesce(F.sum("count").over(above), F.lit(0)).alias("__above"), F.floor(F.sum("count").over(Window.partitionBy()) * share / 100).alias("__drawn"))
    placed = scored.join(levels, ["score", "able"], "left")
    place = F.col("__above") + F.row_number().over(Window.partitionBy("score", "able").orderBy("doc_id"))
    return placed.withColumn("rank", place).select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("__drawn"), F.col("rank")).alias("rank"))
