"""Asking the whole corpus about hashes: batches of documents send each distinct hash once, parts answer per hash.

Documents are dealt into batches by a hash of doc_id. A batch sends, for every part, one row with its distinct hashes;
a part gathers the rows of all batches, sorts, and answers each row with packed bits. Rows go back to their batch, which
makes the same hashes again and lines them up with the answers. A string that a third of the documents hold is sent once
per batch, not once per document; both sides have bounded memory; every step is a pure function of its rows, so a lost
executor costs a recomputation only. The exchange of texts is the same node in every step, so Spark writes it once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import partitions

BATCH_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).min
SENT = "batch long, part int, payload binary"
ANSWERED = "batch long, part int, codes binary"


def grown(size: int, total_bytes: int, most: int) -> int:
    """``size`` up to 1 GiB of text, then growing with its square root, up to ``most`` times: rows between batches and
    parts stay fewer than their product would be. At 100 TB a batch holds 64 MB of text and a part 256 MB; a task needs
    about ten times that."""
    return int(size * max(1.0, min(most, (total_bytes / (1 << 30)) ** 0.5)))


def batch_count(docs: DataFrame, total_bytes: int) -> int:
    return max(partitions(docs.sparkSession), -(-total_bytes // grown(BATCH_BYTES, total_bytes, 16)))


def part_count(docs: DataFrame, total_bytes: int, part_bytes: int, least: int = 1) -> int:
    return max(least * partitions(docs.sparkSession), -(-total_bytes // grown(part_bytes, total_bytes, 40)))


def batched(docs: DataFrame, count: int) -> DataFrame:
    """(batch, doc_id, data): a document's batch depends on its doc_id alone."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.pmod(F.xxhash64(doc_id), F.lit(count)).alias("batch"), doc_id.alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("data"))


def rows_of(batch: pa.Table) -> list[tuple[int | None, bytes | None]]:
    """The documents of a batch in doc_id order (null first), repeated rows next to each other."""
    rows = zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist())
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or b""))


def send(batch: int, part: np.ndarray, payload: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One row per part; ``payload`` gets the indices of the part's entries, in order."""
    order, cuts, parts = dealt(part)
    data = [payload(order[a:b]) for a, b in zip(cuts, cuts[1:])]
    return pa.table([pa.array([batch] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["batch", "part", "payload"])


def dealt(part: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Entries ordered by part, where each part's entries start and end, and the parts."""
    if not len(part):
        return np.zeros(0, np.int64), [0], []
    small = part.astype(np.uint16) if int(part.max()) < 65536 else part
    order = np.argsort(small, kind="stable")
    ordered = part[order]
    edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    cuts = [0, *edges.tolist(), len(part)]
    return order, cuts, ordered[cuts[:-1]].tolist()


def answers(codes: dict[int, bytes], part: np.ndarray, planes: int = 1) -> np.ndarray:
    """The bits of every entry, in the order of ``part``: shape (planes, entries)."""
    order, cuts, parts = dealt(part)
    out = np.zeros((planes, len(part)), bool)
    for p, a, b in zip(parts, cuts, cuts[1:]):
        out[:, order[a:b]] = np.unpackbits(np.frombuffer(codes[p], np.uint8).reshape(planes, -1), axis=1)[:, : b - a]
    return out


def answer(table: pa.Table, counts: list[int], *planes: np.ndarray) -> pa.Table:
    """Splits the bits of a part's entries into one row for each row that asked."""
    cuts = np.cumsum([0, *counts])
    codes = [b"".join(np.packbits(x[a:b]).tobytes() for x in planes) for a, b in zip(cuts, cuts[1:])]
    return pa.table([table.column("batch").cast(pa.int64()), table.column("part").cast(pa.int32()), pa.array(codes, pa.binary())], ["batch", "part", "codes"])


def pack_docs(doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending doc_ids and how many entries each has, in few bytes."""
    return zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 1)


def unpack_docs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<u4", n, 8 * n)
