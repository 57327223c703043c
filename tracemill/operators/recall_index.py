"""Recall through a bit-sliced index of trigrams.

``recall_topk`` tries every message of a session for each query. Here a page of ``PAGE`` messages has a table of slots: a trigram
hashes to one, and its bits tell which texts of the page hold a trigram of that slot. The literal parts of a query, between its
wildcards, give trigrams that a hit must hold all of; their slots are intersected, and only what is left is read and tried
with the exact rule, so two trigrams in one slot cost a trial and change nothing.

Scale: a page's slots grow with its longest text and are at most ``1 << MOST_BITS``; a row is a page, so the index has no row a
trigram. Messages are shuffled once, by session and block of ``BLOCK`` messages, and a hot session is many groups; queries meet pages by
(session, block), and messages by (session, seq). Slots are filled by numpy in tasks, since no built-in expression
writes into an array; looking them up is built-in.

Defined cases: queries without a literal part of three characters try their whole session, as ``recall_topk`` does; null queries
find nothing; null texts hold nothing; A-Z are folded on both sides; repeated messages are found as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import fold, folded_like
from tracemill.operators.memory import RECALL, recall_topk, with_folded

GRAM = 3
BLOCK = 4096
PAGE = 32
LEAST_BITS, MOST_BITS = 6, 16
SPAN = 1 << 20
#: A trigram's hash is the sum of its code points times these, modulo 2**WIDE; its leading bits are the slot.
WIDE = 40
FACTORS = (0x9E3779B97F, 0xC2B2AE3D27, 0xD6E8FEB867)
_FIELDS = ("content", "reasoning_content")


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1)))


def query_grams(query: Column) -> Column:
    """The trigrams that every text LIKE '%query%' holds."""
    parts = F.split(fold(query), "[%_]")
    return F.array_distinct(F.flatten(F.transform(parts, trigrams)))


def _hash(gram: Column) -> Column:
    terms = [F.ascii(F.substr(gram, F.lit(i + 1), F.lit(1))).cast("long") * F.lit(x) for i, x in enumerate(FACTORS)]
    return (terms[0] + terms[1] + terms[2]).bitwiseAND(F.lit((1 << WIDE) - 1))


def _pages(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The pages of messages that come in the order of (session_id, seq). A page that is parted by batches is several rows."""
    seq, block, session = rows.column("seq").to_numpy(), rows.column("block").to_numpy(), rows.column("session_id").dictionary_encode().indices.to_numpy()
    changes = [x[1:] != x[:-1] for x in (session, block, seq // PAGE)]
    starts = np.concatenate([[True], changes[0] | changes[1] | changes[2]])
    first, page = np.flatnonzero(starts), np.cumsum(starts) - 1
    texts = [rows.column(c).fill_null("") for c in _FIELDS]
    lengths = [pc.utf8_length(t).to_numpy().astype(np.int64) for t in texts]
    longest = np.maximum.reduceat(np.maximum(*lengths), first)
    bits = np.clip(np.ceil(np.log2(np.maximum(longest, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    offsets = np.concatenate([[0], np.cumsum(1 << bits)])
    slots = np.zeros(offsets[-1], np.uint64)
    for i, (text, length) in enumerate(zip(texts, lengths)):
        code, ends = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), "<u4"), np.cumsum(length)
        lane = np.left_shift(np.uint64(1), (seq % PAGE * 2 + i).astype(np.uint64))
        for begin in range(0, len(code) - GRAM + 1, SPAN):
            part = code[begin : begin + SPAN + GRAM - 1].astype(np.int64)
            part[(part >= ord("A")) & (part <= ord("Z"))] += 32
            at = np.arange(begin, begin + len(part) - GRAM + 1)
            owner = np.searchsorted(ends, at, "right")
            whole = at + GRAM <= ends[owner]
            hashed = sum(part[j : len(part) - GRAM + 1 + j] * x for j, x in enumerate(FACTORS))[whole] & ((1 << WIDE) - 1)
            owner = owner[whole]
            of = page[owner]
            np.bitwise_or.at(slots, offsets[of] + (hashed >> (WIDE - bits[of])), lane[owner])
    kept = [rows.column(c).take(pa.array(first)) for c in ("session_id", "block")]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(slots.view(np.int64)))
    return pa.RecordBatch.from_arrays([*kept, pa.array(seq[first] // PAGE), pa.array(bits, pa.int32()), lists], ["session_id", "block", "page", "bits", "slots"])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``SPAN`` characters."""
    if batch.num_rows:
        size = sum(pc.utf8_length(batch.column(c).fill_null("")).to_numpy().astype(np.int64) for c in _FIELDS)
        run = np.cumsum(size) // SPAN
        ends = [*(np.flatnonzero(run[1:] != run[:-1]) + 1), batch.num_rows]
        for a, b in zip([0, *ends], ends):
            yield batch.slice(a, b - a)


def build_recall_index(messages: DataFrame) -> DataFrame:
    """Pages (session_id, block, page, bits, slots) of messages (session_id, seq, content, reasoning_content). A page has 2 ** bits
    slots; of a slot, bit 2 * (seq % PAGE) stands for a message's content and the next one for its reasoning."""
    seq = F.col("seq").cast("long")
    rows = messages.filter("session_id is not null and seq is not null").select("session_id", F.floor(seq / BLOCK).alias("block"), seq.alias("seq"), *_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(_pages, _cut(batch))

    dealt = rows.repartition("session_id", "block").sortWithinPartitions("session_id", "seq")
    return dealt.mapInArrow(run, f"session_id {messages.schema['session_id'].dataType.simpleString()}, block long, page long, bits int, slots array<long>")


def candidates(index: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("session_id", "q_seq")) -> DataFrame:
    """(keys, q, seq): the messages that may hold each query that has trigrams."""
    asked = queries.select("session_id", *[c for c in keys if c != "session_id"], "q", F.transform(query_grams(F.col("q")), _hash).alias("hashes")).filter(F.size("hashes") > 0)
    blocks = asked.join(index.select("session_id", "block").distinct(), "session_id")
    slot = lambda h: F.call_function("shiftright", h, F.lit(WIDE) - F.col("bits")).cast("int")
    held = F.aggregate("hashes", F.lit(-1).cast("long"), lambda a, h: a.bitwiseAND(F.get("slots", slot(h))))
    met = blocks.join(index, ["session_id", "block"]).filter(held != 0).select(*keys, "q", "page", held.alias("held"))
    either = F.col("held").bitwiseOR(F.shiftrightunsigned("held", 1))
    seqs = F.array_compact(F.array(*[F.when(either.bitwiseAND(F.lit(1 << 2 * i)) != 0, F.col("page") * PAGE + i) for i in range(PAGE)]))
    # a page in two rows may name a repeated message in both
    return met.select(*keys, "q", F.explode(seqs).alias("seq")).repartition("session_id", "seq").distinct()


def recall_indexed(index: DataFrame, messages: DataFrame, queries: DataFrame, k: int = RECALL, keys: tuple[str, ...] = ("session_id", "q_seq")) -> DataFrame:
    """What ``recall_topk`` gives for queries (keys, q), by way of ``build_recall_index``'s pages of the same messages."""
    few = with_folded(candidates(index, queries, keys), "q").alias("q")
    hit = folded_like(F.col("m.__content"), F.col("q.__q")) | folded_like(F.col("m.__reasoning_content"), F.col("q.__q"))
    same = (F.col("m.session_id") == F.col("q.session_id")) & (F.col("m.seq") == F.col("q.seq"))
    rows = with_folded(messages, *_FIELDS).alias("m").join(few, same).filter(hit).select(*[F.col(f"q.{c}") for c in keys], "m.role", "m.content", "m.reasoning_content", "m.ts", "m.seq")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq")))
    found = rows.withColumn("rn", rank).filter(F.col("rn") <= k).select(*keys, "rn", "role", "content", "reasoning_content")
    return found.unionByName(recall_topk(messages, queries.filter(F.size(query_grams(F.col("q"))) == 0), k, keys))
