"""Edit-aware token counts.

A document's text is cut where a space follows a visible character, which always ends a pre-token, into leaves of about
``LEAF`` characters. A segment tree over the leaves holds subtree sums of characters and tokens. An edit is located by
descending the character sums; only the leaves it touches, with two characters of context on either side, are joined,
edited and encoded again, and the sums on their paths updated. The root is the count of the whole text at any time.

Trees are kept: ``save_trees`` gives a table with one row a document, which holds its leaves and the sums of every node;
``apply_edits`` reads such rows, encodes again only what edits touch, and gives the new trees and counts. ``count`` does both.

Scale: each step is one pass without a shuffle where the edits are in the rows; a task holds one document's tree at a time.
``attach`` joins a table of edits by doc_id where they aren't.

Defined cases: null texts count as empty, 0 tokens; edits apply in order to the text as it then is; positions are
characters, clamped to the text, and a stop before its start is the start; a null replacement is empty; null positions
are 0 (start) and the start (stop); null edits change nothing; repeated rows are counted each; empty tables give empty
results; other columns are ignored; very long texts are one row, and their tree is held whole by one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import tokens
from tracemill.llm.common import written

LEAF = 512
COUNTED = "n_tokens long, n_tokens_edited long, n_edits int, n_leaves int, n_chars_encoded_again long"
TREES = "doc_id long, leaves array<string>, chars array<long>, tokens array<long>"
EDITS = "array<struct<start:long,stop:long,replacement:string>>"
_CUT = re.compile(r"(?<=[\w!-~]) ")


class TokenTree:
    """A tree over a text; ``chars`` and ``tokens`` hold the sums of node i at i, its children at 2 i and 2 i + 1."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self.leaves = self._cut(text)
        self._build([count(x) for x in self.leaves])

    @classmethod
    def kept(cls, leaves: list[str], chars: list[int], tokens_: list[int], count: Callable[[str], int], leaf: int = LEAF) -> TokenTree:
        """A tree as it was saved; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.leaf, tree.encoded = count, leaf, 0
        tree.leaves, tree.chars, tree.tokens, tree.width = leaves, chars, tokens_, len(chars) // 2
        return tree

    def _cut(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            found = _CUT.search(text, at + self.leaf) if at + self.leaf < len(text) else None
            end = found.start() if found else len(text)
            out.append(text[at:end])
            at = end
        return out or [""]

    def _build(self, counts: list[int]) -> None:
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.tokens, self.chars = [0] * (2 * self.width), [0] * (2 * self.width)
        self.tokens[self.width : self.width + len(counts)] = counts
        self.chars[self.width : self.width + len(counts)] = [len(x) for x in self.leaves]
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _set(self, k: int, text: str, tokens: int) -> None:
        self.leaves[k] = text
        i = self.width + k
        self.tokens[i], self.chars[i] = tokens, len(text)
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        at, i, begin = max(0, min(at, self.chars[1] - 1)), 1, 0
        while i < self.width:
            i *= 2
            if at >= begin + self.chars[i]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def edit(self, start: int, stop: int, replacement: str) -> None:
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(stop, self.chars[1]))
        first, begin = self.locate(start - 2)
        last, _ = self.locate(stop + 2)
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - begin] + replacement + old[stop - begin :]
        self.encoded += len(new)
        if len(new) > 8 * self.leaf:  # cut it again; no other leaf is encoded
            parts = self._cut(new)
            counts = self.tokens[self.width : self.width + len(self.leaves)]
            self.leaves[first : last + 1] = parts
            counts[first : last + 1] = [self.count(x) for x in parts]
            self._build(counts)
            return
        for k in range(first + 1, last + 1):
            self._set(k, "", 0)
        self._set(first, new, self.count(new))


def attach(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows (doc_id and a text or a tree) with an edit table (doc_id, edit_no, start, stop, replacement) as ``edits``."""
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("edit_no", "start", "stop", "replacement"))).alias("e"))
    listed = F.transform("e", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["replacement"].alias("replacement")))
    kept = [c for c in rows.columns if c in ("doc_id", "text", "leaves", "chars", "tokens")]
    return rows.select(*kept).join(own.select("doc_id", listed.alias("edits")), "doc_id", "left")


def sample_edits(text: str = "text") -> Column:
    """Three edits of any text that has characters: an insertion, a deletion and a replacement."""
    size = F.length(text).cast("long")
    at = lambda a, b: F.floor(size * a / b).cast("long")
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), new.alias("replacement"))
    edits = F.array(edit(at(1, 3), at(1, 3), F.lit(" [edited]")), edit(at(1, 2), at(1, 2) + 40, F.lit("")), edit(at(2, 3), at(2, 3) + 12, F.upper(F.substring(text, 1, 12))))
    return F.when(size > 0, edits)


def save_trees(docs: DataFrame, leaf: int = LEAF, paths: tuple[str, str] | None = None) -> DataFrame:
    """docs with doc_id, text and, if any, edits (see ``EDITS``) -> ``TREES``, and the edits as they are. Every leaf is
    encoded once."""
    paths = paths or tokens.byte_bpe_paths()
    carried = ["edits"] if "edits" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [TokenTree(x.as_py() or "", lambda x: len(tokens.encode(x, paths)), leaf) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(trees), *batch.columns[2:]], ["doc_id", "leaves", "chars", "tokens", *carried])

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c).cast(EDITS).alias(c) for c in carried])
    return asked.mapInArrow(run, TREES + (f", edits {EDITS}" if carried else ""))


def _columns(trees: list[TokenTree]) -> list[pa.Array]:
    longs = pa.list_(pa.int64())
    return [pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.chars for t in trees], longs), pa.array([t.tokens for t in trees], longs)]


def apply_edits(trees: DataFrame, leaf: int = LEAF, paths: tuple[str, str] | None = None, keep: bool = True) -> DataFrame:
    """``TREES`` with edits -> the trees after the edits (``keep``) and the counts ``COUNTED``."""
    paths = paths or tokens.byte_bpe_paths()
    keys = ["doc_id", "leaves", "chars", "tokens"] if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, rows = [], []
            for leaves, chars, sums, edits in zip(*batch.columns[1:5]):
                tree = TokenTree.kept(leaves.as_py(), chars.as_py(), sums.as_py(), lambda x: len(tokens.encode(x, paths)), leaf)
                before, edits = tree.total, [e for e in edits.as_py() or [] if e]
                for e in edits:
                    start = e["start"] or 0
                    tree.edit(start, start if e["stop"] is None else e["stop"], e["replacement"] or "")
                rows.append((before, tree.total, len(edits), len(tree.leaves), tree.encoded))
                if keep:
                    done.append(tree)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            counts = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_columns(done) if keep else []), *counts], [*keys, *(x.split()[0] for x in COUNTED.split(", "))])

    edits = F.col("edits").cast(EDITS) if "edits" in trees.columns else F.lit(None).cast(EDITS)
    return trees.select("doc_id", "leaves", "chars", "tokens", edits.alias("edits")).mapInArrow(run, f"{TREES if keep else 'doc_id long'}, {COUNTED}")


def count(docs: DataFrame, leaf: int = LEAF, paths: tuple[str, str] | None = None) -> DataFrame:
    """docs with doc_id, text and edits -> doc_id and token counts before and after the edits. The trees are written to the
    shared folder in between."""
    return apply_edits(written(save_trees(docs, leaf, paths)), leaf, paths, keep=False)
