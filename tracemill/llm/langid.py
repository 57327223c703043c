"""Language ID by compression: the language whose zstandard raw-content dictionary makes the text smallest.

A dictionary is a bounded, documented sample of whole training texts of one language, in hash order: at most ``PER_LANG``
distinct texts of at most ``MAX_TEXT`` bytes, up to ``DICTIONARY`` bytes. Copies are one text, so a large group of them takes
one place. A threshold on the hash cuts the draw before the shuffle, so a language that holds most rows sends no more than
others. Every text is then compressed whole with each dictionary, in one pass without a shuffle. A narrow margin between the
two smallest sizes is reported as ``rejected``.

Defined cases: null texts and texts without a letter are ``und`` with score 0, not rejected; without any training rows
every text is ``und``; a language whose texts are all longer than ``MAX_TEXT`` learns from its shortest one (its first
``DICTIONARY`` bytes); a language's name is its text; very long texts are compressed whole by one task; equal sizes go to the first language in alphabetical order, rejected; repeated rows are alike; an
empty table gives an empty table; columns with the names of the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_LANG = 400
MAX_TEXT = 4096
DICTIONARY = 110 << 10
LEVEL = 6
MARGIN = 0.01
UNKNOWN = "und"
MARGIN_OF_DRAW = 4
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The runs of letters of a text. Numerals such as a half are no letters."""
    found = _WORDS.findall(text)
    return found if all(map(str.isalpha, found)) else "".join(c if c.isalpha() else " " for c in text).split()


def letters(text: str) -> bytes:
    """The words of a text as lower-case letters with one space around each: what is compressed."""
    return f" {' '.join(words(text.lower()))} ".encode()


def draw(docs: DataFrame, per_lang: int = PER_LANG, max_text: int = MAX_TEXT) -> DataFrame:
    """(lang, h, text): about the ``per_lang`` first distinct texts of each language in hash order, of those of at most
    ``max_text`` bytes; a language without any gives its shortest text. Languages are few, so their counts go to the driver;
    a hash threshold from these counts leaves some ``MARGIN_OF_DRAW`` times the texts wanted before anything is shuffled."""
    rows = docs.filter("lang is not null and length(text) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.select("lang", "text", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
    short = F.col("size") <= max_text
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("h"))).alias("n"), F.min(F.struct("size", "h")).alias("least")).collect()
    if not counts:
        return rows.limit(0).select("lang", "h", "text")
    # the hash's upper 53 bits as a share of all
    place = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    share = {r["lang"]: min(1.0, MARGIN_OF_DRAW * per_lang / r["n"]) if r["n"] else -1.0 for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    drawn = rows.filter(short & (place <= limit))
    for r in counts:
        if not r["n"]:
            drawn = drawn.union(rows.filter((F.col("lang") == r["lang"]) & (F.col("size") == r["least"]["size"]) & (F.col("h") == r["least"]["h"])))
    distinct = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return distinct.withColumn("k", rank).filter(F.col("k") <= per_lang).select("lang", "h", "text")


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_text: int = MAX_TEXT, size: int = DICTIONARY) -> dict[str, bytes]:
    """docs: the rows that may be learned from, with text and lang -> a dictionary for each language."""
    drawn: dict[str, list[bytes]] = {}
    for lang, text in draw(docs, per_lang, max_text).orderBy("lang", "h").select("lang", "text").toLocalIterator():
        texts = drawn.setdefault(lang, [])
        if (data := letters(text)) not in texts:
            texts.append(data)
    out = {}
    for lang, texts in drawn.items():
        joined = texts[0][:size]
        for data in texts[1:]:
            if len(joined) + len(data) < size:
                joined += data
        out[lang] = joined
    return out


def sizes(data: bytes, compressors: list) -> list[int]:
    return [len(c.compress(data)) for c in compressors]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score (the share of the best language at 16 bits a factor of 2) and rejected."""
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as Z

        made = [Z.ZstdCompressor(level, dict_data=Z.ZstdCompressionDict(dictionaries[n], Z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for n in names]
        for batch in batches:
            out = []
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py()
                if not names or text is None or not words(text):
                    out.append((UNKNOWN, 0.0, False))
                    continue
                got = sizes(letters(text), made)
                best = min(got)
                rest = sorted(got)[1:2]
                out.append((names[got.index(best)], 1 / sum(2.0 ** -min(1000.0, (g - best) / 2) for g in got), bool(rest) and rest[0] - best < margin * best))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_())))], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    rest = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*rest).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    return docs.select(*rest, F.col("text").cast("string").alias("__li_text")).mapInArrow(run, schema)
