"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the
shared folder and gives it to the next one. All stages but the last return the columns of their input.

Defined cases, for every stage: a row with a null text is judged as an empty text and keeps its null (the classifier scores
both by its bias); rows with a null doc_id have no near copies and are otherwise like others; a null source is a source of its
own; of repeated rows one stays after the near-copy stage, and one of all texts without words, which are copies of each
other; doc_ids are meant to tell texts apart; ties between copies go to the smallest doc_id; very long texts are processed whole by one task; an empty table
gives an empty table; columns beyond those of documents are kept as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontam, line_dedup, packing, quality, simhash
from tracemill.llm.common import crc_part, table, written

#: Shared part of the five-word shingles from which on two documents are near copies.
SIMILARITY = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows outside the held-out fold, predicts to be good."""
    model = quality.fit(docs.filter(crc_part("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of each source; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: those linked by 0.8 of their five-word shingles. Candidates are the
    documents whose SimHash fingerprints link; copies that are further apart than their radius meet by MinHash bands."""
    return simhash.keep_one(docs, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold an item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifier, the fingerprints, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
