"""What the operators share: written intermediate tables, sizes and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.shared import written
from tracemill.sources.tables import table

__all__ = ["crc_part", "partitions", "spread", "table", "text_bytes", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that comes in fewer parts than there are cores (such as one row group), dealt out; others as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one narrow scan with a partial sum in each task."""
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def crc_part(col: str, parts: int) -> Column:
    """crc32 of the column as text, modulo parts: the split into folds that the contracts fix. A null is an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % parts
