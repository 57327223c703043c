"""Folders of files: an inventory, and bounded texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.tools import confine_paths

MAX_BYTES = 10 * 1024 * 1024


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, type, size as text, mod_time): files only; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("type"), F.col("length").cast("string").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("mod_time"))


def read_bounded_text(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, error): files over ``max_bytes`` are refused before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    good = files.filter(F.col("length") <= max_bytes).select("path", F.col("content").cast("string").alias("content"), F.lit(None).cast("string").alias("error"))
    refused = files.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("content"), F.lit("file too large").alias("error"))
    return good.union(refused)


def _plain(path: Column) -> Column:
    """A path without scheme, with one slash at the front."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "/")


def read_requested(spark: SparkSession, requests: DataFrame, base: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """requests (path) -> path, content, error: files under ``base`` by their paths in it. Paths that lead out of base are
    denied, unknown ones aren't found, and files over ``max_bytes`` are refused before they are read."""
    root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "/", base.rstrip("/"))
    asked = confine_paths(requests.select("path").distinct(), root).withColumn("whole", F.when(~F.col("denied"), F.concat(F.lit(root + "/"), "relative")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    there = files.select(_plain(F.col("path")).alias("whole"), "length")
    small = files.filter(F.col("length") <= max_bytes).select(_plain(F.col("path")).alias("whole"), F.col("content").cast("string").alias("content"))
    size = F.col("length").cast("string")
    error = (
        F.when(F.col("denied"), F.concat(F.lit("path access denied: "), "path"))
        .when(F.col("length").isNull(), F.concat(F.lit("file not found: "), "path"))
        .when(F.col("length") > max_bytes, F.concat(F.lit("file too large: "), size, F.lit(f" bytes (max {max_bytes} bytes)")))
    )
    return asked.join(there, "whole", "left").join(small, "whole", "left").select("path", "content", error.alias("error"))
