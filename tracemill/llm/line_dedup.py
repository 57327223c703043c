"""Line dedup by site-relative frequency.

A line of a host is boilerplate when at least ``min_pages`` pages of that host contain it and their number divided by the
host's page total exceeds ``ratio``. Such lines are dropped from every page of the host. Built-in expressions only.

Scale: each page sends its distinct lines as 16-byte digests with a partial count before the shuffle, so neither a hot
host nor a hot line is gathered. A host keeps fewer than (mean distinct lines per page / ratio) digests. They are written
first, so the join with the texts is a broadcast only where Spark sees a size under its threshold, and otherwise a
sort-merge join on the host, which adaptive execution may split for a hot host.

Defined cases: a null text stays null and its page counts in the total; a null host is a host of its own; blank lines
(nothing but spaces) are never counted and never dropped; a page that repeats a line counts once; repeated rows are pages
of their own; a text is one row, however long; line ends are ``\\n``; a page may end up empty; an empty table gives an empty table. Internal columns start
with ``__ld_``; input columns called ``lines_total`` or ``lines_dropped`` are replaced when ``counts`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import written

RATIO = 0.1
MIN_PAGES = 5


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", text: str = "text") -> DataFrame:
    """(__ld_host, __ld_lines: digests of its boilerplate lines); hosts without any are left out."""
    seen = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _digest))
    total = F.array(F.unhex(F.lit("00")))  # one byte: stands for the page itself
    counts = (
        docs.select(_host(host).alias("__ld_host"), F.explode(F.concat(total, F.coalesce(seen, F.array().cast("array<binary>")))).alias("__ld_line"))
        .groupBy("__ld_host", "__ld_line")
        .agg(F.count(F.lit(1)).alias("__ld_n"))
    )
    totals = counts.filter(F.octet_length("__ld_line") == 1).select("__ld_host", F.col("__ld_n").alias("__ld_total"))
    return (
        counts.filter((F.octet_length("__ld_line") == 16) & (F.col("__ld_n") >= min_pages))
        .join(totals, "__ld_host")
        .filter(F.col("__ld_n") / F.col("__ld_total") > ratio)
        .groupBy("__ld_host")
        .agg(F.collect_set("__ld_line").alias("__ld_lines"))
    )


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", text: str = "text", counts: bool = True) -> DataFrame:
    """docs without boilerplate lines in ``text``; with ``counts``, also lines_total and lines_dropped (null texts: 0)."""
    drop = written(boilerplate(docs, ratio, min_pages, host, text))
    kept = F.filter("__ld_all", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__ld_lines"), _digest(x)))
    lines = F.when(F.col("__ld_lines").isNotNull(), _lines(text)) if not counts else _lines(text)
    out = docs.withColumn("__ld_host", _host(host)).join(drop, "__ld_host", "left").withColumn("__ld_all", lines)
    out = out.withColumn("__ld_kept", F.when(F.col("__ld_lines").isNotNull(), kept))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    numbers = {"lines_total": size("__ld_all"), "lines_dropped": F.when(F.col("__ld_kept").isNull(), F.lit(0).cast("long")).otherwise(size("__ld_all") - size("__ld_kept"))}
    out = out.withColumns({**(numbers if counts else {}), text: F.when(F.col("__ld_kept").isNull(), F.col(text)).otherwise(F.array_join("__ld_kept", "\n"))})
    return out.select(*[f"`{c}`" for c in docs.columns if c not in numbers or not counts], *(numbers if counts else []))
