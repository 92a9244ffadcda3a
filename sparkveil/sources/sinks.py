"""Sinks: dated audit lines, records with and without their texts, mapping rows, reports, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_audit(rows: DataFrame, path: str, time: str = "time") -> None:
    """Appends rows as JSON lines to a folder for each UTC day of `time`; lengths that lack are taken from the texts, which are not written."""
    lengths = [F.coalesce(F.col(n) if n in rows.columns else F.lit(None).cast("int"), F.length(t) if t in rows.columns else F.lit(None).cast("int")).alias(n) for n, t in (("original_len", "original"), ("masked_len", "masked"))]
    keep = [c for c in rows.columns if c not in ("original", "masked", "original_len", "masked_len")]
    rows.select(*keep, *lengths, F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd").alias("day")).write.mode("append").partitionBy("day").json(path)


def append_detections(found: DataFrame, path: str, raw_path: str | None = None, snippet: str = "text") -> None:
    """Appends detections without their snippets to path, and whole ones to raw_path where one is given."""
    found.withColumn(snippet, F.lit("[REDACTED]")).write.mode("append").json(path)
    if raw_path:
        found.write.mode("append").json(raw_path)


def append_mapping(rows: DataFrame, path: str) -> None:
    """Appends (original hash, replacement) rows of a mapping table; the original itself is not written."""
    rows.select(F.sha2("original", 256).alias("original_hash"), "entity", "replacement").write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines in place of what was there."""
    rows.write.mode("overwrite").json(path)


def write_regions(regions: DataFrame, path: str, page: str) -> None:
    """Regions of each page as JSON in a folder of its own; the write's commit makes them visible at once."""
    regions.write.mode("overwrite").partitionBy(page).json(path)


def write_html(rows: DataFrame, path: str, title: str) -> None:
    """A table of escaped cells as HTML text, a part for each partition, each a page that can be opened."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    rows.select(F.concat(F.lit(f"<table title='{title}'><tr>"), *[cell(c) for c in rows.columns], F.lit("</tr></table>")).alias("value")).write.mode("overwrite").text(path)
