"""Markdown sections as windows over lines, without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_level, heading_title, lines, tokens, trim

SECTION_OVER = 30


def section_rows(files: DataFrame, key: str = "file_path") -> DataFrame:
    """key, section, title, start_line, end_line, text and n_tokens; sections of few tokens are left out.

    A running count of headings names the section of each line; what comes before the first
    heading is ``intro``.
    """
    rows = files.select(key, F.posexplode(lines(F.col("content"))).alias("at", "line"))
    running = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("section", F.sum(heading_level(F.col("line")).cast("int")).over(running))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    found = marked.groupBy(key, "section").agg(
        F.min_by("line", "at").alias("head"), (F.min("at") + 1).alias("start_line"), (F.max("at") + 1).alias("end_line"), joined.alias("text"))
    title = F.when(F.col("section") == 0, "intro").otherwise(heading_title(F.col("head")))
    told = found.select(key, "section", title.alias("title"), "start_line", "end_line", trim(F.col("text")).alias("text"))
    return told.withColumn("n_tokens", tokens(F.col("text"))).filter(F.col("n_tokens") > SECTION_OVER)
