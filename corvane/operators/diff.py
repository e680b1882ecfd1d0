"""What changed between the ledger and the files of now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(files: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """file_path and op (add, change, delete, same) by one full outer join; without a ledger all is add.

    A file has changed when its mtime text differs, be it older or newer.
    """
    if ledger is None:
        return files.select("file_path", F.lit("add").alias("op"))
    now = files.select("file_path", F.col("last_modified").alias("now"))
    was = ledger.select("file_path", F.col("last_modified").alias("was"))
    op = (F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "delete")
          .when(F.col("now") != F.col("was"), "change").otherwise("same"))
    return now.join(was, "file_path", "full_outer").select("file_path", op.alias("op"))


def to_index(changed: DataFrame) -> DataFrame:
    return changed.filter(F.col("op").isin("add", "change")).select("file_path")


def to_delete(changed: DataFrame) -> DataFrame:
    return changed.filter(F.col("op") == "delete").select("file_path")


def summary(changed: DataFrame) -> DataFrame:
    return changed.groupBy("op").agg(F.count(F.lit(1)).alias("n"))
