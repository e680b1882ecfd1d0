"""Bursts of events without a key, dealt by time instead of to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bursts(events: DataFrame, gap_seconds: float, *, ts: str = "ts", bucket_seconds: int = 6 * 3600) -> DataFrame:
    """n_events, first_ts and last_ts of each run of events no farther apart than the gap.

    Buckets of time are split side by side.  A burst can only go on at a bucket's edge, so
    just the first and last burst of each bucket meet in one place to be joined.
    """
    micros, kind = F.unix_micros(F.col(ts).cast("timestamp")), events.schema[ts].dataType
    gap, bucket = int(gap_seconds * 1_000_000), bucket_seconds * 1_000_000
    rows = events.filter(F.col(ts).isNotNull()).select(micros.alias("_t"), F.floor(micros / bucket).alias("_b"))
    near = Window.partitionBy("_b").orderBy("_t")
    opened = rows.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(near) > gap).cast("int"), F.lit(0)))
    numbered = opened.withColumn("_n", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered.groupBy("_b", "_n").agg(F.count(F.lit(1)).alias("n_events"), F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    last = local.groupBy("_b").agg(F.max("_n").alias("_top"))
    local = local.join(last, "_b")
    edge = (F.col("_n") == 0) | (F.col("_n") == F.col("_top"))
    order = Window.orderBy("_first")  # two rows of each bucket at most
    edges = local.filter(edge).withColumn("_new", F.coalesce((F.col("_first") - F.lag("_last").over(order) > gap).cast("int"), F.lit(0)))
    joined = edges.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_g").agg(
        F.sum("n_events").alias("n_events"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    columns = ["n_events", F.timestamp_micros("_first").cast(kind).alias("first_ts"), F.timestamp_micros("_last").cast(kind).alias("last_ts")]
    return local.filter(~edge).select(*columns).unionByName(joined.select(*columns))
