"""Progress of a pipe from its log of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.functions.scalars import status_class


def merge_batches(batches: DataFrame, key: str) -> DataFrame:
    """Batches of one key as one: bytes and requests added, the lowest start, the last head."""
    rows = batches.withColumn("class", status_class("status"))
    counts = [F.sum(F.when(F.col("class") == c, F.col("requests")).otherwise(0)).alias(c) for c in ("success", "rate_limited", "failed")]
    return rows.groupBy(key).agg(F.sum("bytes").alias("bytes"), F.min("requested_from").alias("requested_from"), F.max_by("head", "batch").alias("head"), *counts)


def throughput(batches: DataFrame, last: int, frame: int = 100, stale_seconds: int = 10) -> DataFrame:
    """For each batch (batch, at, block, bytes) the rates over the frame of batches before it, the percentage of the way
    from the first block to last and the seconds left; rates are zero after a pause of stale_seconds."""
    window = Window.orderBy("batch").rowsBetween(1 - frame, 0)
    at = F.unix_millis(F.col("at").cast("timestamp")) / 1000
    rows = batches.withColumn("_t", at).withColumn("_stale", F.coalesce(F.col("_t") - F.lag("_t").over(Window.orderBy("batch")) > stale_seconds, F.lit(False)))
    span = F.col("_t") - F.first("_t").over(window)
    blocks = F.col("block") - F.first("block").over(window)
    rate = lambda x: F.when((span > 0) & ~F.col("_stale"), x / span).otherwise(0.0)
    start = F.first("block").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select("*", rate(blocks).alias("blocks_per_second"), rate(F.sum("bytes").over(window)).alias("bytes_per_second"), (100.0 * (F.col("block") - start) / F.greatest(F.lit(last) - start, F.lit(1))).alias("percent"))
    return out.withColumn("seconds_left", F.when(F.col("blocks_per_second") > 0, (F.lit(last) - F.col("block")) / F.col("blocks_per_second"))).drop("_t", "_stale")
