"""Files named for the block range they cover, and tables of what is covered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.plans.ranges import Range


def coverage_windows(rows: DataFrame, tables: Sequence[str], block: str, width: int, whole: Range) -> DataFrame:
    """Windows of width blocks that tile a range for each table, with the rows each has: sparse tables have windows of
    none, so that what is covered has no gaps. Only counts per window meet the grid."""
    start = F.floor((F.col(block) - whole.start) / width) * width + whole.start
    counts = rows.filter(whole.covers(block)).groupBy(*tables, start.cast("long").alias("start")).agg(F.count("*").alias("n_rows"))
    grid = rows.select(*tables).distinct().withColumn("start", F.explode(F.sequence(F.lit(whole.start).cast("long"), F.lit(whole.end).cast("long"), F.lit(width).cast("long"))))
    stop = F.least(F.col("start") + width - 1, F.lit(whole.end)).cast("long")
    return grid.join(counts, [*tables, "start"], "left").select(*tables, "start", stop.alias("stop"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
