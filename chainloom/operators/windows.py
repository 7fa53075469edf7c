"""Windows over event time, and the rows and retractions that a window route publishes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.operators.revisions import sequenced


def tumbling(rows: DataFrame, at: str, size: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates by window of event time and keys: keys, window_start, window_end and the aggregates. With a slide a row
    counts in each window that holds it. Works on streams with a watermark as on tables."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    found = rows.groupBy(*keys, window.alias("_w")).agg(*aggregates)
    return found.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in found.columns if c not in (*keys, "_w")])


def sessions(rows: DataFrame, at: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates by run of rows of the same keys that are less than the gap apart."""
    found = rows.groupBy(*keys, F.session_window(at, gap).alias("_w")).agg(*aggregates)
    return found.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in found.columns if c not in (*keys, "_w")])


def with_empty(found: DataFrame, keys: Sequence[str], seconds: int, zero: Sequence[str]) -> DataFrame:
    """Windows of each key from its first to its last without gaps; those added are empty and zero in the columns named."""
    spans = found.groupBy(*keys).agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    step = F.make_dt_interval(secs=F.lit(seconds))
    grid = spans.select(*keys, F.explode(F.sequence("a", "b", step)).alias("window_start"))
    joined = grid.join(found, [*keys, "window_start"], "left")
    return joined.select(
        *keys,
        "window_start",
        (F.col("window_start") + step).alias("window_end"),
        F.col("window_end").isNull().alias("empty"),
        *(F.coalesce(z, F.lit(0)).alias(z) for z in zero),
    )


def window_messages(windows: DataFrame, keys: Sequence[str], values: Sequence[str], neutral: bool = False) -> DataFrame:
    """One upsert per window under a stable id; an empty window becomes a delete, or an upsert of zeros if neutral."""
    start = F.unix_timestamp(F.col("window_start").cast("timestamp"))
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), start.cast("string"))
    kind = F.lit("UPSERT") if neutral else F.when(F.col("empty"), "DELETE").otherwise("UPSERT")
    return windows.select(name.alias("id"), kind.alias("change_type"), *values)


def frame_sums(rows: DataFrame, order: Sequence[str], rows_back: int, sums: dict[str, str], keys: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Sums over the current row and the rows before it, rows_back in all, with the first and last of the order column.

    Frames by keys are windows. Frames over all rows need a bucket, a column that rises with the order: rows are numbered
    through it, cut into ranges of equal length, and each range also gets the rows that end the one before it, so no
    task has all rows.
    """
    columns = rows.columns
    if bucket is None:
        window = Window.partitionBy(*keys).orderBy(*order)
    else:
        size, place = 100 * rows_back, F.col("_n") - 1
        rows = sequenced(rows.withColumn("_b", bucket), "_b", order, name="_n").withColumn("_range", F.floor(place / size))
        ends = place % size > size - rows_back
        rows = rows.withColumn("_in", F.explode(F.when(ends, F.array("_range", F.col("_range") + 1)).otherwise(F.array("_range"))))
        window = Window.partitionBy("_in").orderBy("_n")
    window = window.rowsBetween(1 - rows_back, 0)
    span = F.col(order[0]) - F.first(order[0]).over(window)
    found = rows.select("*", *(F.sum(c).over(window).alias(name) for name, c in sums.items()), span.alias("span"))
    return found if bucket is None else found.filter("_in = _range").select(*columns, *sums, "span")


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts: for each bound how many values are at most it, and inf for all, in one pass."""
    counts = rows.groupBy(*keys).agg(*(F.count(F.when(F.col(value) <= b, True)).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return counts.select(*keys, F.explode(F.array(*pairs, F.struct(F.lit("inf").alias("le"), F.col("all").alias("n")))).alias("_b")).select(*keys, "_b.*")
