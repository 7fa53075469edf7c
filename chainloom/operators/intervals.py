"""Ranges in tables: which ranges hold a block, the next block that one holds, and ranges cut where they overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.plans.ranges import OPEN_END

#: Buckets that the span of values is cut into where order matters across them: one small row each.
_BUCKETS = 4_096


def _bounded(ranges: DataFrame, start: str, stop: str, *keep: Column) -> DataFrame:
    """_start and _end of the ranges that hold anything, with the kept columns."""
    end = F.coalesce(F.col(stop).cast("long"), F.lit(OPEN_END))
    return ranges.select(F.col(start).cast("long").alias("_start"), end.alias("_end"), *keep).filter("_start is not null and _start <= _end")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str = "start", stop: str = "stop", keep: Sequence[str] = ()) -> DataFrame:
    """points with the kept columns of every range that holds them, a row for each; an open end is null.

    An equi-join on buckets, never all pairs: a range stands in the one or two buckets of its own width, the power of
    two that its length fits, and a point in one bucket of each width that ranges have (63 at most, one aggregate). What
    meets in a bucket is within twice a range's width of it. Rows without a place or start match nothing, nor do
    ranges that end before they start.
    """
    length = F.col("_end") - F.col("_start")
    right = _bounded(ranges, start, stop, *(F.col(c).alias(f"_k_{c}") for c in keep))
    right = right.withColumn("_level", F.when(length == 0, 0).otherwise(F.length(F.bin(length))))
    levels = right.agg(F.collect_set("_level")).first()[0]
    bucket = lambda x: F.call_function("shiftright", F.col(x), F.col("_level"))
    right = right.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket("_start"), bucket("_end")))))
    left = points.withColumn("_at", F.col(at).cast("long")).withColumn("_level", F.explode(F.lit(sorted(levels)).cast("array<int>")))
    joined = left.withColumn("_bucket", bucket("_at")).join(right, ["_level", "_bucket"]).filter("_at between _start and _end")
    return joined.select(*(F.col(c) for c in points.columns), *(F.col(f"_k_{c}").alias(c) for c in keep))


def following(rows: DataFrame, at: str, marks: DataFrame, mark: str, name: str = "next") -> DataFrame:
    """rows with the smallest mark behind their place, null if there is none.

    Places and marks are dealt to buckets of their span, so that no window holds more than a bucket; between buckets only
    the first mark of each is handed back, at most _BUCKETS rows. Repeated rows stay; a null place has no next."""
    only = marks.select(F.col(mark).cast("long").alias("_v")).filter("_v is not null").distinct()
    ends = only.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    if ends["low"] is None:
        return rows.withColumn(name, F.lit(None).cast("long"))
    low, width = ends["low"], (ends["high"] - ends["low"]) // _BUCKETS + 1
    # before the first mark and from the last on no bucket is needed, and none may get all of these
    away = F.pmod(F.xxhash64("_v"), F.lit(_BUCKETS)).cast("int")
    place = F.call_function("div", F.col("_v") - F.lit(low), F.lit(width).cast("long")).cast("int")
    bucket = F.when(F.col("_v").isNull() | (F.col("_v") < low), -1 - away).when(F.col("_v") > ends["high"], _BUCKETS + 1 + away).otherwise(place)
    both = rows.select(F.struct("*").alias("_row"), F.col(at).cast("long").alias("_v")).unionByName(only, allowMissingColumns=True).withColumn("_b", bucket)
    behind = Window.partitionBy("_b").orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, -1)  # from the far end, so that it adds up as it goes
    near = both.withColumn("_near", F.min(F.when(F.col("_row").isNull(), F.col("_v"))).over(behind)).filter("_row is not null")
    firsts = rows.sparkSession.range(_BUCKETS + 1).select(F.col("id").cast("int").alias("_b")).join(only.groupBy(bucket.alias("_b")).agg(F.min("_v").alias("_first")), "_b", "left")
    later = firsts.select("_b", F.min("_first").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    found = near.join(later, "_b", "left").withColumn("_next", F.when(F.col("_v") < low, F.lit(low)).otherwise(F.coalesce("_near", "_later")))
    return found.select("_row.*", F.col("_next").alias(name))


def next_covered(points: DataFrame, ranges: DataFrame, at: str, start: str = "start", stop: str = "stop", name: str = "next") -> DataFrame:
    """points with the block itself if a range holds it, else the first block behind it that one does; null if none."""
    bounded = _bounded(ranges, start, stop)
    places = points.select(F.col(at).cast("long").alias("_p")).distinct()
    held = in_ranges(places, bounded, "_p", "_start", "_end").select("_p").distinct().withColumn("_held", F.lit(True))
    behind = following(places, "_p", bounded, "_start", "_next").join(held, "_p", "left")
    answers = behind.select("_p", F.when(F.col("_held"), F.col("_p")).otherwise(F.col("_next")).alias(name))
    return points.withColumn("_p", F.col(at).cast("long")).join(answers, "_p", "left").select(*points.columns, name)


def split_overlaps(ranges: DataFrame, start: str = "start", stop: str = "stop", name: str = "name") -> DataFrame:
    """Ranges in a table cut where they overlap: (start, stop, names), disjoint, each with the sorted distinct names of
    the ranges that cover it; an open end is null, what no range covers is left out. Nothing passes through the driver or
    one task but bounds: a piece runs from one cut to the next, and lies in a range as a whole if its first block does."""
    bounded = _bounded(ranges, start, stop, F.col(name).alias("_name"))
    ends = F.array(F.col("_start"), F.when(F.col("_end") < OPEN_END, F.col("_end") + 1))
    cuts = bounded.select(F.explode(ends).alias("cut")).filter("cut is not null").distinct()
    pieces = following(cuts, "cut", cuts, "cut", "next")
    named = in_ranges(pieces, bounded, "cut", "_start", "_end", ["_name"]).groupBy("cut", "next").agg(F.sort_array(F.collect_set("_name")).alias("names"))
    return named.select(F.col("cut").alias("start"), (F.col("next") - 1).alias("stop"), F.array_join("names", ",").alias("names"))
