"""Rows in trees of calls or instructions: what lies below a row, in one pass over each transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ends_below(outer: DataFrame, inner: DataFrame, keys: Sequence[str], path: str, values: Sequence[str]) -> DataFrame:
    """outer rows with n_below, the inner rows that are strictly below them in the tree of their keys, and structs first
    and last of the values of the first and last of these in the order of the tree; null where there are none.

    Paths are arrays; a row is below another if its path begins with the other's. An inner row counts for each of its
    ancestors, as many as it is deep, so both meet on equal paths: one shuffle that adds up before it, no pairs and no
    array of a transaction's rows. Rows that repeat count as often, and stay as often.
    """
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(F.col(path), F.lit(1), n)))
    below = inner.filter(F.size(path) > 0).select(*keys, above.alias("_path"), F.struct(F.col(path).alias("at"), F.struct(*values).alias("v")).alias("_in"))
    ends = below.groupBy(*keys, "_path").agg(F.count("*").alias("n_below"), F.min("_in").alias("_first"), F.max("_in").alias("_last"))
    joined = outer.withColumn("_path", F.col(path)).join(ends, [*keys, "_path"], "left")
    return joined.select(*outer.columns, F.coalesce("n_below", F.lit(0)).alias("n_below"), F.col("_first.v").alias("first"), F.col("_last.v").alias("last"))
