"""Operators that keep derived tables right when recent history is rewritten."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def net(rows: DataFrame, sign: str = "sign", generated: Sequence[str] = ()) -> DataFrame:
    """Equal rows with their signs added up, without those that cancel; generated columns are not compared."""
    keys = [c for c in rows.columns if c != sign and c not in generated]
    return rows.groupBy(*keys).agg(F.sum(sign).cast("long").alias(sign)).filter(F.col(sign) != 0)


def cancel_rows(rows: DataFrame, where: Column, sign: str = "sign", generated: Sequence[str] = ()) -> DataFrame:
    """Rows to append so that what the condition picks nets to nothing: one with sign -1 for each left over. What nets
    below zero cannot be cancelled by appending and is left out."""
    left = net(rows.filter(where), sign, generated).filter(F.col(sign) > 0)
    columns = [c for c in left.columns if c != sign]
    return left.select(*columns, F.explode(F.sequence(F.lit(1), F.col(sign))).alias("_n")).select(*columns, F.lit(-1).alias(sign))


def earliest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str], above: Column | None = None) -> DataFrame:
    """The first change of each key, of those above a bound: the image to go back to. One aggregate, as latest_per_key."""
    rows = changes if above is None else changes.filter(above)
    values = [c for c in changes.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return best.select(*(F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in changes.columns))


def latest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last change of each key, by one aggregate that combines before its shuffle."""
    values = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return best.select(*keys, "_last.*")


def apply_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, delete: str = "DELETE") -> DataFrame:
    """What a consumer of a changelog holds: the last change of each key, without the deleted."""
    return latest_per_key(changes, keys, order).filter(F.col(kind) != delete)


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the gone: garbage collection and undo of inserts."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def undo(table: DataFrame, images: DataFrame, keys: Sequence[str], block: str, op: str, safe: int) -> DataFrame:
    """The table as of the safe block. images(keys..., block, op, columns of the table before the change): the first
    change of a key above safe tells what was there: nothing if it inserted, else its image."""
    first = earliest_per_key(images, keys, [block], F.col(block) > safe)
    kept = without(table, first, keys)
    return kept.unionByName(first.filter(F.col(op) != "INSERT").select(*table.columns))


def fork_delete(rows: DataFrame, block: str, safe: int, upper: int) -> DataFrame:
    """Rows outside (safe, upper]: both bounds, so that partitions prune."""
    return rows.filter((F.col(block) <= safe) | (F.col(block) > upper))


def compensate(manifest: DataFrame, baseline: DataFrame, keys: Sequence[str], block: str, seq: str, safe: int, values: Sequence[str], inverses: DataFrame | None = None, once: Column | None = None) -> DataFrame:
    """For each key with a revision above the safe block what takes its place: its last revision at or below, else its
    finalized baseline, else the inverse that was stored for it, else nothing: keys, action ('surviving', 'baseline',
    'inverse' or 'delete') and values, which a delete has none of.

    inverses: keys, seq and values, where a key has several the one stored first counts, which undoes all that follow.
    once: which revisions of the manifest are written once; a key whose surviving revision is one needs no repair, since
    consumers hold what is still true. One aggregate over the manifest and two joins on its keys.
    """
    above = F.col(block) > safe
    last = F.max_by(F.struct(*values, (once if once is not None else F.lit(False)).alias("_once")), F.when(~above, F.col(seq)))
    found = manifest.groupBy(*keys).agg(F.max(above).alias("_orphaned"), F.max(~above).alias("_survives"), last.alias("_alive")).filter("_orphaned")
    found = found.withColumn("_alive", F.when(F.col("_survives"), F.col("_alive"))).filter("_alive is null or not coalesce(_alive._once, false)")
    joined = found.join(baseline.select(*keys, F.struct(*values).alias("_base")), list(keys), "left")
    if inverses is None:
        joined = joined.withColumn("_inverse", F.lit(None).cast(joined.schema["_base"].dataType))
    else:
        joined = joined.join(inverses.groupBy(*keys).agg(F.min_by(F.struct(*values), seq).alias("_inverse")), list(keys), "left")
    kinds = (("_alive", "surviving"), ("_base", "baseline"), ("_inverse", "inverse"))
    action = reduce(lambda rest, x: F.when(F.col(x[0]).isNotNull(), x[1]).otherwise(rest), reversed(kinds), F.lit("delete"))
    value = lambda v: reduce(lambda rest, x: F.when(F.col(x[0]).isNotNull(), F.col(x[0])[v]).otherwise(rest), reversed(kinds), F.lit(None)).alias(v)
    return joined.select(*keys, action.alias("action"), *(value(v) for v in values))


def numbered(rows: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """Rows with their number from 0 within a block."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("long"))


def sequenced(rows: DataFrame, block: str, order: Sequence[str], base: int = 0, name: str = "seq") -> DataFrame:
    """Rows with a number that rises over all blocks without gaps: numbers within a block, plus the rows of all before
    it. Only one row per block goes through the window over all."""
    counts = rows.groupBy(block).count()
    before = counts.select(block, (F.sum("count").over(Window.orderBy(block)) - F.col("count")).alias("_before"))
    own = numbered(rows, [block], order, "_nth")
    return own.join(before, block).withColumn(name, (F.col("_before") + F.col("_nth") + 1 + base).cast("long")).drop("_before", "_nth")
