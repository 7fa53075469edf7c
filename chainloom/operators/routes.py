"""Routes of a changelog: the id of a message, which revision counts, what a new reader gets, and what tells of a fork."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.errors import FinalizedOnlyError, RelationCycleError
from chainloom.functions.scalars import row_id
from chainloom.operators.intervals import following


def with_id(rows: DataFrame, candidates: Sequence[str | Column], block: str, index: str) -> DataFrame:
    """rows with _id: the first candidate that is neither null nor empty, else one made of the block and the place in it."""
    known = [F.nullif(c if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")) for c in candidates]
    return rows.withColumn("_id", F.coalesce(*known, row_id(block, index)))


def written_once(messages: DataFrame, order: Sequence[str], name: str = "_id") -> DataFrame:
    """Messages of a route whose ids are written once: the first of each id, by one aggregate before its shuffle."""
    values = [c for c in messages.columns if c != name]
    best = messages.groupBy(name).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return best.select(name, "_first.*")


def id_mismatches(messages: DataFrame, keys: Sequence[str], name: str = "_id") -> DataFrame:
    """Messages whose id is not that of their key columns; a reader that merges by key would lose or double these."""
    return messages.filter(~F.col(name).eqNullSafe(row_id(*keys)))


def live_from(messages: DataFrame, block: str, start: int) -> DataFrame:
    """Messages of the block at which the route went live and of later ones."""
    return messages.filter(F.col(block) >= start)


def commit_lag(batches: DataFrame, block_at: str, read_at: str, acknowledged_at: str) -> DataFrame:
    """batches with milliseconds from the block, and from its reading, to the acknowledgement."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return batches.withColumn("block_lag_ms", ms(acknowledged_at) - ms(block_at)).withColumn("read_lag_ms", ms(acknowledged_at) - ms(read_at))


def boundaries(forks: DataFrame, fork: str, safe: str, keys: Sequence[str]) -> DataFrame:
    """A message per fork of a route: the new epoch, which counts the forks of the keys, and the block that the feed went
    back to, 0 and dead_end where there was none. Forks are rare, so a window by keys holds few rows."""
    epoch = F.row_number().over(Window.partitionBy(*keys).orderBy(fork)).cast("long")
    return forks.select(*keys, fork, epoch.alias("epoch"), F.coalesce(safe, F.lit(0)).alias("block"), F.col(safe).isNull().alias("dead_end"))


def released(signals: DataFrame, block: str, floors: DataFrame, floor: str) -> DataFrame:
    """signals with the finality floor that lets each go: the lowest of the floors, one a batch, that is at its block or
    above; null for those that are still held."""
    found = following(signals.withColumn("_behind", F.col(block) - 1), "_behind", floors, floor, "_floor")
    return found.select(*signals.columns, F.col("_floor").alias(floor))


def finalized_only(signals: DataFrame, block: str, finalized: int | None) -> DataFrame:
    """Signals of a route that must not be taken back; one above the finalized block fails the job with the code of FinalizedOnlyError."""
    message = F.concat(F.lit(f"[{FinalizedOnlyError.code}] block "), F.coalesce(F.col(block).cast("string"), F.lit("null")), F.lit(" is not final"))
    late = F.coalesce(F.col(block) > F.lit(-1 if finalized is None else finalized), F.lit(True))
    return signals.filter(F.when(late, F.raise_error(message).cast("boolean")).otherwise(True))


def table_stats(tables: Mapping[str, DataFrame], block: str, width: int) -> DataFrame:
    """For each table and batch of width blocks: rows, and bytes of the rows as JSON."""
    parts = []
    for name, rows in tables.items():
        text = F.octet_length(F.to_json(F.struct(*rows.columns)))
        part = rows.groupBy(F.floor(F.col(block) / width).cast("long").alias("batch")).agg(F.count("*").alias("rows"), F.sum(text).cast("long").alias("bytes"))
        parts.append(part.select(F.lit(name).alias("table"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page(rows: DataFrame, order: str, after: int | None = None, size: int = 1000) -> DataFrame:
    """The next page, newest first: the size rows below the last key of the page before, all pages once in turn."""
    left = rows if after is None else rows.filter(F.col(order) < after)
    return left.orderBy(F.desc(order)).limit(size)


def children_first(parents: Mapping[str, Sequence[str]]) -> list[str]:
    """Table names, each before the tables it refers to, so that rows can be deleted in that order."""
    graph = {t: set(p) - {t} for t, p in parents.items()}
    try:
        return list(TopologicalSorter(graph).static_order())[::-1]
    except CycleError as error:
        raise RelationCycleError(f"tables refer to each other: {error.args[1]}") from None
