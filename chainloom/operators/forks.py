"""Finality and forks: the floor below which nothing changes, the chain above it, and where a rewrite joins it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.errors import StaleCanonicalError


@dataclass(frozen=True, order=True)
class Block:
    number: int
    hash: str | None = None


def running_floor(batches: DataFrame, batch: str, finalized: str) -> DataFrame:
    """batches with floor: the greatest finalized number seen up to each batch, which never falls; null before any. A
    log of batches is one row per commit, so one window over all is small."""
    return batches.withColumn("floor", F.max(finalized).over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)))


def rollback_chain(headers: DataFrame, number: str, floor: int) -> DataFrame:
    """Headers above the floor, newest first: what a later fork can touch."""
    return headers.filter(F.col(number) > floor).orderBy(F.desc(number))


def rollback_chains(headers: DataFrame, number: str, floors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for many pipes: headers above the floor of their keys."""
    return headers.join(floors.select(*keys, F.col("floor").alias("_floor")), list(keys)).filter(F.col(number) > F.col("_floor")).select(*headers.columns)


def resolve_fork(records: Iterable[tuple[Sequence[Block], Block | None]], canonical: Sequence[Block], cursor: Block | None = None) -> Block | None:
    """The newest block of ours that the source still has, by hash; its rows stay. None if there is no such block.

    records, newest first: the chain above a finalized block, and that block. Our blocks are visited newest first, and
    canonical blocks that are no older than one visited in vain can match no more. A block reached when none can match
    is contradicted by nothing: it is returned, to ask from there, unless it is below the finalized block. Where exactly
    one canonical block is left after a record and it is the finalized one, that stands in. A handful of headers each.
    """
    if cursor and canonical and max(b.number for b in canonical) < cursor.number:
        raise StaleCanonicalError(f"canonical blocks end before the cursor {cursor.number}")
    left = {b.hash: b.number for b in canonical if b.hash is not None}
    for chain, finalized in records:
        for block in sorted(chain, key=lambda b: b.number, reverse=True):
            if block.hash is not None and block.hash in left:
                return Block(left[block.hash], block.hash)
            if not left:
                return None if finalized and block.number < finalized.number else block
            left = {h: n for h, n in left.items() if n < block.number}
        if chain and finalized and list(left) == [finalized.hash]:
            return finalized
    return None


def common_block(chain: DataFrame, canonical: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For many chains at once: the newest block whose hash is canonical, per keys."""
    same = chain.filter("hash is not null").join(canonical.select(*keys, "number", "hash").distinct(), [*keys, "number", "hash"])
    return same.groupBy(*keys).agg(F.max("number").alias("safe"), F.max_by("hash", "number").alias("safe_hash"))


def head_lag(batches: DataFrame, heads: DataFrame, number: str = "number") -> DataFrame:
    """The delay in milliseconds of each batch's last block behind the same block at each node."""
    right = heads.select(F.col(number).alias("_n"), "node", F.col("at").alias("_at"))
    joined = batches.join(right, batches[number] == F.col("_n"))
    delay = F.unix_millis(F.col("at").cast("timestamp")) - F.unix_millis(F.col("_at").cast("timestamp"))
    return joined.select(number, "node", delay.alias("delay_ms"))
