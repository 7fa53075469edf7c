"""Pipes: a stream of blocks through named outputs into a sink, restarted from the safe block after a fork."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainloom.errors import DeepForkError, ForkError
from chainloom.operators.forks import Block
from chainloom.sinks.state import StateLog
from chainloom.sources.schemas import entities
from chainloom.streaming.metrics import observed
from chainloom.streaming.registry import Discovery

Output = Callable[[Mapping[str, DataFrame]], DataFrame]
#: Tells the block that the source reports as finalized at the moment, if it knows one.
FinalizedHead = Callable[[], Block | None]


class Sink(Protocol):
    log: StateLog

    def write(self, frames: Mapping[str, DataFrame], headers: Sequence[Block], floor: Block | None = None): ...

    def rollback(self, canonical: Sequence[Block]) -> Block: ...


def _floor(fresh: DataFrame, last: int, known: Block | None, finality: int, finalized: FinalizedHead | None) -> Block | None:
    """The finality floor after a batch: what the source reports, or else the batch's last block with finality blocks
    behind it; never below the known floor."""
    if finalized:
        found = finalized()
    else:
        found = fresh.filter(F.col("header.number") <= last - finality).agg(F.max_by(F.struct("header.number", "header.hash"), "header.number").alias("b")).first()["b"]
        found = Block(found["number"], found["hash"]) if found else None
    return max((b for b in (found, known) if b), key=lambda b: b.number, default=None)


def batch_writer(outputs: Mapping[str, Output], sink: Sink, finality: int = 32, finalized: FinalizedHead | None = None, discoveries: Mapping[str, Discovery] | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: one cached scan feeds all outputs; empty batches are skipped; blocks at or below the
    cursor are left out, so a batch that is run again adds nothing twice; a first block that does not follow the cursor's
    raises ForkError. The floor is the block that the source reports as finalized, which may be ahead of the batch; without
    such reports, the last block with finality blocks behind it.

    discoveries: registries by the name under which outputs find them among their tables, one row per child with all that
    was found up to and including this batch; batches add to them before outputs run.

    Only headers, one small row per block of the batch and above the floor, come to the driver.
    """

    def write(blocks: DataFrame, batch_id: int) -> None:
        _, now = sink.log.load()
        fresh = blocks.filter(F.col("header.number") > now.cursor.number) if now.cursor else blocks
        fresh = fresh.persist()
        try:
            parent = "parentHash" if "parentHash" in blocks.schema["header"].dataType.names else None
            cols = ["header.number", "header.hash", *([f"header.{parent}"] if parent else [])]
            ends = fresh.agg(F.min_by(F.struct(*cols), "header.number").alias("first"), F.max("header.number").alias("last")).first()
            if ends["last"] is None:
                return
            first = ends["first"]
            if parent and now.cursor and first["number"] == now.cursor.number + 1 and now.cursor.hash and first[parent] != now.cursor.hash:
                raise ForkError([(first["number"] - 1, first[parent])])
            floor = _floor(fresh, ends["last"], now.floor, finality, finalized)
            above = fresh.filter(F.col("header.number") > floor.number) if floor else fresh
            headers = [Block(r["number"], r["hash"]) for r in above.select("header.number", "header.hash").collect()]
            end = fresh.agg(F.max_by(F.struct("header.number", "header.hash"), "header.number").alias("b")).first()["b"]
            headers = headers or [Block(end["number"], end["hash"])]
            tables = entities(fresh)
            for name, d in (discoveries or {}).items():
                d.registry.add(len(now.safe_blocks), batch_id, d.registrations(tables))
                tables[name] = d.registry.read(now.safe_blocks)
            sink.write({name: f(tables) for name, f in outputs.items()}, headers, floor)
        finally:
            fresh.unpersist()

    return write


def start(blocks: DataFrame, outputs: Mapping[str, Output], sink: Sink, checkpoint: str, finality: int = 32, once: bool = True, finalized: FinalizedHead | None = None, discoveries: Mapping[str, Discovery] | None = None, count_bytes: bool = True) -> StreamingQuery:
    """Start the pipe; once: over what is there, then stop. A metrics.PipeMetrics listener hears of its blocks, and of
    their bytes if those are counted."""
    query = observed(blocks, count_bytes).writeStream.foreachBatch(batch_writer(outputs, sink, finality, finalized, discoveries)).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def run(blocks_of: Callable[[int], DataFrame], outputs: Mapping[str, Output], sink: Sink, checkpoint: str, canonical_of: Callable[[], Sequence[Block]], finality: int = 32, finalized: FinalizedHead | None = None, discoveries: Mapping[str, Discovery] | None = None, count_bytes: bool = True) -> int:
    """Run to the end of what is there. After a fork the query is over, since offsets only rise: the sink rolls back to
    the safe block by the canonical headers, and a new query over blocks_of(epoch) starts with a checkpoint of its own.
    The epoch is the number of forks in the sink's state, so a process that starts again goes on in the epoch that was
    under way, also where it ended between the rollback and the new query. Returns the number of forks it met.

    A fork that leaves the cursor where it was is a source that contradicts itself, and fails."""
    forks = 0
    while True:
        _, now = sink.log.load()
        query = start(blocks_of(len(now.safe_blocks)), outputs, sink, f"{checkpoint}/epoch-{len(now.safe_blocks)}", finality, True, finalized, discoveries, count_bytes)
        try:
            query.awaitTermination()
            return forks
        except Exception as error:
            if ForkError.code not in str(error):
                raise
        _, before = sink.log.load()
        safe = sink.rollback(canonical_of())
        if before.cursor and safe.number >= before.cursor.number:
            raise DeepForkError(f"the blocks that follow {before.cursor} contradict the canonical ones")
        forks += 1


def run_behind_cache(cached: tuple[DataFrame | None, int], live_from: Callable[[int, int], DataFrame], outputs: Mapping[str, Output], sink: Sink, checkpoint: str, canonical_of: Callable[[], Sequence[Block]], finality: int = 32, finalized: FinalizedHead | None = None, discoveries: Mapping[str, Discovery] | None = None, count_bytes: bool = True) -> int:
    """run(), with what sources.blocks.replayed found in front: the cached blocks as one batch, then live_from(cut, epoch), a
    stream that may begin earlier. Blocks below the cut come from the cache alone and the others live alone, so none is
    lost or doubled; a pipe whose cursor is behind the cut already goes on live. The cut is where the cache ends when the
    pipe first starts: what is cached later does not move a stream that has begun."""
    blocks, cut = cached
    _, now = sink.log.load()
    if blocks is not None and not (now.cursor and now.cursor.number >= cut - 1) and not now.safe_blocks:
        batch_writer(outputs, sink, finality, finalized, discoveries)(blocks, -1)
    live = lambda epoch: live_from(cut, epoch) if epoch else live_from(cut, epoch).filter(F.col("header.number") >= cut)
    return run(live, outputs, sink, checkpoint, canonical_of, finality, finalized, discoveries, count_bytes)
