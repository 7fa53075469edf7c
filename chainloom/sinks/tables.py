"""Sinks as Spark tables, each with its delivery guarantee and the repair after a fork or a lost driver.

All have write(batch frames, headers, floor) and rollback(canonical); recover() is safe to repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.errors import CoverageError, FinalizedOnlyError, SinkError
from chainloom.functions.validate import Declared, checked
from chainloom.operators.forks import Block
from chainloom.operators.revisions import cancel_rows, net
from chainloom.plans.ranges import Range
from chainloom.sinks.fs import Folder
from chainloom.sinks.state import State, StateLog

Frames = Mapping[str, DataFrame]


class MemorySink:
    """No guarantee: finalized rows of each batch go to a callback, and nothing is kept."""

    def __init__(self, on_data: Callable[[str, DataFrame], None], block: str = "block_number") -> None:
        self._on_data, self._block = on_data, block

    def write(self, frames: Frames, headers: Sequence[Block], floor: Block | None = None) -> None:
        for name, rows in frames.items():
            final = rows.filter(F.col(self._block) <= floor.number) if floor else rows.limit(0)
            if not final.isEmpty():
                self._on_data(name, final)


class AppendSink:
    """At least once, repaired by cancel rows: rows are appended with sign 1, then the state; what a crash or a fork
    leaves above the state's cursor is cancelled by appended rows of sign -1, and reads net both."""

    def __init__(self, spark: SparkSession, path: str, pipe: str, block: str = "block_number", sign: str = "sign") -> None:
        self._spark, self._path, self._block, self._sign, self.log = spark, path, block, sign, StateLog(spark, path, pipe)
        self._folder = Folder(spark, path)

    def write(self, frames: Frames, headers: Sequence[Block], floor: Block | None = None) -> State:
        for name, rows in frames.items():
            rows.withColumn(self._sign, F.lit(1)).write.mode("append").parquet(self._folder.at(name))
        return self.log.save(self.log.advance(headers, floor))

    def _cancel_above(self, safe: int) -> None:
        for name in [n for n in self._folder.names() if n[0] not in "._"]:
            rows = self._spark.read.parquet(self._folder.at(name))
            cancel_rows(rows, F.col(self._block) > safe, self._sign).write.mode("append").parquet(self._folder.at(name))

    def recover(self) -> State:
        _, state = self.log.load()
        self._cancel_above(state.cursor.number if state.cursor else -1)
        return state

    def rollback(self, canonical: Sequence[Block]) -> Block:
        safe = self.log.fork(canonical)
        self._cancel_above(safe.number)
        _, now = self.log.load()
        self.log.save(State(safe, now.floor, now.chain, now.extra))
        return safe

    def read(self, name: str) -> DataFrame:
        """Rows that are left, as often as they are left."""
        rows = net(self._spark.read.parquet(self._folder.at(name)), self._sign).filter(F.col(self._sign) > 0)
        return rows.withColumn(self._sign, F.explode(F.sequence(F.lit(1), F.col(self._sign)))).drop(self._sign)


class CoverageSink:
    """Exactly once for finalized rows: a file per table and window, named for the blocks it covers, <from>-<to>.parquet,
    also where there are no rows. columns: by table what its rows must be; one that is not fails the write with its path,
    before any file appears. A file appears by a rename and is never written over; recovery drops files beyond the
    cursor and refuses one that straddles it."""

    def __init__(self, spark: SparkSession, path: str, pipe: str, block: str = "block_number", columns: Mapping[str, Mapping[str, Declared]] | None = None) -> None:
        self._spark, self._block, self.log, self._folder = spark, block, StateLog(spark, path, pipe), Folder(spark, path)
        self._columns = columns or {}

    @staticmethod
    def file_name(covered: Range) -> str:
        if covered.end < covered.start:
            raise CoverageError(f"the range {covered} is inverted")
        return f"{covered.start:012d}-{covered.end:012d}.parquet"

    def write(self, frames: Frames, covered: Range, floor: Block) -> State:
        if covered.end > floor.number:
            raise FinalizedOnlyError(f"blocks up to {covered.end} are not final at {floor.number}")
        for name, rows in frames.items():
            if not rows.filter(F.col(self._block).isNull()).isEmpty():
                raise SinkError(f"{name} has rows without a block")
            rows = checked(rows, self._columns[name], name) if name in self._columns else rows
            inside = rows.filter(covered.covers(self._block)).orderBy(self._block).coalesce(1)
            beside = f"_beside/{name}"
            inside.write.mode("overwrite").parquet(self._folder.at(beside))
            parts = [n for n in self._folder.names(beside) if n.endswith(".parquet")]
            if len(parts) != 1:
                raise SinkError(f"{name}: {len(parts)} files for one window")
            self._folder.rename(f"{beside}/{parts[0]}", f"{name}/{self.file_name(covered)}")
        self._folder.delete("_beside")
        return self.log.save(State(Block(covered.end), floor))

    def recover(self) -> State:
        self._folder.delete("_beside")
        _, state = self.log.load()
        cursor = state.cursor.number if state.cursor else -1
        for name in [n for n in self._folder.names() if n[0] not in "._"]:
            for file in self._folder.names(name):
                first, last = (int(x) for x in file.removesuffix(".parquet").split("-"))
                if first <= cursor < last:
                    raise CoverageError(f"{name}/{file} straddles the cursor {cursor}")
                if first > cursor:
                    self._folder.delete(f"{name}/{file}")
        return state

    def coverage(self, name: str) -> list[Range]:
        return [Range(*(int(x) for x in f.removesuffix(".parquet").split("-"))) for f in self._folder.names(name)]

    def read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(self._folder.at(name))
