"""What a sink knows of its pipe: cursor, finalized floor and the chain above it, one numbered record per commit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from chainloom.errors import DeepForkError, SinkError
from chainloom.operators.forks import Block, resolve_fork
from chainloom.sinks.fs import Folder


@dataclass(frozen=True)
class State:
    cursor: Block | None = None
    floor: Block | None = None
    chain: tuple[Block, ...] = ()
    extra: dict = field(default_factory=dict)

    @property
    def safe_blocks(self) -> tuple[int, ...]:
        """Where each fork so far went back to; their number is the pipe's epoch."""
        return tuple(self.extra.get("forks", ()))


def _pack(b: Block | None) -> list | None:
    return None if b is None else [b.number, b.hash]


def _unpack(b: list | None) -> Block | None:
    return None if b is None else Block(*b)


class StateLog:
    """Records in a folder by commit number: a record appears whole by a rename, and its number makes a second writer
    fail, so commits follow one another and not the clock."""

    def __init__(self, spark: SparkSession, path: str, pipe: str, keep: int = 100) -> None:
        if not pipe:
            raise SinkError("a pipe needs an id")
        self._folder, self._keep = Folder(spark, f"{path}/_state/{pipe}"), keep

    def _numbers(self) -> list[int]:
        return [int(n) for n in self._folder.names() if n.isdigit()]

    def load(self) -> tuple[int, State]:
        numbers = self._numbers()
        if not numbers:
            return 0, State()
        r = self._folder.get(f"{max(numbers):012d}")
        return max(numbers), State(_unpack(r["cursor"]), _unpack(r["floor"]), tuple(map(_unpack, r["chain"])), r["extra"])

    def save(self, state: State) -> State:
        """Append a record. The floor never falls, and the chain keeps what is above it, newest 1000. A cursor that goes
        back is a fork, and the record that moves it also begins the next epoch."""
        number, before = self.load()
        if before.cursor and state.cursor and state.cursor.number < before.cursor.number:
            state = replace(state, extra={**state.extra, "forks": [*before.safe_blocks, state.cursor.number]})
        floor = max((b for b in (before.floor, state.floor) if b), default=None)
        known = {b.number: b for b in sorted(state.chain)}
        chain = [b for n, b in sorted(known.items()) if (not floor or n > floor.number) and (not state.cursor or n <= state.cursor.number)][-1000:]
        saved = State(state.cursor, floor, tuple(chain), state.extra)
        self._folder.put(f"{number + 1:012d}", {"cursor": _pack(saved.cursor), "floor": _pack(floor), "chain": [_pack(b) for b in chain], "extra": state.extra})
        for n in self._numbers()[: -self._keep]:
            self._folder.delete(f"{n:012d}")
        return saved

    def advance(self, headers: Sequence[Block], floor: Block | None = None, **extra) -> State:
        """The next state after a batch with these headers."""
        _, before = self.load()
        return State(max([*headers, *([before.cursor] if before.cursor else [])], default=None), floor or before.floor, (*before.chain, *headers), {**before.extra, **extra})

    def fork(self, canonical: Sequence[Block]) -> Block:
        """The block that stays after a fork."""
        _, now = self.load()
        safe = resolve_fork([(now.chain, now.floor)], canonical, now.cursor)
        if safe is None:
            raise DeepForkError("no block of the chain is canonical")
        return safe
