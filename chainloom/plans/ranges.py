"""Block ranges: the interval algebra behind scans. Ranges are inclusive; an open end is None."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.errors import RangeError

OPEN_END = 2**63 - 1


@dataclass(frozen=True, order=True)
class Range:
    start: int
    stop: int | None = None

    @property
    def end(self) -> int:
        return OPEN_END if self.stop is None else self.stop

    def intersect(self, other: Range) -> Range | None:
        start, end = max(self.start, other.start), min(self.end, other.end)
        return None if start > end else Range(start, None if end == OPEN_END else end)

    def minus(self, other: Range) -> list[Range]:
        """What of this range the other leaves: none, one or two pieces."""
        common = self.intersect(other)
        if common is None:
            return [self]
        before = [Range(self.start, common.start - 1)] if self.start < common.start else []
        after = [Range(common.end + 1, self.stop)] if common.end < self.end else []
        return before + after

    def holds(self, block: int) -> bool:
        return self.start <= block <= self.end

    def covers(self, column: str) -> Column:
        """The range as a predicate with literal bounds, which scans push down."""
        found = F.col(column) >= self.start
        return found if self.stop is None else found & (F.col(column) <= self.stop)


def merge_requests(requests: Iterable[tuple[Range, object]]) -> list[tuple[Range, list]]:
    """Disjoint ranges in order, each with the requests that cover it, in their given order; adjacent ranges with
    different requests stay apart, and ranges with the same are one."""
    requests = list(requests)
    cuts = sorted({r.start for r, _ in requests} | {r.end + 1 for r, _ in requests})
    out: list[tuple[Range, list]] = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        inside = [x for r, x in requests if r.start <= low and high - 1 <= r.end]
        if inside:
            out.append((Range(low, None if high - 1 >= OPEN_END else high - 1), inside))
    return out


def clip(requests: Iterable[tuple[Range, object]], bound: Range) -> list[tuple[Range, object]]:
    """Requests cut to a bound, as a resume after the cursor needs; those outside go."""
    return [(cut, x) for r, x in requests if (cut := r.intersect(bound))]


def next_covered(ranges: Iterable[Range], block: int) -> int | None:
    """The block itself or the next one after it that a range holds."""
    return min((max(r.start, block) for r in ranges if r.end >= block), default=None)


def range_of(ranges: Iterable[Range], block: int) -> Range | None:
    return next((r for r in ranges if r.holds(block)), None)


_NUMBER = re.compile(r"\+?\d[\d,_]*$")


def parse_endpoint(value: int | str | datetime, start: int | None = None) -> int | str | datetime:
    """A block number, 'latest' or an instant: digits with , or _ between, +N behind start, ISO dates (UTC)."""
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(value, int):
        if value < 0:
            raise RangeError(f"block {value} is negative")
        return value
    text = value.strip()
    if text == "latest":
        return text
    if _NUMBER.match(text):
        number = int(re.sub(r"[+,_]", "", text))
        if text[0] != "+":
            return number
        if not isinstance(start, int):
            raise RangeError(f"{value} needs a start to count from")
        return start + number
    try:
        return parse_endpoint(datetime.fromisoformat(text.replace("Z", "+00:00")))
    except ValueError:
        raise RangeError(f"{value!r} is no block, date or 'latest'") from None


def resolve(start: int | str | datetime, stop: int | str | datetime | None, blocks: DataFrame, number: str = "number", at: str = "timestamp", cursor: int | None = None) -> Range:
    """A range with its symbolic ends looked up in a table of headers, in one small aggregate: 'latest' is the greatest
    number, an instant is the first block at or after it (as a stop, the last before it would begin). A pipe that goes on
    behind a cursor has begun before: a start of 'latest' is then the block behind the cursor, or the head if that is
    lower, so that what came in between is not passed over."""
    first = parse_endpoint(start)
    last = None if stop is None else parse_endpoint(stop, first if isinstance(first, int) else None)
    if first == "latest" and isinstance(last, datetime):
        raise RangeError("a date cannot end a range that starts at 'latest'")
    wanted = []
    for k, x in enumerate((first, last)):
        if x == "latest":
            wanted.append(F.max(number).alias(f"x{k}"))
        elif isinstance(x, datetime):
            wanted.append(F.min(F.when(F.col(at) >= F.lit(int(x.timestamp())), F.col(number))).alias(f"x{k}"))
    found = blocks.agg(*wanted).first().asDict() if wanted else {}
    ends = [found.get(f"x{k}", x if isinstance(x, int) else None) for k, x in enumerate((first, last))]
    if ends[0] is None:
        raise RangeError(f"no block at or after {start}")
    if first == "latest" and cursor is not None:
        ends[0] = min(ends[0], cursor + 1)
    if ends[1] is not None and ends[1] < ends[0]:
        raise RangeError(f"the range ends at {ends[1]}, before its start {ends[0]}")
    return Range(ends[0], ends[1])
