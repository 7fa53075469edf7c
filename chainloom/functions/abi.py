"""Contract events: descriptions compiled on the driver, logs decoded by column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.errors import AbiError
from chainloom.functions import u256
from chainloom.functions.scalars import topic_address

_ROUNDS, _MASK = 24, 2**64 - 1


def _keccak_constants() -> tuple[list[int], list[list[int]]]:
    """Round constants and rotations, from the rules that define them."""
    constants, state = [], 1
    for _ in range(_ROUNDS):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        constants.append(value)
    turns, x, y = [[0] * 5 for _ in range(5)], 1, 0
    for t in range(24):
        turns[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return constants, turns


def keccak256(data: bytes) -> bytes:
    """The hash that names events; for signatures on the driver, not for rows."""
    constants, turns = _keccak_constants()
    rotl = lambda v, n: ((v << n) | (v >> (64 - n))) & _MASK if n else v
    rate = 136
    padded = bytearray(data + b"\x01" + b"\0" * (rate - 1 - len(data) % rate))
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for k in range(rate // 8):
            a[k % 5][k // 5] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        for constant in constants:
            c = [reduce(lambda p, q: p ^ q, col) for col in a]
            d = [c[(x - 1) % 5] ^ rotl(c[(x + 1) % 5], 1) for x in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = rotl(a[x][y] ^ d[x], turns[x][y])
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y] & _MASK) for y in range(5)] for x in range(5)]
            a[0][0] ^= constant
    return b"".join(a[k % 5][k // 5].to_bytes(8, "little") for k in range(4))


@dataclass(frozen=True)
class Param:
    """A parameter; parts are the members of a tuple, and the type spells them out, as signatures do."""

    name: str
    type: str
    indexed: bool = False
    parts: tuple[Param, ...] = ()


@dataclass(frozen=True)
class Event:
    name: str
    params: tuple[Param, ...]

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(p.type for p in self.params)})"

    @property
    def topic(self) -> str:
        return "0x" + keccak256(self.signature.encode()).hex()

    @property
    def indexed(self) -> tuple[Param, ...]:
        return tuple(p for p in self.params if p.indexed)


def _type_of(entry: Mapping) -> str:
    if not entry["type"].startswith("tuple"):
        return entry["type"]
    return f"({','.join(_type_of(c) for c in entry.get('components', []))}){entry['type'][5:]}"


def events_of(description: str | Iterable[Mapping]) -> dict[str, Event]:
    """Events of a JSON description by name: of overloads the first, anonymous ones not; unnamed parameters by place."""
    entries = json.loads(description) if isinstance(description, str) else description
    entries = entries["abi"] if isinstance(entries, Mapping) else entries
    found: dict[str, Event] = {}
    for e in entries:
        if e.get("type") == "event" and not e.get("anonymous"):
            found.setdefault(e["name"], Event(e["name"], params_of(e.get("inputs", ()))))
    return found


def params_of(entries: Iterable[Mapping]) -> tuple[Param, ...]:
    return tuple(Param(p.get("name") or f"_{k}", _type_of(p), bool(p.get("indexed")), params_of(p.get("components", ()))) for k, p in enumerate(entries))


def selector(signature: str) -> str:
    return "0x" + keccak256(signature.encode()).hex()[:8]


ERC20 = {
    "Transfer": Event("Transfer", (Param("from", "address", True), Param("to", "address", True), Param("value", "uint256"))),
    "Approval": Event("Approval", (Param("owner", "address", True), Param("spender", "address", True), Param("value", "uint256"))),
}


def _value(word: Column, kind: str) -> Column:
    """A 32-byte word (64 hex digits) as a value: numbers up to 32 bits as LONG, wider ones as decimal text."""
    if kind == "address":
        return topic_address(word)
    if kind == "bool":
        return F.right(word, F.lit(1)) == "1"
    if kind.startswith("uint"):
        return F.conv(F.right(word, F.lit(8)), 16, 10).cast("long") if int(kind[4:] or 256) <= 32 else u256.decimal_text(word)
    if kind.startswith("int"):
        if int(kind[3:] or 256) <= 32:
            low = F.conv(F.right(word, F.lit(8)), 16, 10).cast("long")
            return F.when(F.substring(word, 1, 1) > "7", low - 2**32).otherwise(low)
        return u256.signed_text(word)
    if kind.startswith("bytes") and kind != "bytes":
        return F.concat(F.lit("0x"), F.substring(word, 1, 2 * int(kind[5:])))
    raise AbiError(f"{kind} is not a static type")


_ARRAY = re.compile(r"(.+)\[(\d*)\]$")


def _size(p: Param) -> int | None:
    """Words of a static parameter; None for a dynamic one, which has an offset in its place."""
    if found := _ARRAY.match(p.type):
        inner = _size(_element(p))
        return inner * int(found[2]) if inner is not None and found[2] else None
    if p.parts:
        sizes = [_size(x) for x in p.parts]
        return None if None in sizes else sum(sizes)
    return None if p.type in ("bytes", "string") else 1


def _element(p: Param) -> Param:
    return Param(p.name, _ARRAY.match(p.type)[1], parts=p.parts)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it uses more than once: worked out once, as the variable of a function over one element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _number(data: Column, at: Column) -> Column:
    """The number in the word at a place (hex digits from 0) where offsets and lengths stand; null beyond the data."""
    found = F.conv(F.substring(data, at + 49, F.lit(16)), 16, 10).cast("decimal(20,0)")
    return _bound(found, lambda n: F.when(n * 2 <= F.length(data), n.cast("int")))


def read(data: Column, at: Column, base: Column, p: Param) -> Column:
    """The parameter whose head is at a place; offsets count from base, the place of the tuple or array around it."""
    if _size(p) is None:
        return _bound(base + 2 * _number(data, at), lambda there: _read_at(data, there, p))
    return _read_at(data, at, p)


def _read_at(data: Column, at: Column, p: Param) -> Column:
    """The parameter that begins at a place, which is its head where its size is fixed."""
    if found := _ARRAY.match(p.type):
        element = _element(p)
        first = at if found[2] else at + 64
        step = 64 * (_size(element) or 1)

        def elements(count: Column) -> Column:
            places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).when(count == 0, F.array().cast("array<int>"))
            return F.transform(places, lambda k: read(data, first + k * step, first, element))

        return elements(F.lit(int(found[2]))) if found[2] else _bound(_number(data, at), elements)
    if p.parts:
        return F.struct(*(read(data, place, at, x).alias(x.name) for x, place in places(at, p.parts)))
    if p.type in ("bytes", "string"):
        raw = F.substring(data, at + 65, 2 * _number(data, at))
        return F.decode(F.unhex(raw), "UTF-8") if p.type == "string" else F.concat(F.lit("0x"), raw)
    word = F.substring(data, at + 1, F.lit(64))
    return _bound(word, lambda w: _value(w, p.type)) if _wide(p.type) else _value(word, p.type)


def _wide(kind: str) -> bool:
    """Whether a value is made of its word by many steps."""
    return bool(re.fullmatch(r"u?int\d*", kind)) and int(kind.lstrip("uint") or 256) > 32


def places(at: Column, params: Iterable[Param]) -> Iterator[tuple[Param, Column]]:
    """The members of a tuple with the places of their heads."""
    words = 0
    for p in params:
        yield p, at + 64 * words
        words += _size(p) or 1


def plain_hex(data: str) -> Column:
    """Hex in lower case without 0x. Give it a column of its own before values are cut from it many times."""
    return F.regexp_replace(F.lower(F.col(data)), "^0x", "")


def words(params: Iterable[Param]) -> int:
    """Words that the heads of parameters take."""
    return sum(_size(p) or 1 for p in params)


def event_filter(event: Event, values: Mapping[str, Sequence] | None = None, topics: str = "topics") -> Column:
    """Logs of an event whose indexed parameters have a listed value; empty lists don't filter."""
    found = (F.lower(F.get(topics, F.lit(0))) == event.topic) & (F.size(topics) == 1 + len(event.indexed))
    for k, p in enumerate(event.indexed):
        wanted = (values or {}).get(p.name) or []
        wanted = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        if wanted:
            found &= F.lower(F.get(topics, F.lit(k + 1))).isin([encode(v, p.type) for v in wanted])
    return found


def encode(value, kind: str) -> str:
    """A value of a static type as a topic."""
    if kind == "bool":
        value = int(value)
    if isinstance(value, int):
        return "0x" + (value % 2**256).to_bytes(32, "big").hex()
    text = str(value).lower().removeprefix("0x")
    return "0x" + (text.ljust(64, "0") if kind.startswith("bytes") else text.rjust(64, "0"))


def same_topics(events: Iterable[Event]) -> list[tuple[str, str]]:
    """Pairs of events that no log can tell apart: the same topic and number of indexed parameters."""
    seen: dict[tuple[str, int], str] = {}
    return [(seen[key], e.name) for e in events if (key := (e.topic, len(e.indexed))) in seen or seen.setdefault(key, e.name) != e.name]


def decode(logs: DataFrame, events: Sequence[Event], topics: str = "topics", data: str = "data", on_error: str = "fail") -> DataFrame:
    """logs with event (the name of the event that matches, others go) and for each event a struct of its parameters,
    null on logs of others. All by column expressions: static words are cut from the data by place; text, bytes, arrays
    and tuples are followed by the offsets they give, whatever their nesting. Indexed parameters that do not fit a topic
    are their hash. Two events that no log can tell apart are refused.

    Data that end before an event's head do: on_error 'fail' ends the job, 'drop' leaves the log out, 'keep' keeps it
    without values; the last adds decode_error, which counts what was suppressed.
    """
    if twice := same_topics(events):
        raise AbiError(f"no log tells these events apart: {twice}")
    body = F.col("_body")
    name = reduce(lambda acc, e: F.coalesce(acc, F.when(event_filter(e, topics=topics), F.lit(e.name))), events, F.lit(None).cast("string"))
    heads = {e.name: words(p for p in e.params if not p.indexed) for e in events}
    need = reduce(lambda acc, item: F.when(F.col("event") == item[0], 64 * item[1]).otherwise(acc), heads.items(), F.lit(0))
    named = logs.withColumn("event", name).filter(F.col("event").isNotNull()).withColumn("_body", plain_hex(data))
    short = F.coalesce(F.length(body), F.lit(0)) < need
    if on_error == "drop":
        named = named.filter(~short)
    elif on_error == "keep":
        named = named.withColumn("decode_error", F.when(short, F.lit("data end early")))
    else:
        named = named.withColumn("event", F.when(short, F.raise_error(F.concat(F.lit("data of a log end early: "), F.col("event")))).otherwise(F.col("event")))
    columns = []
    for e in events:
        parts, topic_at = {}, 1
        for p in e.params:
            if p.indexed:
                word = F.regexp_replace(F.lower(F.get(topics, F.lit(topic_at))), "^0x", "")
                topic_at += 1
                hashed = p.parts or _ARRAY.match(p.type) or p.type in ("string", "bytes")
                parts[p.name] = F.concat(F.lit("0x"), word) if hashed else _bound(word, lambda w, p=p: _value(w, p.type)) if _wide(p.type) else _value(word, p.type)
        start = F.lit(0)
        parts |= {p.name: read(body, place, start, p) for p, place in places(start, [p for p in e.params if not p.indexed])}
        mine = (F.col("event") == e.name) & ~short if on_error == "keep" else F.col("event") == e.name
        columns.append(F.when(mine, F.struct(*(parts[p.name].alias(p.name) for p in e.params))).alias(e.name))
    return named.select(*(c for c in named.columns if c != "_body"), *columns)
