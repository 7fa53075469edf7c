"""Instruction data of variable length: vectors, options, structs and enums read field by field, into Arrow columns."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from chainloom.errors import AbiError
from chainloom.functions import base58

Kind = "str | Vec | Option | Array | Struct | Enum"


@dataclass(frozen=True)
class Vec:
    """Any number of values, counted by 32 bits in front."""

    of: Kind


@dataclass(frozen=True)
class Option:
    """A value behind a 1, or a 0."""

    of: Kind


@dataclass(frozen=True)
class Array:
    """A fixed number of values."""

    of: Kind
    size: int


@dataclass(frozen=True)
class Struct:
    fields: tuple[tuple[str, Kind], ...]


@dataclass(frozen=True)
class Enum:
    """One of several variants by the number in front; each a name with fields, maybe none. The value has kind, the name of
    the variant, and for each variant with fields a struct, null but for its own."""

    variants: tuple[tuple[str, tuple[tuple[str, Kind], ...]], ...]


# Plain types by how they are stored (little-endian) and shown.
_NUMBERS = {"u8": ("<B", "bigint"), "u16": ("<H", "bigint"), "u32": ("<I", "bigint"), "i8": ("<b", "bigint"), "i16": ("<h", "bigint"), "i32": ("<i", "bigint"), "i64": ("<q", "bigint"), "f32": ("<f", "double"), "f64": ("<d", "double"), "bool": ("<?", "boolean")}
_WIDE = {"u64": (8, False, "decimal(20,0)"), "u128": (16, False, "string"), "i128": (16, True, "string")}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0), "binary": pa.binary()}


class ShortData(ValueError):
    """Data that end before a value does, or a tag that no variant has."""


class _Plain:
    """Values of a plain type as they come."""

    def __init__(self, kind: str, take: Callable[[bytes, int], tuple[object, int]], least: int, finish: Callable[[list], list] | None = None) -> None:
        self.ddl, self.least, self._take, self._finish, self._values = kind, least, take, finish, []

    def read(self, data: bytes, at: int) -> int:
        value, at = self._take(data, at)
        self._values.append(value)
        return at

    def none(self) -> None:
        self._values.append(None)

    def mark(self) -> object:
        return len(self._values)

    def back(self, mark: object) -> None:
        del self._values[mark:]

    def column(self) -> pa.Array:
        values, self._values = self._values, []
        return pa.array(self._finish(values) if self._finish else values, _ARROW[self.ddl])


class _Many:
    def __init__(self, child, size: int | None) -> None:
        self.child, self._size, self.ddl = child, size, f"array<{child.ddl}>"
        self.least = 4 if size is None else size * child.least
        self._ends, self._null = [0], []

    def read(self, data: bytes, at: int) -> int:
        count = self._size
        if count is None:
            if at + 4 > len(data):
                raise ShortData
            count, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        if count * max(1, self.child.least) > len(data) - at and (self.child.least or count > 1_000_000):
            raise ShortData
        for _ in range(count):
            at = self.child.read(data, at)
        self._ends.append(self._ends[-1] + count)
        self._null.append(False)
        return at

    def none(self) -> None:
        self._ends.append(self._ends[-1])
        self._null.append(True)

    def mark(self) -> object:
        return len(self._null), self.child.mark()

    def back(self, mark: object) -> None:
        del self._ends[mark[0] + 1 :], self._null[mark[0] :]
        self.child.back(mark[1])

    def column(self) -> pa.Array:
        ends, null, self._ends, self._null = self._ends, self._null, [0], []
        offsets = pa.array([None if n else e for e, n in zip(ends, [*null, False], strict=True)], pa.int32())
        return pa.ListArray.from_arrays(offsets, self.child.column())


class _Maybe:
    def __init__(self, child) -> None:
        self.child, self.ddl, self.least = child, child.ddl, 1

    def read(self, data: bytes, at: int) -> int:
        if at >= len(data) or data[at] > 1:
            raise ShortData
        if data[at]:
            return self.child.read(data, at + 1)
        self.child.none()
        return at + 1

    def none(self) -> None:
        self.child.none()

    def mark(self) -> object:
        return self.child.mark()

    def back(self, mark: object) -> None:
        self.child.back(mark)

    def column(self) -> pa.Array:
        return self.child.column()


class _Record:
    def __init__(self, names: Sequence[str], children: Sequence) -> None:
        self.names, self.children, self._null = list(names), list(children), []
        self.ddl = f"struct<{','.join(f'`{n}`:{c.ddl}' for n, c in zip(names, children, strict=True))}>"
        self.least = sum(c.least for c in children)

    def read(self, data: bytes, at: int) -> int:
        for c in self.children:
            at = c.read(data, at)
        self._null.append(False)
        return at

    def none(self) -> None:
        for c in self.children:
            c.none()
        self._null.append(True)

    def mark(self) -> object:
        return len(self._null), [c.mark() for c in self.children]

    def back(self, mark: object) -> None:
        del self._null[mark[0] :]
        for c, m in zip(self.children, mark[1], strict=True):
            c.back(m)

    def column(self) -> pa.Array:
        null, self._null = self._null, []
        return pa.StructArray.from_arrays([c.column() for c in self.children], self.names, mask=pa.array(null, pa.bool_()))


class _Choice(_Record):
    """kind, and a record for each variant with fields."""

    def __init__(self, variants: Sequence[tuple[str, _Record | None]]) -> None:
        self._variants = list(variants)
        self._kinds: list[str | None] = []
        super().__init__(["kind", *(n for n, r in variants if r)], [_Plain("string", lambda d, at: (None, at), 0), *(r for _, r in variants if r)])
        self.least = 1

    def read(self, data: bytes, at: int) -> int:
        if at >= len(data) or data[at] >= len(self._variants):
            raise ShortData
        name, mine = self._variants[data[at]]
        self.children[0]._values.append(name)
        at += 1
        for _, record in self._variants:
            if record is mine and record:
                at = record.read(data, at)
            elif record:
                record.none()
        self._null.append(False)
        return at


def _number(form: str) -> Callable[[bytes, int], tuple[object, int]]:
    size, unpack = struct.calcsize(form), struct.Struct(form).unpack_from

    def take(data: bytes, at: int) -> tuple[object, int]:
        if at + size > len(data):
            raise ShortData
        return unpack(data, at)[0], at + size

    return take


def _wide(size: int, signed: bool, text: bool) -> Callable[[bytes, int], tuple[object, int]]:
    def take(data: bytes, at: int) -> tuple[object, int]:
        if at + size > len(data):
            raise ShortData
        value = int.from_bytes(data[at : at + size], "little", signed=signed)
        return str(value) if text else value, at + size

    return take


def _bytes(size: int | None) -> Callable[[bytes, int], tuple[object, int]]:
    def take(data: bytes, at: int) -> tuple[object, int]:
        n = size
        if n is None:
            if at + 4 > len(data):
                raise ShortData
            n, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        if at + n > len(data):
            raise ShortData
        return bytes(data[at : at + n]), at + n

    return take


_WRAPPED = re.compile(r"(vec|option|array)<(.+)>$")


def parsed(kind: Kind) -> Kind:
    """Text such as vec<option<u64>> or array<u8,4> as a type; other types as they are."""
    if not isinstance(kind, str) or not (found := _WRAPPED.match(kind.replace(" ", ""))):
        return kind
    if found[1] == "array":
        inner, _, size = found[2].rpartition(",")
        return Array(parsed(inner), int(size))
    return Vec(parsed(found[2])) if found[1] == "vec" else Option(parsed(found[2]))


def _reader(kind: Kind):
    kind = parsed(kind)
    match kind:
        case Vec(of):
            return _Many(_reader(of), None)
        case Array(of, size):
            return _Many(_reader(of), size)
        case Option(of):
            inner = parsed(of)
            if isinstance(inner, Option):
                raise AbiError("an option of an option cannot be told from null")
            return _Maybe(_reader(inner))
        case Struct(fields):
            return _Record([n for n, _ in fields], [_reader(k) for _, k in fields])
        case Enum(variants):
            return _Choice([(n, _Record([f for f, _ in fields], [_reader(k) for _, k in fields]) if fields else None) for n, fields in variants])
        case str() if kind in _NUMBERS:
            form, shown = _NUMBERS[kind]
            return _Plain(shown, _number(form), struct.calcsize(form))
        case str() if kind in _WIDE:
            size, signed, shown = _WIDE[kind]
            return _Plain(shown, _wide(size, signed, shown == "string"), size)
        case "pubkey":
            return _Plain("string", _bytes(32), 32, base58.encode)
        case "string":
            return _Plain("string", _bytes(None), 4, lambda values: [None if v is None else v.decode("utf-8", "replace") for v in values])
        case "bytes":
            return _Plain("binary", _bytes(None), 4)
    raise AbiError(f"{kind} is no type of instruction data")


def read_layout(data: Column, fields: Sequence[tuple[str, Kind]]) -> Column:
    """Binary data as a struct of fields and _error: fields are read one behind the other, each where the last one ended.
    Null data give null. Where data end early or a tag is unknown, the fields are null and _error says so; bytes behind
    the last field are passed over. Wide numbers: u64 as DECIMAL(20,0), 128 bits as decimal text; keys in base58."""
    record = _reader(Struct(tuple(fields)))
    inner = [f"`{n}`:{c.ddl}" for n, c in zip(record.names, record.children, strict=True)]

    @arrow_udf(f"struct<{','.join([*inner, '_error:string'])}>")
    def read(batch: pa.Array) -> pa.Array:
        mine, errors, null = _reader(Struct(tuple(fields))), [], []
        for value in batch.to_pylist():
            error = None
            if value is None:
                mine.none()
            else:
                mark = mine.mark()
                try:
                    mine.read(value, 0)
                except ShortData:
                    mine.back(mark)
                    mine.none()
                    error = "data end early"
            errors.append(error)
            null.append(value is None)
        columns = mine.column().flatten() if mine.children else []
        return pa.StructArray.from_arrays([*columns, pa.array(errors, pa.string())], [*mine.names, "_error"], mask=pa.array(null, pa.bool_()))

    return read(data)
