"""Canonical JSON: one text for one value, whatever the order of columns, with whole numbers exact and nothing made up."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from chainloom.errors import CanonicalError

#: Whole doubles beyond this may stand for another whole number than was meant.
SAFE = 2**53 - 1
Writer = Callable[[object, str], str]


def _units(key: str) -> bytes:
    """Keys are in the order of their UTF-16 units."""
    return key.encode("utf-16-be", "surrogatepass")


def _number(v: float, path: str) -> str:
    """The shortest decimal that is read back as the same double, without a fraction or exponent where it needs none."""
    if not math.isfinite(v):
        raise CanonicalError(path, f"{v} is no JSON number")
    if v == int(v):
        if abs(v) > SAFE:
            raise CanonicalError(path, f"{v} is whole but beyond 2^53 - 1; give it as a whole number or as text")
        return str(int(v))
    digits, _, exponent = repr(v).partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, fraction = digits.partition(".")
    point, digits = len(whole) + int(exponent or 0), (whole + fraction)
    point, digits = point - (len(digits) - len(digits.lstrip("0"))), digits.strip("0")
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    tail = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{point - 1:+d}"


def _text(v: str) -> str:
    return json.dumps(v, ensure_ascii=False)


def _instant(v: datetime, _: str) -> str:
    v = v.astimezone(UTC) if v.tzinfo else v
    return f'"{v:%Y-%m-%dT%H:%M:%S}.{v.microsecond // 1000:03d}Z"'


def _writer(kind: T.DataType, path: str) -> Writer:
    """What writes values of a type; a type without a canonical form is refused here, before any row is read."""
    match kind:
        case T.BooleanType():
            return lambda v, _: "true" if v else "false"
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return lambda v, _: str(v)
        case T.LongType():
            return lambda v, _: f'"{v}"'
        case T.DecimalType():
            return lambda v, _: f'"{v:f}"'
        case T.FloatType() | T.DoubleType():
            return _number
        case T.StringType() | T.VarcharType() | T.CharType():
            return lambda v, _: _text(v)
        case T.BinaryType():
            return lambda v, _: f'"0x{v.hex()}"'
        case T.TimestampType() | T.TimestampNTZType():
            return _instant
        case T.DateType():
            return lambda v, _: f'"{v.isoformat()}"'
        case T.ArrayType():
            inner = _nullable(_writer(kind.elementType, f"{path}[]"))
            return lambda v, at: f"[{','.join(inner(x, f'{at}[{k}]') for k, x in enumerate(v))}]"
        case T.MapType():
            if not isinstance(kind.keyType, T.StringType):
                raise CanonicalError(path, "a map has text for keys")
            inner = _nullable(_writer(kind.valueType, f"{path}.*"))
            return lambda v, at: "{" + ",".join(f"{_text(k)}:{inner(x, f'{at}.{k}')}" for k, x in sorted(v, key=lambda e: _units(e[0]))) + "}"
        case T.StructType():
            names = sorted(kind.names, key=_units)
            if len(set(names)) != len(names):
                raise CanonicalError(path, "two fields share a name")
            fields = [(n, _text(n), _nullable(_writer(kind[n].dataType, f"{path}.{n}"))) for n in names]
            return lambda v, at: "{" + ",".join(f"{shown}:{write(v[n], f'{at}.{n}')}" for n, shown, write in fields) + "}"
    raise CanonicalError(path, f"{kind.simpleString()} has no canonical form")


def _nullable(write: Writer) -> Writer:
    return lambda v, at: "null" if v is None else write(v, at)


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A column of the type given as text: the same value gives the same bytes, whatever the order of its fields.

    Keys at every depth in the order of their UTF-16 units; no white space; text escaped only where JSON must. Whole
    numbers of 64 bits and decimals are text in decimal, smaller ones are numbers; doubles are their shortest decimal, and
    -0 is 0. Bytes are hex behind 0x; instants are UTC to the millisecond. Null is null, in fields and elements too. Not
    finite doubles, and whole ones beyond 2^53 - 1, fail the job with their path; types without a form (intervals,
    variants, maps whose keys are no text) are refused at once. A null value gives null.
    """
    _writer(kind, "$")

    @arrow_udf(T.StringType())
    def written(batch: pa.Array) -> pa.Array:
        write = _writer(kind, "$")
        return pa.array([None if v is None else write(v, "$") for v in batch.to_pylist()], pa.string())

    return written(value)

