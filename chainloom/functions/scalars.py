"""Column functions for chain data: addresses, amounts, timestamps, scripts, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script types and their kinds.
SCRIPT_KINDS = {
    "pubkeyhash": "P2PKH", "scripthash": "P2SH", "witness_v0_keyhash": "P2WPKH", "witness_v0_scripthash": "P2WSH",
    "witness_v1_taproot": "P2TR", "nulldata": "OP_RETURN", "multisig": "multisig", "pubkey": "p2pk",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def topic_address(topic: Column | str, prefix: str = "0x") -> Column:
    """The address in the last 20 bytes of a topic."""
    return F.concat(F.lit(prefix), F.lower(F.right(_c(topic), F.lit(40))))


def seconds(value: Column | str) -> Column:
    """Seconds since 1970 from seconds or milliseconds; null outside 2001 to 2096."""
    v = _c(value)
    s = F.when(v >= 10**12, F.floor(v / 1000)).otherwise(v)
    return F.when((s >= 10**9) & (s <= 4 * 10**9), s).cast("long")


def scaled(amount: Column | str, decimals: Column | str | int) -> Column:
    """An integer amount as a number of whole tokens."""
    return _c(amount).cast("double") / F.pow(F.lit(10.0), F.lit(decimals) if isinstance(decimals, int) else _c(decimals))


def script_kind(kind: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SCRIPT_KINDS.items() for x in pair))
    return F.coalesce(F.element_at(table, _c(kind)), F.lit("unknown"))


def return_payload(asm: Column | str) -> Column:
    """The payload of an OP_RETURN script: as text if all of it is printable, else as 0x and hex."""
    word = F.regexp_extract(_c(asm), r"^OP_RETURN\s+([0-9a-fA-F]+)", 1)
    text = F.decode(F.unhex(word), "ISO-8859-1")
    return F.when(word == "", None).when(text.rlike(r"^[\x20-\x7E]+$"), text).otherwise(F.concat(F.lit("0x"), F.lower(word)))


def data_prefix(data: Column | str, size: int) -> Column:
    """The first bytes of hex data as 0x and hex, null if there are fewer."""
    raw = F.regexp_replace(F.lower(_c(data)), "^0x", "")
    return F.when(F.length(raw) >= 2 * size, F.concat(F.lit("0x"), F.substring(raw, 1, 2 * size)))


def block_name(number: Column | str) -> Column:
    return F.lpad(_c(number).cast("string"), 12, "0")


def row_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(_c(p).cast("string") for p in parts))


def sequence_hex(number: Column | str) -> Column:
    return F.hex(_c(number).cast("long"))


def status_class(status: Column | str) -> Column:
    s = _c(status)
    return F.when((s >= 200) & (s < 300), "success").when(s == 429, "rate_limited").otherwise("failed")


def sorted_map(m: Column | str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(_c(m))))


def varint_size(n: Column | str) -> Column:
    """Bytes of a protobuf varint."""
    bounds = [2 ** (7 * k) for k in range(1, 9)]
    return reduce(lambda a, b: a + b, [(_c(n) >= b).cast("int") for b in bounds], F.lit(1))


def parsed_number(text: Column | str) -> Column:
    """A whole number with , or _ between digits."""
    return F.regexp_replace(_c(text), "[,_]", "").cast("long")


def clamped(value: Column | str, least: float, most: float) -> Column:
    """A number held within bounds; null stays null."""
    return F.when(_c(value).isNotNull(), F.least(F.greatest(_c(value), F.lit(least)), F.lit(most)))


def date_parts(at: Column | str) -> list[Column]:
    """day, ms (rounded down) and us since 1970 of a timestamp taken as UTC: what files of dated rows hold."""
    t = _c(at).cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    return [F.unix_date(t.cast("date")).alias("day"), F.floor(us / 1000).alias("ms"), us.alias("us")]
