"""Program instructions: base58 by Arrow batches, then fields by column expressions over hex."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from chainloom.errors import AbiError, DiscriminatorError
from chainloom.functions import base58
from chainloom.functions.layout import Kind, read_layout

# Sizes of plain types in bytes.
SIZES = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "u128": 16, "i64": 8, "bool": 1, "pubkey": 32}


def b58_to_hex(text: str) -> str | None:
    found = base58.decode([None if text is None else text.encode("utf-8", "replace")])[0]
    return None if found is None else found.hex()


def hex_to_b58(text: str) -> str | None:
    return base58.encode([None if text is None else bytes.fromhex(text)])[0]


@arrow_udf(StringType())
def b58hex(texts: pa.Array) -> pa.Array:
    found = base58.decode(texts.cast(pa.binary()).to_pylist())
    return pa.array([None if x is None else x.hex() for x in found], pa.string())


@arrow_udf(StringType())
def hexb58(texts: pa.Array) -> pa.Array:
    return pa.array(base58.encode([None if x is None else bytes.fromhex(x) for x in texts.to_pylist()]), pa.string())


@dataclass(frozen=True)
class Instruction:
    """An instruction of a program: the hex of its discriminator, its accounts by place and its fields in order. A field's
    type is plain, 'option<plain>' as the last, or any of functions.layout: strings, vectors, options, structs, enums."""

    name: str
    discriminator: str
    accounts: tuple[str, ...] = ()
    fields: tuple[tuple[str, Kind], ...] = ()

    @property
    def fixed(self) -> bool:
        """Whether columns can cut the fields out by place."""
        plain = [k for _, k in self.fields[:-1]] + [k[7:-1] if isinstance(k, str) and k.startswith("option<") else k for _, k in self.fields[-1:]]
        return all(isinstance(k, str) and k in SIZES for k in plain)


# Instructions of the token program.
TOKEN_PROGRAM = (
    Instruction("transfer", "03", ("source", "destination", "authority"), (("amount", "u64"),)),
    Instruction("approve", "04", ("source", "delegate", "owner"), (("amount", "u64"),)),
    Instruction("revoke", "05", ("source", "owner")),
    Instruction("setAuthority", "06", ("owned", "owner"), (("authorityType", "u8"), ("newAuthority", "option<pubkey>"))),
    Instruction("mintTo", "07", ("mint", "account", "mintAuthority"), (("amount", "u64"),)),
    Instruction("burn", "08", ("account", "mint", "authority"), (("amount", "u64"),)),
    Instruction("closeAccount", "09", ("account", "destination", "owner")),
    Instruction("freezeAccount", "0a", ("account", "mint", "authority")),
    Instruction("thawAccount", "0b", ("account", "mint", "authority")),
    Instruction("transferChecked", "0c", ("source", "mint", "destination", "authority"), (("amount", "u64"), ("decimals", "u8"))),
    Instruction("approveChecked", "0d", ("source", "mint", "delegate", "owner"), (("amount", "u64"), ("decimals", "u8"))),
    Instruction("mintToChecked", "0e", ("mint", "account", "mintAuthority"), (("amount", "u64"), ("decimals", "u8"))),
    Instruction("burnChecked", "0f", ("account", "mint", "authority"), (("amount", "u64"), ("decimals", "u8"))),
    Instruction("syncNative", "11", ("account",)),
)


def check_discriminators(instructions: Sequence[Instruction]) -> int:
    """Their common width in bytes; they must differ and be of one width."""
    widths = {len(i.discriminator) for i in instructions}
    if len(widths) != 1 or len({i.discriminator for i in instructions}) != len(instructions):
        raise DiscriminatorError("discriminators must differ and have one width")
    return widths.pop() // 2


def little_endian(data: Column, start: int, size: int) -> Column:
    """The unsigned number in size bytes of hex from byte start: LONG up to 4 bytes, DECIMAL(20,0) for 8, (38,0) for 16."""
    turned = F.concat(*(F.substring(data, 2 * (start + k) + 1, 2) for k in reversed(range(size))))
    if size <= 4:
        return F.conv(turned, 16, 10).cast("long")
    low = F.conv(F.right(turned, F.lit(16)), 16, 10).cast("decimal(20,0)")
    if size == 8:
        return low
    high = F.conv(F.substring(turned, 1, 16), 16, 10).cast("decimal(20,0)")
    return (high.cast("decimal(38,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _field(data: Column, start: int, kind: str) -> Column:
    if kind == "pubkey":
        return hexb58(F.substring(data, 2 * start + 1, 64))
    if kind == "bool":
        return F.substring(data, 2 * start + 1, 2) != "00"
    if kind == "i64":
        value = little_endian(data, start, 8)
        return F.when(value >= F.lit(str(2**63)).cast("decimal(20,0)"), value - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(value).cast("long")
    if kind in SIZES:
        return little_endian(data, start, SIZES[kind])
    raise AbiError(f"{kind} is no plain type")


def instruction_filter(program: str, instructions: Sequence[Instruction] = (), accounts: Mapping[int, Sequence[str]] | None = None, hex_data: str = "data_hex") -> Column:
    """Instructions of a program that begin with one of the discriminators and have listed accounts at the places given."""
    found = F.col("programId") == program
    if instructions:
        width = check_discriminators(instructions)
        found &= F.substring(hex_data, 1, 2 * width).isin([i.discriminator for i in instructions])
    for place, values in (accounts or {}).items():
        found &= F.get("accounts", F.lit(place)).isin(list(values))
    return found


def decode_instructions(rows: DataFrame, program: str, instructions: Sequence[Instruction], data: str = "data") -> DataFrame:
    """rows(programId, accounts, data in base58) with instruction (its name; others go), and for each a struct of its
    accounts and fields. Data too short for the fields set decode_error instead of failing the job. Fields of fixed size
    are cut out by column expressions; instructions with others are read by one Arrow function each."""
    width = check_discriminators(instructions)
    raw = F.col("data_hex")
    found = rows.filter(F.col("programId") == program).withColumn("data_hex", b58hex(data)).filter(instruction_filter(program, instructions))
    name, need, unread = F.lit(None).cast("string"), F.lit(0), F.lit(None).cast("string")
    columns = []
    for i in instructions:
        mine = F.substring(raw, 1, 2 * width) == i.discriminator
        if not i.fixed:
            place = f"_read_{i.name}"
            found = found.withColumn(place, read_layout(F.when(mine, F.unhex(F.substring(raw, 2 * width + 1, 2_000_000_000))), i.fields))
            parts = [F.get("accounts", F.lit(k)).alias(a) for k, a in enumerate(i.accounts)] + [F.col(place)[f].alias(f) for f, _ in i.fields]
            name, unread = F.when(mine, i.name).otherwise(name), F.coalesce(unread, F.col(place)["_error"])
            columns.append(F.when(mine & F.col(place)["_error"].isNull(), F.struct(*parts)).alias(i.name))
            continue
        parts, at = [F.get("accounts", F.lit(k)).alias(a) for k, a in enumerate(i.accounts)], width
        for field, kind in i.fields:
            if kind.startswith("option<"):
                inner = kind[7:-1]
                parts.append(F.when(F.substring(raw, 2 * at + 1, 2) == "01", _field(raw, at + 1, inner)).alias(field))
                at += 1
            else:
                parts.append(_field(raw, at, kind).alias(field))
                at += SIZES[kind]
        name, need = F.when(mine, i.name).otherwise(name), F.when(mine, at).otherwise(need)
        fits = F.length(raw) >= 2 * at
        columns.append(F.when(mine & fits, F.struct(*parts) if parts else F.struct(F.lit(True).alias("present"))).alias(i.name))
    out = found.withColumn("instruction", name).withColumn("decode_error", F.when(F.length(raw) < 2 * need, F.lit("data end early")).otherwise(unread))
    return out.select(*(c for c in out.columns if not c.startswith("_read_")), *columns)
