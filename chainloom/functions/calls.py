"""Contract functions: calls and what they return, decoded by the 4-byte selector in front of the input."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.errors import AbiError
from chainloom.functions.abi import Param, params_of, places, plain_hex, read, selector, words


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple[Param, ...] = ()
    outputs: tuple[Param, ...] = ()

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(p.type for p in self.params)})"

    @property
    def selector(self) -> str:
        return selector(self.signature)


def functions_of(description: str | Iterable[Mapping]) -> dict[str, Function]:
    """Functions of a JSON description by name: of overloads the first; unnamed parameters and outputs by place."""
    entries = json.loads(description) if isinstance(description, str) else description
    entries = entries["abi"] if isinstance(entries, Mapping) else entries
    found: dict[str, Function] = {}
    for e in entries:
        if e.get("type", "function") == "function":
            found.setdefault(e["name"], Function(e["name"], params_of(e.get("inputs", ())), params_of(e.get("outputs", ()))))
    return found


def _out(kind: str) -> tuple[Param, ...]:
    return (Param("_0", kind),)


# The functions of an ERC-20 token.
ERC20_FUNCTIONS = {
    f.name: f
    for f in (
        Function("name", (), _out("string")),
        Function("approve", (Param("_spender", "address"), Param("_value", "uint256")), _out("bool")),
        Function("totalSupply", (), _out("uint256")),
        Function("transferFrom", (Param("_from", "address"), Param("_to", "address"), Param("_value", "uint256")), _out("bool")),
        Function("decimals", (), _out("uint8")),
        Function("balanceOf", (Param("_owner", "address"),), _out("uint256")),
        Function("symbol", (), _out("string")),
        Function("transfer", (Param("_to", "address"), Param("_value", "uint256")), _out("bool")),
        Function("allowance", (Param("_owner", "address"), Param("_spender", "address")), _out("uint256")),
    )
}


def call_filter(functions: Iterable[Function], sighash: str = "callSighash") -> Column:
    """Calls of one of the functions, by the selector that traces carry in a column of its own, which files can be asked for."""
    return F.col(sighash).isin([f.selector for f in functions])


def _struct(body: Column, params: Sequence[Param], start: int) -> list[Column]:
    base = F.lit(start)
    return [read(body, place, base, p).alias(p.name) for p, place in places(base, params)]


def decode_calls(calls: DataFrame, functions: Sequence[Function], data: str = "callInput", returned: str = "callResultOutput", on_error: str = "fail") -> DataFrame:
    """calls with function (the name of the one whose selector the input begins with; other calls go), and for each a struct
    of its parameters and result, null on calls of others. One output is the result itself, several are a struct, none is
    null; so is the result of a call that returned nothing (null or bare 0x: it failed, or only its input is known).

    Calls stand alone, wherever in the tree of their transaction they are: nested calls of the functions are found like any
    other. Inputs that end before a function's head do: on_error 'fail' ends the job, 'drop' leaves the call out, 'keep'
    keeps it without values; the last adds decode_error, which also tells where only the result ends early (kept as null).
    Functions that no input can tell apart are refused.
    """
    by_selector: dict[str, str] = {}
    for f in functions:
        if by_selector.setdefault(f.selector, f.signature) != f.signature or sum(g.selector == f.selector for g in functions) > 1:
            raise AbiError(f"no input tells these functions apart: {by_selector[f.selector]}, {f.signature}")
    pick = lambda values, default: reduce(lambda acc, item: F.when(F.col("_name") == item[0], item[1]).otherwise(acc), values.items(), default)
    names = F.create_map(*(F.lit(x) for f in functions for x in (f.selector[2:], f.name)))
    rows = calls.withColumn("_in", plain_hex(data)).withColumn("_name", F.try_element_at(names, F.substring("_in", 1, 8)))
    rows = rows.filter("_name is not null").withColumn("_out", F.nullif(plain_hex(returned), F.lit("")))
    short = F.length("_in") < 8 + 64 * pick({f.name: words(f.params) for f in functions}, F.lit(0))
    cut = F.length("_out") < 64 * pick({f.name: words(f.outputs) for f in functions}, F.lit(0))
    if on_error == "drop":
        rows = rows.filter(~short)
    elif on_error == "fail":
        rows = rows.withColumn("_name", F.when(short, F.raise_error(F.concat(F.lit("the input of a call ends early: "), F.col("_name")))).otherwise(F.col("_name")))
    error = F.when(short, F.lit("input ends early")).when(F.coalesce(cut, F.lit(False)), F.lit("result ends early"))
    columns = []
    for f in functions:
        if any(p.name == "result" for p in f.params):
            raise AbiError(f"{f.signature} has a parameter named as its result")
        whole = F.col("_out").isNotNull() & ~cut
        parts = _struct(F.col("_out"), f.outputs, 0)
        result = F.when(whole, parts[0] if len(parts) == 1 else F.struct(*parts)) if parts else F.lit(None).cast("string")
        mine = (F.col("_name") == f.name) & ~short
        columns.append(F.when(mine, F.struct(*_struct(F.col("_in"), f.params, 8), result.alias("result"))).alias(f.name))
    kept = [F.col(c) for c in calls.columns] + [F.col("_name").alias("function")] + ([error.alias("decode_error")] if on_error == "keep" else [])
    return rows.select(*kept, *columns)
