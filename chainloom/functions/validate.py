"""Rows against declared columns: one expression that names the first value that does not fit, however deep it lies."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.errors import RowError

INT32 = 2**31 - 1


@dataclass(frozen=True)
class Leaf:
    """A value of a kind: INT32, INT64, DOUBLE, BOOLEAN, UTF8, BYTE_ARRAY (hex text is refused), HEX (0x and whole bytes),
    TIMESTAMP or DATE (neither before 1970)."""

    kind: str
    optional: bool = False


@dataclass(frozen=True)
class Items:
    of: Declared
    optional: bool = False


@dataclass(frozen=True)
class Group:
    fields: Mapping[str, Declared]
    optional: bool = False


Declared = Leaf | Items | Group

# What a value of each kind must be, and how it is told where it is not.
_KINDS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column] | None, str]] = {
    "INT32": (("tinyint", "smallint", "int", "bigint", "decimal"), lambda v: (v >= -INT32 - 1) & (v <= INT32), "is out of INT32 range"),
    "INT64": (("tinyint", "smallint", "int", "bigint", "decimal"), lambda v: (v >= F.lit(str(-(2**63))).cast("decimal(20,0)")) & (v <= F.lit(str(2**63 - 1)).cast("decimal(20,0)")), "is out of INT64 range"),
    "DOUBLE": (("float", "double", "tinyint", "smallint", "int"), None, ""),
    "BOOLEAN": (("boolean",), None, ""),
    "UTF8": (("string",), None, ""),
    "BYTE_ARRAY": (("binary",), None, ""),
    "HEX": (("string",), lambda v: v.rlike("^0x([0-9a-fA-F]{2})*$"), "is no hex of whole bytes"),
    "TIMESTAMP": (("timestamp", "timestamp_ntz"), lambda v: F.year(v) >= 1970, "is before 1970"),
    "DATE": (("date",), lambda v: F.unix_date(v) >= 0, "is before 1970"),
}


def _problem(value: Column, spark_type: T.DataType, declared: Declared, path: Column, place: str) -> Column:
    """Null where a value of a Spark type fits, else its path and what is wrong."""
    missing = F.lit(None).cast("string") if declared.optional else F.concat(path, F.lit(" is required but null"))
    match declared:
        case Group(fields):
            if not isinstance(spark_type, T.StructType) or set(fields) - set(spark_type.names):
                raise RowError(f"{place} is {spark_type.simpleString()}, declared a group of {sorted(fields)}")
            parts = [_problem(value[n], spark_type[n].dataType, d, F.concat(path, F.lit(f".{n}")), f"{place}.{n}") for n, d in fields.items()]
            inner = F.coalesce(*parts, F.lit(None).cast("string"))
        case Items(of):
            if not isinstance(spark_type, T.ArrayType):
                raise RowError(f"{place} is {spark_type.simpleString()}, declared a list")
            found = F.transform(value, lambda x, k: _problem(x, spark_type.elementType, of, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), f"{place}[]"))
            inner = F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
        case Leaf(name):
            types, fits, said = _KINDS[name]
            if spark_type.simpleString().partition("(")[0] not in types:
                raise RowError(f"{place} is {spark_type.simpleString()}, declared {name}")
            inner = F.when(~fits(value), F.concat(path, F.lit(f" {said}"))) if fits else F.lit(None).cast("string")
    return F.when(value.isNull(), missing).otherwise(inner)


def first_problem(rows: DataFrame, columns: Mapping[str, Declared]) -> Column:
    """For each row the path of the first value, in the order declared, that does not fit, and why; null for good rows.

    Paths are as in logs.topics[2]. All in column expressions, in the pass that writes the rows. Columns whose type can
    never fit, or that are missing, raise RowError before any row is read; columns not declared are not looked at."""
    if lacking := sorted(set(columns) - set(rows.columns)):
        raise RowError(f"no columns {lacking}")
    return F.coalesce(*(_problem(F.col(n), rows.schema[n].dataType, d, F.lit(n), n) for n, d in columns.items()), F.lit(None).cast("string"))


def checked(rows: DataFrame, columns: Mapping[str, Declared], table: str = "table") -> DataFrame:
    """rows as they are; one that does not fit fails the job that reads them, with table and path."""
    problem = first_problem(rows, columns)
    message = F.concat(F.lit(f"[{RowError.code}] {table}: "), problem)
    return rows.filter(F.when(problem.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
