"""Contracts found while the chain is read: a registry of children by creation event, and joins against it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.revisions import earliest_per_key


def first_registrations(events: DataFrame, child: str, order: Sequence[str]) -> DataFrame:
    """The earliest creation event of each child, by the order columns; children that are null are skipped. One aggregate
    that combines before its shuffle."""
    return earliest_per_key(events.filter(F.col(child).isNotNull()), [child], order)


def allowed(registry: DataFrame, factory: str | None = None, factories: Sequence = (), params: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Registrations by one of the factories whose parameters have a listed value, compared as lower-case text."""
    if factory and factories:
        registry = registry.filter(F.lower(F.col(factory).cast("string")).isin([str(f).lower() for f in factories]))
    for name, values in (params or {}).items():
        values = values if isinstance(values, (list, tuple)) else [values]
        if values:
            registry = registry.filter(F.lower(F.col(name).cast("string")).isin([str(v).lower() for v in values]))
    return registry


def of_children(logs: DataFrame, registry: DataFrame, address: str, child: str, keep: Sequence[str], after: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """Logs of registered children, with the kept columns of their registration.

    Registrations are one row per child and Spark picks the join by their size. after: (columns of logs, columns of the
    registry) to demand that the registration came first, which the plain join does not.
    """
    columns = dict.fromkeys([child, *keep, *(after[1] if after else ())])
    right = registry.select(*(F.col(c).alias(f"_r_{c}") for c in columns))
    joined = logs.join(right, logs[address] == right[f"_r_{child}"])
    if after:
        joined = joined.filter(F.struct(*after[0]) > F.struct(*(F.col(f"_r_{c}") for c in after[1])))
    return joined.select(*logs.columns, *(F.col(f"_r_{c}").alias(c) for c in keep if c not in logs.columns))


def rolled_back(registry: DataFrame, block: str, safe: int) -> DataFrame:
    """The registry without what came after the safe block."""
    return registry.filter(F.col(block) <= safe)
