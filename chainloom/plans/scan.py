"""Declarative scans: filter lists by block range, chosen fields and related entities, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.plans.ranges import Range

#: Lists longer than this become a semi-join instead of a literal list.
LITERAL_VALUES = 1_000


@dataclass(frozen=True)
class Request:
    """Rows of an entity within a range whose columns take one of the listed values: AND across columns, OR within a
    list, no condition for an empty one. Text is compared in lower case; where it is stored so (stored_lower, as
    sources.schemas.entities does), plainly, so that lists of text reach the files as well. include names related entities."""

    range: Range = Range(0)
    where: Mapping[str, Sequence] = field(default_factory=dict)
    include: tuple[str, ...] = ()

    def matches(self, block: str, stored_lower: bool = False) -> Column:
        parts = [self.range.covers(block)]
        for column, values in self.where.items():
            values = list(values) if isinstance(values, (list, tuple, set, frozenset)) else [values]
            if values:
                text = all(isinstance(v, str) for v in values)
                parts.append((F.lower(column) if text and not stored_lower else F.col(column)).isin([v.lower() for v in values] if text else values))
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class Relation:
    """Rows of entity to whose keys equal those of a matched row; under a path, also those below (children) or above
    (parents) it in the tree that the arrays in the path column spell."""

    to: str
    keys: tuple[str, ...]
    path: str | None = None
    side: str = "children"


def any_of(requests: Iterable[Request], block: str, stored_lower: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [r.matches(block, stored_lower) for r in requests], F.lit(False))


def within(requests: Iterable[Request], block: str, key: tuple[str, int] | None = None) -> Column:
    """Blocks of the requests' ranges, as file scans can check them. key: (column, width), if the block is that stored
    column divided by width."""
    column, width = key or (block, 1)
    parts = []
    for r in requests:
        mine = F.col(column) >= r.range.start * width
        parts.append(mine if r.range.stop is None else mine & (F.col(column) <= r.range.stop * width + width - 1))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def bounding(requests: Iterable[Request], block: str, key: tuple[str, int] | None = None, stored_lower: bool = False) -> Column:
    """What every match fulfils, in terms that file scans can check: ranges and lists of numbers; of text only where it is
    stored in lower case, since a scan cannot ignore case."""
    parts = []
    for r in requests:
        mine = within([r], block, key)
        for name, values in r.where.items():
            values = list(values) if isinstance(values, (list, tuple, set, frozenset)) else [values]
            if values and (stored_lower or not isinstance(values[0], str)):
                mine &= F.col(name).isin([v.lower() if isinstance(v, str) else v for v in values])
        parts.append(mine)
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def scan(rows: DataFrame, requests: Sequence[Request], fields: Sequence[str] | None = None, block: str = "block_number", key: tuple[str, int] | None = None, stored_lower: bool = False) -> DataFrame:
    """Rows that any request matches, once each, with the chosen fields. The bounds and lists reach the file scan."""
    found = rows.filter(bounding(requests, block, key, stored_lower)).filter(any_of(requests, block, stored_lower))
    return found.select(*dict.fromkeys([block, *fields])) if fields else found


def in_list(rows: DataFrame, column: str, values: DataFrame | Sequence) -> DataFrame:
    """Rows whose column is listed: a literal list while it is short, else a semi-join whose strategy Spark picks by size."""
    if not isinstance(values, DataFrame):
        values = list(dict.fromkeys(values))
        if len(values) <= LITERAL_VALUES:
            return rows.filter(F.col(column).isin(values))
        values = rows.sparkSession.createDataFrame([(v,) for v in values], [column])
    return rows.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")


def by_prefix(above: DataFrame, below: DataFrame, keys: Sequence[str], path: str, strict: bool = True) -> DataFrame:
    """Pairs of rows with equal keys where the path of above begins the path of below, as structs above and below.

    The keys carry the join; the prefix is checked within them.
    """
    a = above.select(*keys, F.struct("*").alias("above"))
    b = below.select(*keys, F.struct("*").alias("below"))
    short, long = F.col(f"above.{path}"), F.col(f"below.{path}")
    fits = (F.size(long) > F.size(short)) if strict else (F.size(long) >= F.size(short))
    return a.join(b, list(keys)).filter(fits & (F.slice(long, 1, F.greatest(F.size(short), F.lit(1))) == short)).select(*keys, "above", "below")


def related(matched: DataFrame, entity: DataFrame, relation: Relation) -> DataFrame:
    """Rows of an entity that relate to a matched row."""
    if relation.path is None:
        return entity.join(matched.select(*relation.keys).distinct(), list(relation.keys), "left_semi").select(*entity.columns)
    up = relation.side == "parents"
    pairs = by_prefix(entity if up else matched, matched if up else entity, relation.keys, relation.path)
    side = "above" if up else "below"
    return pairs.select(f"{side}.*").distinct()


def scan_all(tables: Mapping[str, DataFrame], requests: Mapping[str, Sequence[Request]], relations: Mapping[tuple[str, str], Relation], fields: Mapping[str, Sequence[str]] | None = None, block: str = "block_number", key: tuple[str, int] | None = None, stored_lower: bool = False) -> dict[str, DataFrame]:
    """For each entity the rows that its requests match or that relate to a match of another, as often as they occur.

    relations: by (entity of the match, name in include). What an entity's own requests match is a plain scan, with ranges
    and lists pushed to the files. What is included comes by a semi-join with the keys of the matches, over rows that don't
    match themselves, so no row comes twice and none is carried along to be dropped later; where the keys hold the block,
    the ranges of the requests bound the files of that read too. An entity is read once for its own requests, once for
    all inclusions with the same keys, and once more for relations along a path.
    """
    wanted: dict[str, list[tuple[Relation, DataFrame, Column]]] = {entity: [] for entity in requests}
    for entity, asked in requests.items():
        for name in dict.fromkeys(n for r in asked for n in r.include):
            link = relations[entity, name]
            asking = [r for r in asked if name in r.include]
            bounds = within(asking, block, key) if block in link.keys or (key and key[0] in link.keys) else F.lit(True)
            wanted.setdefault(link.to, []).append((link, scan(tables[entity], asking, block=block, key=key, stored_lower=stored_lower), bounds))
    out = {}
    for entity, links in wanted.items():
        rows, asked = tables[entity], requests.get(entity, ())
        parts = [scan(rows, asked, block=block, key=key, stored_lower=stored_lower)] if asked else []
        rest = rows.filter(~F.coalesce(any_of(asked, block, stored_lower), F.lit(False))) if asked else rows
        by_keys: dict[tuple[str, ...], list[tuple[DataFrame, Column]]] = {}
        for link, matched, bounds in links:
            on = (*link.keys, *([link.path] if link.path else []))
            found = related(matched, rows.filter(bounds), link) if link.path else matched
            by_keys.setdefault(on, []).append((found.select(*on), bounds))
        for on, found in by_keys.items():
            keys = reduce(DataFrame.unionByName, [k for k, _ in found]).distinct()
            bounds = reduce(lambda a, b: a | b, [c for _, c in found])
            parts.append(rest.filter(bounds).join(keys, list(on), "left_semi").select(*rows.columns))
            rest = rest.join(keys, list(on), "left_anti") if len(by_keys) > 1 else rest
        rows = reduce(DataFrame.unionByName, parts) if parts else rows.limit(0)
        chosen = (fields or {}).get(entity)
        out[entity] = rows.select(*dict.fromkeys([block, *chosen])) if chosen else rows
    return out


def collected(rows: DataFrame, others: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """rows with an array of the other rows of their keys, empty where there are none; the keys are those of one
    transaction, whose rows are few."""
    grouped = others.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in others.columns if c not in keys))).alias(name))
    joined = rows.join(grouped, list(keys), "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def with_all_blocks(blocks: DataFrame, rows: DataFrame, number: str = "number", block: str = "block_number") -> DataFrame:
    """Every block with the rows it has, or nulls: the scan that also returns blocks without matches."""
    return blocks.join(rows, blocks[number] == rows[block], "left").drop(rows[block])
