"""Approximate nearest neighbours by vantage-point trees per shard, under the upper levels of one tree over all."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.llm.common import Batches, in_slices, materialize, release
from chainloom.llm.vectors import matrix, packed, unpacked, usable

_SLACK = 1e-9
#: Components of the sample that routes are fitted on.
_SAMPLE_VALUES = 4_000_000


@dataclass
class Node:
    """A subtree over rows[start:stop] of the tree. Inner nodes have the number of a vantage point, and for
    the inner and the outer half the least and greatest distance from it; leaves have no halves."""

    start: int
    stop: int
    point: int = -1
    halves: tuple[tuple[float, float, Node], ...] = ()


class Tree:
    """A vantage-point tree over the rows of a matrix. Each split puts the half of the rows that is nearer to the vantage
    point, by distance and then by id, on the inner side; so equal rows split as well."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 64, seed: int = 0) -> None:
        self.ids, self.rows, self._leaf = ids.copy(), rows.copy(), leaf
        self._rng, self._points = np.random.default_rng(seed), []
        self.root = self._split(0, len(ids))

    def _split(self, start: int, stop: int) -> Node:
        node = Node(start, stop)
        if stop - start <= self._leaf:
            return node
        some = self._rng.choice(np.arange(start, stop), min(8, stop - start), replace=False)
        spread = [distances(self.rows[p : p + 1], self.rows[start:stop])[0].std() for p in some]
        node.point = int(some[int(np.argmax(spread))])
        point = self.rows[node.point].copy()
        d = distances(point[None, :], self.rows[start:stop])[0]
        order = np.lexsort((self.ids[start:stop], d))
        self.ids[start:stop], self.rows[start:stop], d = self.ids[start:stop][order], self.rows[start:stop][order], d[order]
        self._points.append(point)
        node.point = len(self._points) - 1
        middle = (start + stop) // 2
        node.halves = tuple((float(part[0]), float(part[-1]), self._split(a, b)) for a, b, part in ((start, middle, d[: middle - start]), (middle, stop, d[middle - start :])))
        return node

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids, comparisons): for each query its k nearest rows under other ids, ties to the smaller id; inf
        and -1 beyond the rows. A half is left out if every row in it must be farther than the k-th found, or than
        within, by the triangle inequality; the bound is multiplied by factor, so 1 is exact and more leaves out more."""
        self._within = np.full(len(queries), np.inf) if within is None else within
        self._d, self._i = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, np.int64)
        self._asked, self._q, self._k, self._factor, self._n = ids, queries, k, factor, 0
        self._visit(self.root, np.arange(len(queries)))
        return self._d, self._i, self._n

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if not node.halves:
            self._compare(node, who)
            return
        d = distances(self._q[who], self._points[node.point][None, :])[:, 0]
        self._n += len(who)
        (_, inner_far, inner), (outer_near, _, outer) = node.halves
        nearer_inside = d <= (inner_far + outer_near) / 2
        for group, sides in ((nearer_inside, node.halves), (~nearer_inside, node.halves[::-1])):
            mine, dist = who[group], d[group]
            for low, high, half in sides:
                gap = np.maximum(np.maximum(low - dist, dist - high), 0)
                reach = np.minimum(self._d[mine, -1], self._within[mine])
                self._visit(half, mine[self._factor * gap <= reach * (1 + _SLACK)])

    def _compare(self, node: Node, who: np.ndarray) -> None:
        rows, names = self.rows[node.start : node.stop], self.ids[node.start : node.stop]
        for some in np.array_split(who, max(1, len(who) * len(rows) * rows.shape[1] // 4_000_000)):
            if not len(some):
                continue
            d = distances(self._q[some], rows)
            self._n += d.size
            d[self._asked[some][:, None] == names[None, :]] = np.inf
            both = np.concatenate([self._d[some], d], axis=1)
            ids = np.concatenate([self._i[some], np.broadcast_to(names, d.shape)], axis=1)
            order = np.lexsort((ids, both), axis=1)[:, : self._k]
            self._d[some], self._i[some] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
        self._i[np.isinf(self._d)] = -1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a from all rows of b, from their differences."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


class Routes:
    """The upper levels of a tree, fitted on a sample: which leaf a row belongs to. Inner nodes have a vantage point and
    the distance that parts their halves; a negative child -k is leaf k - 1."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 0) -> None:
        self.points, self.limits, self.halves, self.leaves = [], [], [], 0
        self._rng = np.random.default_rng(seed)
        self.root = self._split(sample, leaves)

    def _split(self, rows: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(rows) >= 16:
            some = rows[self._rng.choice(len(rows), min(8, len(rows)), replace=False)]
            d = max((distances(p[None, :], rows)[0] for p in some), key=np.std)
            limit = float(np.median(d))
            if (d > limit).any():
                node = len(self.points)
                self.points.append(rows[int(np.argmin(d))])
                self.limits.append(limit)
                self.halves.append((0, 0))
                self.halves[node] = (self._split(rows[d <= limit], (leaves + 1) // 2), self._split(rows[d > limit], leaves // 2))
                return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each row, and its distances from the vantage points above, from the root down."""
        leaf, paths = np.zeros(len(rows), np.int32), [np.empty(0)] * len(rows)

        def walk(node: int, who: np.ndarray, above: list[np.ndarray]) -> None:
            if not len(who):
                return
            if node < 0:
                leaf[who] = -node - 1
                for k, w in enumerate(who.tolist()):
                    paths[w] = np.array([d[k] for d in above])
                return
            d = distances(rows[who], self.points[node][None, :])[:, 0]
            for inside, half in zip((d <= self.limits[node], d > self.limits[node]), self.halves[node], strict=True):
                walk(half, who[inside], [x[inside] for x in (*above, d)])

        walk(self.root, np.arange(len(rows)), [])
        return leaf, paths

    def above(self) -> list[list[int]]:
        """For each leaf the nodes above it, from the root down."""
        found: list[list[int]] = [[] for _ in range(self.leaves)]

        def walk(node: int, path: list[int]) -> None:
            if node < 0:
                found[-node - 1] = path
            else:
                for half in self.halves[node]:
                    walk(half, [*path, node])

        walk(self.root, [])
        return found


def fit_routes(rows: DataFrame, shard_rows: int, sample_rows: int) -> dict[int, Routes]:
    """Routes by dimension, fitted on a bounded sample: the rows with the smallest hash, sample_rows of them and
    _SAMPLE_VALUES components at most, 16 for a leaf; all else is one row per dimension."""
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    sample_rows = min(sample_rows, _SAMPLE_VALUES // max(sizes, default=1))
    some: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("dim", "v").collect():
        some.setdefault(r["dim"], []).append(r["v"])
    return {dim: Routes(np.array(some.get(dim, []), float).reshape(-1, dim), min(math.ceil(n / shard_rows), len(some.get(dim, [])) // 16)) for dim, n in sizes.items()}


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dimension, its rows, their vectors) of a batch of (dim, id, v, ...)."""
    dims = batch.column(0).to_numpy()
    for dim in np.unique(dims):
        mine = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield int(dim), mine, matrix(mine.column(2))


def _routed(routes: dict[int, Routes]):
    def of(batches: Batches) -> Batches:
        for batch in batches:
            for dim, mine, x in _by_dim(batch):
                leaf, paths = routes[dim].leaf_of(x)
                yield pa.record_batch([mine.column(0), mine.column(1), packed(x), mine.column(3), pa.array(leaf), pa.array(paths, pa.list_(pa.float64()))], names=["dim", "id", "v", "is_query", "leaf", "path"])

    return of


def _asks(routes: dict[int, Routes], spans: dict[tuple[int, int, int], tuple[float, float]], factor: float):
    """(dim, id, v, leaf, within) to a row for each other leaf that can hold a nearer row than within."""

    def of(batches: Batches) -> Batches:
        for batch in batches:
            dims, leaves, within = (batch.column(k).to_numpy() for k in (0, 3, 4))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                tree = routes[int(dim)]
                x = unpacked(batch.column(2).take(pa.array(mine)).to_pylist())
                d = np.stack([distances(x, p[None, :])[:, 0] for p in tree.points], axis=1) if tree.points else np.zeros((len(x), 0))
                for leaf, nodes in enumerate(tree.above()):
                    gap = np.zeros(len(x))
                    for level, node in enumerate(nodes):
                        low, high = spans.get((int(dim), leaf, level), (np.inf, np.inf))
                        gap = np.maximum(gap, np.maximum(low - d[:, node], d[:, node] - high))
                    some = mine[(factor * gap <= within[mine] * (1 + _SLACK)) & (leaves[mine] != leaf)]
                    rows = batch.take(pa.array(some))
                    yield pa.record_batch([rows.column(0), rows.column(1), rows.column(2), pa.array(np.full(len(some), leaf, np.int32)), rows.column(4)], names=["dim", "id", "v", "leaf", "within"])

    return of


def _search(k: int, factor: float, leaf: int):
    def of(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        rows, asked = rows.sort_values(["id", "v"], kind="stable"), asking["id"].to_numpy(np.int64)
        tree = Tree(rows["id"].to_numpy(np.int64), unpacked(rows["v"]), leaf=leaf)
        d, ids, _ = tree.search(asked, unpacked(asking["v"]), k, factor, asking["within"].to_numpy(float))
        have = np.isfinite(d.ravel())
        return pd.DataFrame({"query_id": np.repeat(asked, k)[have], "vec_id": ids.ravel()[have], "score": d.ravel()[have]})

    return of


def nearest(vectors: DataFrame, queries: Column, k: int = 10, factor: float = 1.0, shard_rows: int = 8_192, query_rows: int = 4_096, leaf: int = 64, sample_rows: int = 40_000) -> DataFrame:
    """For each row of vectors(vec_id, embedding) that the condition queries picks, its k nearest rows under other ids:
    query_id, rank (from 1), vec_id, score (Euclidean distance in double precision), nearest first, ties to the smaller
    vec_id; all rows if fewer.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part;
    vectors of another dimension are no candidates. Rows that repeat a query's id are its own and no candidates; other
    repeated rows count once per id and vector. No queries: no rows.

    The upper levels of one tree, fitted on a bounded sample, deal all rows to leaves; leaves of more than shard_rows are
    split by hash, and each shard is a tree of its own. A query first searches its own leaf, then the leaves that can
    hold nearer rows by the triangle inequality over the actual distances of their rows. A shard meets its queries in
    blocks of query_rows, so a task holds a shard and a block whatever the input; only k rows of a meeting leave. All
    pruning is relaxed by factor: 1 searches exactly, more leaves out more (see Tree.search).
    """
    rows = vectors.withColumn("is_query", F.coalesce(queries, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), "is_query")
    rows = materialize(rows.filter(usable("v") & F.col("id").isNotNull()).dropDuplicates(["id", "v"]).select(F.size("v").alias("dim"), "id", "v", "is_query"))
    routes = fit_routes(rows, shard_rows, sample_rows)
    routed = materialize(rows.mapInArrow(in_slices(_routed(routes)), "dim int, id long, v binary, is_query boolean, leaf int, path array<double>"))
    release(rows)
    ends = routed.select("dim", "leaf", F.posexplode("path").alias("level", "d")).groupBy("dim", "leaf", "level").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    spans = {(r["dim"], r["leaf"], r["level"]): (r["low"], r["high"]) for r in ends.collect()}  # as many leaves as routes have
    parts = materialize(routed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).alias("parts")))

    def found(asking: DataFrame) -> DataFrame:
        blocks = asking.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / query_rows).alias("blocks")).join(parts, ["dim", "leaf"])
        to = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        shards = routed.join(blocks, ["dim", "leaf"]).select("dim", "leaf", to("parts").alias("part"), every("blocks").alias("block"), "id", "v")
        asked = asking.join(blocks, ["dim", "leaf"]).select("dim", "leaf", every("parts").alias("part"), to("blocks").alias("block"), "id", "v", "within")
        key = ["dim", "leaf", "part", "block"]
        shards, asked = shards.toDF(*shards.columns), asked.toDF(*asked.columns)  # columns of their own for each side
        return shards.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k, factor, leaf), "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = lambda df: df.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)
    asking = routed.filter("is_query").select("dim", "id", "v", "leaf")
    first = materialize(best(found(asking.withColumn("within", F.lit(float("inf"))))))
    reach = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("within"))
    asking = asking.join(reach, "id", "left").select("dim", "id", "v", "leaf", F.coalesce("within", F.lit(float("inf"))).alias("within"))
    others = asking.mapInArrow(in_slices(_asks(routes, spans, factor)), "dim int, id long, v binary, leaf int, within double")
    return best(first.drop("rank").unionByName(found(materialize(others)))).select("query_id", "rank", "vec_id", "score")
