"""Hard-negative mining: product-quantised scores with residual bounds filter, exact integer scores decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.llm.common import Batches, in_slices, materialize, release
from chainloom.llm.vectors import matrix

#: Components in a subspace, and its centroids (a code is one byte).
_WIDTH, _CENTROIDS = 2, 256
#: Anchors that are scored at once against the rows of a block.
_AT_ONCE = 32
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def fit_codebook(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """(subspaces, _CENTROIDS, _WIDTH) centroids by k-means within each subspace; components beyond the last are zero."""
    rng = np.random.default_rng(0)
    x = _parts(sample)
    books = np.zeros((x.shape[1], _CENTROIDS, _WIDTH))
    for s in range(x.shape[1]):
        distinct = np.unique(x[:, s], axis=0)
        centres = distinct[rng.choice(len(distinct), min(_CENTROIDS, len(distinct)), replace=False)]
        for _ in range(rounds if len(distinct) > _CENTROIDS else 0):
            near = _nearest(x[:, s], centres)
            count = np.bincount(near, minlength=len(centres))
            sums = np.stack([np.bincount(near, x[:, s, k], len(centres)) for k in range(_WIDTH)], axis=1)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        books[s, : len(centres)] = centres
        books[s, len(centres) :] = centres[:1]
    return books


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces: (rows, subspaces, _WIDTH)."""
    x = np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % _WIDTH)))
    return x.reshape(len(x), -1, _WIDTH)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _encoded(books: np.ndarray) -> Callable[[Batches], Batches]:
    """(node, label, codes, bounds) of (node, label, x). bounds: the residual norm of each subspace, and the norm of what
    the codes stand for, for rounding; single precision, rounded up."""

    def of(batches: Batches) -> Batches:
        for batch in batches:
            x = _parts(matrix(batch.column(2)))
            codes = np.stack([_nearest(x[:, s], books[s]) for s in range(len(books))], axis=1) if len(x) else np.zeros((0, len(books)), int)
            told = books[np.arange(len(books))[None, :], codes]
            bounds = np.column_stack([np.linalg.norm(x - told, axis=2), np.linalg.norm(told, axis=(1, 2))])
            bounds = np.nextafter(bounds.astype(np.float32), np.float32(np.inf))
            packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes.astype(np.uint8), bounds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *packed], names=["node", "label", "codes", "bounds"])

    return of


def _scores(table: pa.Table, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table, pa.Table]]:
    """(low, high, same label, rows, anchors) for some anchors of a block at a time: each exact score of a row (down) with
    an anchor (across) lies between low and high, the looked-up score minus and plus what the residuals can add."""
    kinds = table.column("anchor").to_numpy()
    rows, anchors = table.filter(pa.array(~kinds)), table.filter(pa.array(kinds))
    if not len(rows) or not len(anchors):
        return
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1)
    bounds = np.frombuffer(b"".join(rows.column("bounds").to_pylist()), np.float32).reshape(len(rows), -1).astype(np.float64)
    bounds = np.column_stack([bounds, np.ones(len(rows))])
    labels = rows.column("label").to_numpy()
    for start in range(0, len(anchors), _AT_ONCE):
        some = anchors.slice(start, _AT_ONCE)
        a = _parts(matrix(some.column("x").combine_chunks()))
        found = np.zeros((len(rows), len(some)))
        for s in range(len(books)):
            found += (books[s] @ a[:, s].T)[codes[:, s]]
        norms = np.column_stack([np.linalg.norm(a, axis=2) * (1 + 1e-6), np.linalg.norm(a, axis=(1, 2)) * 1e-12, np.full(len(a), 1e-6)])
        off = bounds @ norms.T
        yield found - off, found + off, labels[:, None] == some.column("label").to_numpy()[None, :], rows, some


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, -inf where there are fewer."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -np.inf)


def _pairs(parts: list[tuple]) -> pa.Table:
    names = {"anchor_node": np.int64, "place": np.int32, "node": np.int64, "low": np.float64, "high": np.float64, "sure": bool}
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
    return pa.table({n: pa.array(c.astype(kind)) for (n, kind), c in zip(names.items(), columns, strict=True)})


_PAIRS = "anchor_node long, place int, node long, low double, high double, sure boolean"


def _best_of_label(books: np.ndarray, k: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block, the rows of each anchor's label that can be among its k first."""

    def of(table: pa.Table) -> pa.Table:
        parts = []
        for low, high, same, rows, anchors in _scores(table, books):
            nodes, mine = rows.column("node").to_numpy(), anchors.column("node").to_numpy()
            same &= nodes[:, None] != mine[None, :]
            least = _kth(np.where(same, low, -np.inf), k)
            r, q = np.nonzero(same & (high >= least))
            parts.append((mine[q], np.zeros(len(q)), nodes[r], low[r, q], high[r, q], np.ones(len(q))))
        return _pairs(parts)

    return of


def _best_in_windows(books: np.ndarray, k: int, least: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block, the rows of other labels that can be among the k first of each positive's window."""

    def of(table: pa.Table) -> pa.Table:
        parts = []
        for low, high, same, rows, anchors in _scores(table, books):
            nodes, mine = rows.column("node").to_numpy(), anchors.column("node").to_numpy()
            for q, scores in enumerate(anchors.column("scores").to_pylist()):
                bottoms, tops = ([f * s / 100 for s in scores] for f in (least, most))
                some = np.flatnonzero(~same[:, q] & (high[:, q] >= min(bottoms)) & (low[:, q] <= max(tops)))
                lo, hi = low[some, q], high[some, q]
                for place, (bottom, top) in enumerate(zip(bottoms, tops, strict=True)):
                    inside = (hi >= bottom) & (lo <= top)
                    sure = inside & (lo >= bottom) & (hi <= top)
                    worst = _kth(np.where(sure, lo, -np.inf)[:, None], k)[0]
                    at = np.flatnonzero(inside & (hi >= worst))
                    n = len(at)
                    parts.append((np.full(n, mine[q]), np.full(n, place), nodes[some[at]], lo[at], hi[at], sure[at]))
        return _pairs(parts)

    return of


def _met(points: DataFrame, anchors: DataFrame, f: Callable[[pa.Table], pa.Table], rows: int, asked: int, block_rows: int) -> DataFrame:
    """Candidates of every anchor among all points, block against block: each block of rows meets each block of anchors."""
    least = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks, anchor_blocks = max(least, math.ceil(rows / block_rows)), math.ceil(asked / block_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    none = F.lit(None)
    left = points.select(every(anchor_blocks).alias("a"), block(row_blocks).alias("b"), F.lit(False).alias("anchor"), "node", "label", "codes", "bounds", none.cast("array<long>").alias("x"), none.cast("array<long>").alias("scores"))
    right = anchors.select(block(anchor_blocks).alias("a"), every(row_blocks).alias("b"), F.lit(True).alias("anchor"), "node", "label", none.cast("binary").alias("codes"), none.cast("binary").alias("bounds"), "x", "scores")
    return left.unionByName(right).groupBy("a", "b").applyInArrow(f, _PAIRS)


def _reranked(pairs: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(anchor_node, place, node, vec_id, score) of the pairs that the bounds of all blocks together leave, by exact score."""
    per = Window.partitionBy("anchor_node", "place")
    sure = pairs.filter("sure").withColumn("nth", F.row_number().over(per.orderBy(F.desc("low")))).filter(F.col("nth") <= k)
    worst = sure.groupBy("anchor_node", "place").agg(F.min("low").alias("worst"), F.count("*").alias("many")).filter(F.col("many") == k).drop("many")
    left = pairs.join(worst, ["anchor_node", "place"], "left").filter(F.col("worst").isNull() | (F.col("high") >= F.col("worst")))
    named = left.select("anchor_node", "place", "node").join(base.select("node", "vec_id", "x"), "node")
    named = named.join(base.select(F.col("node").alias("anchor_node"), F.col("x").alias("ax")), "anchor_node")
    product = F.aggregate(F.zip_with("x", "ax", lambda a, b: F.try_multiply(a, b)), F.lit(0).cast("long"), lambda total, v: F.try_add(total, v))
    return named.select("anchor_node", "place", "node", "vec_id", product.alias("score")).filter("score is not null")


def _firsts(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_node", "place").orderBy(F.desc("score"), "vec_id", "node")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), sample_rows: int = 4_096, block_rows: int = 65_536) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors(vec_id, label, embedding).

    A component x counts as floor(scale * x), a score is the integer inner product. Positives of an anchor are the first
    of the other rows of its label by score (ties: smaller vec_id); for each, the negatives are the first rows of other
    labels with window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score. Rows with a null id or
    label, a null vector or a null or non-finite component take no part; shorter vectors count as filled up with zeros.
    Positives below zero have empty windows, anchors or positives without rows give none. Rows that repeat a vec_id are
    rows of their own, also as anchors. Scores that do not fit a long are left out. No rows: no rows.

    Every anchor is compared with all rows, in blocks, on product codes: a byte per two components, fitted on the
    sample_rows rows with the smallest hash. The residual norm of each subspace is stored, so a looked-up score is
    off by at most the sum of products of norms (Cauchy-Schwarz), and only rows that certainly can't be among the first are
    left out: first within a block, then by the bounds of all blocks, then by exact scores. Of rows that are equal in
    label and components only the positives + 1 (or negatives) smallest ids can be returned, so the others leave before.
    """
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    fine = F.coalesce(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    spark = vectors.sparkSession
    if not dim:
        return spark.createDataFrame([], OUT)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))
    base = materialize(rows.withColumn("x", padded).withColumn("node", F.monotonically_increasing_id()))

    equal = Window.partitionBy("label", "x").orderBy("vec_id", "node")
    points = base.drop("anchor").withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= max(positives + 1, negatives)).drop("nth")
    sample = base.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select("x").collect()
    books = fit_codebook(np.array([r["x"] for r in sample], np.float64))
    coded = materialize(points.select("node", "label", "x").mapInArrow(in_slices(_encoded(books)), "node long, label long, codes binary, bounds binary"))
    many, asked = coded.count(), base.filter("anchor").count()
    if not asked:
        return spark.createDataFrame([], OUT)

    anchors = base.filter("anchor").select("node", "label", "x", F.lit(None).cast("array<long>").alias("scores"))
    pairs = materialize(_met(coded, anchors, _best_of_label(books, positives), many, asked, block_rows))
    chosen = materialize(_firsts(_reranked(pairs, base, positives), positives))
    release(pairs)

    scores = chosen.groupBy("anchor_node").agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("scores"))
    anchors = base.join(scores, F.col("node") == F.col("anchor_node")).select("node", "label", "x", "scores")
    pairs = materialize(_met(coded, anchors, _best_in_windows(books, negatives, *window), many, asked, block_rows))
    positive = chosen.select("anchor_node", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    scored = _reranked(pairs, base, negatives).join(positive, ["anchor_node", "place"])
    inside = (F.lit(window[0]) * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= F.lit(window[1]) * F.col("positive_score"))
    found = _firsts(scored.filter(inside), negatives).join(base.select(F.col("node").alias("anchor_node"), F.col("vec_id").alias("anchor_id")), "anchor_node")
    out = materialize(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    for done in (pairs, chosen, coded, base):
        release(done)
    return out
