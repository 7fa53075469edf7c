"""Embedding near-dedup: spherical k-means cells, blocked cosines within cells, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import Batches, in_slices, materialize, release
from chainloom.llm.components import components
from chainloom.llm.vectors import matrix, packed, unpacked, usable

_SLACK = 1e-9
#: Components of the sample that centres are fitted on, and products held at once when vectors are compared with centres.
_SAMPLE_VALUES, _PRODUCTS = 4_000_000, 4_000_000


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centres of unit rows, by cosine; centres that lose all rows stay where they were."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def fit_cells(vectors: DataFrame, sample_rows: int, cell_rows: int) -> dict[tuple, np.ndarray]:
    """Centres by (group, dimension), fitted on a bounded sample: the vectors with the smallest hash, sample_rows of them
    and _SAMPLE_VALUES components at most. A group has one centre for each cell_rows of its vectors, as far as its share
    of the sample allows (8 rows a centre); beyond that cells grow with the input, and the result stays exact."""
    ends = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    total, sample_rows = ends["n"], min(sample_rows, _SAMPLE_VALUES // max(1, ends["dim"] or 1))
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select("label", F.size("v").alias("dim"), "v").collect()
    groups: dict[tuple, list] = {}
    for r in sample:
        groups.setdefault((r["label"], r["dim"]), []).append(r["v"])
    fitted = {}
    for key, rows in groups.items():
        x = np.array(rows, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = min(math.ceil(len(x) / max(1, len(sample)) * total / cell_rows), len(x) // 8)
        fitted[key] = spherical_kmeans(x, max(1, k))
    return fitted


def _apart(centres: np.ndarray) -> np.ndarray:
    """Distances between unit centres, in single precision and in place: up to 2e-3 off."""
    found = centres @ centres.T
    found *= -2
    found += 2
    return np.sqrt(np.maximum(found, 0, out=found), out=found)


def _assign(fitted: dict[tuple, np.ndarray], least: float):
    """Each vector at home in its nearest cell, and a guest in every later cell that can hold a vector linked with it.

    Two unit vectors linked are at most d = sqrt(2 - 2 least) apart. If y's nearest centre is c and x's is h, then y
    lies on c's side of the plane halfway between them, so x is at most d from that plane: x(h - c) <= d |h - c|.
    """
    reach = math.sqrt(2 - 2 * least) + _SLACK
    names = ["id", "label", "dim", "cell", "home", "n", "v"]

    def of(batches: Batches) -> Batches:
        apart: dict[tuple, np.ndarray] = {}
        for batch in batches:
            ids, labels, dims, counts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3))
            for label, dim in sorted({(int(a), int(b)) for a, b in zip(labels, dims, strict=True)}):
                centres = fitted.get((label, dim))
                if centres is None:
                    centres = np.zeros((1, dim))
                if (label, dim) not in apart:
                    apart = {(label, dim): _apart(centres.astype(np.float32))}
                all_mine = np.flatnonzero((dims == dim) & (labels == label))
                for mine in np.array_split(all_mine, math.ceil(len(all_mine) * len(centres) / _PRODUCTS)):
                    x = matrix(batch.column(4).take(pa.array(mine)))
                    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
                    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                    cosines = unit @ centres.T
                    home = np.argmax(cosines, axis=1)
                    # single precision only widens what counts as near
                    short = cosines[np.arange(len(x)), home][:, None] - cosines <= reach * (apart[label, dim][home] + 2e-3) + _SLACK
                    short &= np.arange(len(centres))[None, :] > home[:, None]
                    row, cell = np.nonzero(short)
                    row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
                    at_home = np.arange(len(row)) < len(x)
                    columns = [pa.array(ids[mine][row]), pa.array(np.full(len(row), label)), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(at_home), pa.array(counts[mine][row])]
                    yield pa.record_batch([*columns, packed(unit[row])], names=names)

    return of


def _block_links(least: float):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        x, ids, n = unpacked(rows["v"]), rows["id"].to_numpy(), rows["n"].to_numpy()
        left, right = np.flatnonzero(rows["left"]), np.flatnonzero(~rows["left"])
        if not len(right) and not rows["alone"].iloc[0]:
            right = right[:0]
        own = bool(rows["alone"].iloc[0])  # a block against itself
        other = left if own else right
        found = np.zeros(len(x), np.int64)
        if not len(left) or not len(other):
            return pd.DataFrame({"id": ids[:0], "root": ids[:0], "n_links": found[:0]})
        linked = x[left] @ x[other].T >= least
        if own:
            np.fill_diagonal(linked, False)
            found[left] = linked @ n[left]
        else:
            found[left], found[right] = linked @ n[right], linked.T @ n[left]
        root = ids.copy()
        a, b = np.nonzero(linked)
        a, b = left[a], other[b]
        while len(a):  # each takes the least root among its links until nothing changes
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            if (before == root).all():
                break
        some = found > 0
        return pd.DataFrame({"id": ids[some], "root": root[some], "n_links": found[some]})

    return of


def near_duplicates(vectors: DataFrame, least: float = 0.98, sample_rows: int = 40_000, cell_rows: int = 1_000, block_rows: int = 1_000) -> DataFrame:
    """One row per row of vectors(vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link when their cosine, in double precision, is least or more; n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable, and kept marks it. Vectors that are null,
    empty, zero or hold null or non-finite components, have a null label or a null id link with nothing (n_links 0,
    themselves as component, kept). Vectors of different dimension don't link. Equal vectors are compared once. Rows
    that repeat a vec_id count as rows of their own: each has the links of its own vector, and the smallest vec_id of
    its component. No vectors: no rows.

    The cells only decide which blocks meet: a vector is also compared in every cell that can hold one of its links, so
    the result is exact for any cells. Cells are compared in blocks of block_rows and a task gets two blocks; counts and
    spanning links leave it, never pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("v"))
    rows = rows.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("digest", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.concat_ws(",", F.col("v").cast("array<string>"))), 256)))
    good = rows.filter("ok")
    distinct = materialize(good.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()))
    fitted = fit_cells(distinct, sample_rows, cell_rows)
    assigned = distinct.select("node", "label", F.size("v").alias("dim"), "n", "v").mapInArrow(in_slices(_assign(fitted, least)), "id long, label long, dim int, cell int, home boolean, n long, v binary")
    assigned = materialize(assigned)
    cell = ["label", "dim", "cell"]
    sizes = assigned.groupBy(*cell, "home").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sizes = sizes.groupBy(*cell).agg(*(F.coalesce(F.max(F.when(F.col("home") == h, F.col("blocks"))), F.lit(0)).alias(c) for h, c in ((True, "homes"), (False, "guests"))))
    placed = assigned.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
    # home block i meets home blocks j >= i and all guest blocks; a meeting is (i, j, whether j is of guests)
    none = F.expr("array(struct(0 as i, 0 as j, false as g, true as l))")
    meetings = F.when(
        F.col("home"),
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j"), F.lit(False).alias("g"), (F.col("block") <= b).alias("l"))),
            F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda b: F.struct(F.col("block").alias("i"), b.alias("j"), F.lit(True).alias("g"), F.lit(True).alias("l")))).otherwise(F.slice(none, 1, 0)),
        ),
    ).when(F.col("homes") > 0, F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda b: F.struct(b.alias("i"), F.col("block").alias("j"), F.lit(True).alias("g"), F.lit(False).alias("l"))))
    dealt = placed.withColumn("m", F.explode(meetings)).select(*cell, "m.i", "m.j", "m.g", F.col("m.l").alias("left"), (~F.col("m.g") & (F.col("m.i") == F.col("m.j"))).alias("alone"), "id", "n", "v")
    linked = materialize(dealt.groupBy(*cell, "i", "j", "g").applyInPandas(_block_links(least), "id long, root long, n_links long"))
    counts = linked.groupBy("id").agg(F.sum("n_links").alias("others"))
    groups = components(linked.select("id", "root"), "id", "root")
    per_class = distinct.select("digest", "node", "vec_id", "n").join(counts, F.col("node") == counts["id"], "left").join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    per_class = per_class.select("digest", "vec_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    per_class = materialize(per_class)
    smallest = per_class.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_class = per_class.join(smallest, "component").select("digest", "n_links", "component_id")
    for done in (assigned, linked):
        release(done)
    out = rows.select("vec_id", "digest").join(per_class, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
