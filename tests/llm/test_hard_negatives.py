"""Hard negatives against brute force over all pairs."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import hard_negatives, queries


def brute(rows, anchor, positives=5, negatives=5, window=(80, 100)):
    good = [(v, l, [math.floor(256 * float(c)) for c in e]) for v, l, e in rows if v is not None and l is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    dim = max((len(e) for _, _, e in good), default=0)
    x = np.array([e + [0] * (dim - len(e)) for _, _, e in good], np.int64).reshape(len(good), dim)
    out = []
    for k, (v, label, _) in enumerate(good):
        if not anchor(v):
            continue
        score = (x @ x[k]).tolist()
        ranked = sorted((j for j in range(len(good)) if j != k), key=lambda j: (-score[j], good[j][0]))
        for p in [j for j in ranked if good[j][1] == label][:positives]:
            inside = [j for j in ranked if good[j][1] != label and window[0] * score[p] <= 100 * score[j] <= window[1] * score[p]]
            out += [(v, good[p][0], r + 1, good[j][0], score[p], score[j]) for r, j in enumerate(inside[:negatives])]
    return Counter(out)


def relabelled(rows):
    return [(v, (l + 1) % 10 if v is not None and l is not None and v % 7 == 0 else l, e) for v, l, e in rows]


def mined(spark, rows, anchor, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("node", "x", "anchor", "score", "rank")})
    return Counter(tuple(r) for r in hard_negatives.mine(df, anchor, **kw).collect())


def as_float(e):
    return e and [None if c is None else float(np.float32(c)) for c in e]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Counter(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect())
    assert got and got == brute(relabelled(rows), lambda v: v % 100 == 0)


@pytest.mark.parametrize("seed", range(2))
def test_copies_ties_and_small_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 7))
    rows = []
    for v in range(600):
        e = centres[rng.integers(6)] + rng.normal(size=7) * rng.choice([0, 0.05, 0.5])
        rows.append((v, int(rng.integers(3)), as_float(e.tolist())))
    rows += [(v, 1, rows[0][2]) for v in range(600, 760)]  # a large group of equal vectors
    rows += [(v, 2, rows[0][2]) for v in range(760, 800)]
    rows += rows[:40]  # ids that repeat
    got = mined(spark, rows, F.col("vec_id") % 20 == 0, block_rows=70, sample_rows=200)
    assert got == brute(rows, lambda v: v % 20 == 0)


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    e = [0.1, 0.2, -0.3]
    rows = [(100, 1, e), (1, 1, e), (2, 2, [0.1, 0.2]), (3, 2, e), (4, None, e), (5, 2, None), (6, 2, [None, 1.0, 0.0]), (7, 2, [nan, 0.0, 0.0]), (8, 2, [inf, 0.0, 0.0]), (9, 3, []), (10, 3, [0.0, 0.0, 0.0]), (None, 2, e), (200, 9, [-0.1, -0.2, 0.3]), (11, 9, e), (300, 5, [1.0, 0.0, 0.0])]
    rows = [(v, l, as_float(x)) for v, l, x in rows]
    assert mined(spark, rows, F.col("vec_id") % 100 == 0) == brute(rows, lambda v: v % 100 == 0)
    assert mined(spark, [], F.lit(True)) == Counter()
    assert mined(spark, rows[1:4], F.col("vec_id") % 100 == 0) == Counter()
    assert mined(spark, [(1, 1, []), (2, 1, [])], F.lit(True)) == Counter()
    huge = [(100, 1, [3e38] * 3), (1, 1, [3e38] * 3), (2, 2, [1.0] * 3)]
    assert mined(spark, [(v, l, as_float(x)) for v, l, x in huge], F.col("vec_id") == 100) == Counter()


def test_wide_vectors_fit_the_bounds():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(3000, 129)))
    books = hard_negatives.fit_codebook(x[:500])
    import pyarrow as pa

    lists = pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(range(3000)), pa.array([0] * 3000), lists], names=["node", "label", "x"])
    (coded,) = hard_negatives._encoded(books)([batch])
    n = len(coded)
    rows = pa.table({"anchor": [False] * n, "node": coded.column(0), "label": coded.column(1), "codes": coded.column(2), "bounds": coded.column(3), "x": pa.array([None] * n, pa.list_(pa.int64()))})
    anchors = pa.table({"anchor": [True] * 40, "node": pa.array(range(40)), "label": pa.array([0] * 40), "codes": pa.array([None] * 40, pa.binary()), "bounds": pa.array([None] * 40, pa.binary()), "x": lists.slice(0, 40)})
    seen = 0
    for low, high, _, _, some in hard_negatives._scores(pa.concat_tables([rows, anchors]), books):
        exact = x @ x[seen : seen + len(some)].T
        assert (low <= exact).all() and (exact <= high).all()
        own = (x[seen : seen + len(some)] ** 2).sum(axis=1)  # what an anchor scores with itself
        assert np.median(high - low) < 0.5 * own.min()
        seen += len(some)
    assert seen == 40
