"""Ranges in tables against the same on the driver."""

import random

import pytest

from chainloom.operators.intervals import following, in_ranges, next_covered, split_overlaps
from chainloom.plans import ranges as driver
from chainloom.plans.ranges import Range


@pytest.mark.parametrize("seed", range(3))
def test_against_the_driver(spark, seed):
    rng = random.Random(seed)
    top = [60, 10_000, 2**62][seed]
    rs = []
    for k in range(80):
        start = rng.randrange(top)
        rs.append((start, rng.choice([start, start + rng.randrange(top), start + rng.randrange(9), None if k % 20 == 0 else start + 1]), f"n{k % 7}"))
    odd = [(9, 3, "inverted"), (None, 5, "no start")]
    table = spark.createDataFrame(rs + odd, "start long, stop long, name string")
    some = [r[0] for r in rs] + [r[1] for r in rs if r[1] is not None]
    blocks = [rng.choice(some) + rng.randrange(-2, 3) for _ in range(150)] + [0, None, None]
    points = spark.createDataFrame([(b, k) for k, b in enumerate(blocks)], "n long, id long")
    spans = [(Range(a, b), name) for a, b, name in rs]

    got = sorted(tuple(r) for r in in_ranges(points, table, "n", keep=["start", "name"]).collect())
    assert got == sorted((b, k, r.start, name) for k, b in enumerate(blocks) if b is not None for r, name in spans if r.holds(b))
    closed = table.filter("stop is not null")
    want = [r for r, _ in spans if r.stop is not None]
    got = {r["id"]: r["next"] for r in next_covered(points, closed, "n").collect()}
    assert got == {k: None if b is None else driver.next_covered(want, b) for k, b in enumerate(blocks)}
    got = sorted(tuple(r) for r in split_overlaps(table).collect())
    assert got == sorted((r.start, r.stop, ",".join(sorted(set(names)))) for r, names in driver.merge_requests(spans))


def test_odd_tables(spark):
    points = spark.createDataFrame([(1,), (1,), (None,)], "n long")
    none = spark.createDataFrame([], "start long, stop long, name string")
    assert in_ranges(points, none, "n", keep=["name"]).count() == 0
    assert [r["next"] for r in next_covered(points, none, "n").collect()] == [None] * 3
    assert split_overlaps(none).count() == 0
    marks = spark.createDataFrame([(5,), (5,), (None,)], "m long")
    assert sorted((str(r["n"]), r["next"]) for r in following(points, "n", marks, "m").collect()) == [("1", 5), ("1", 5), ("None", None)]


def test_join_is_on_keys(spark):
    points, ranges = spark.range(100).toDF("n"), spark.range(100).selectExpr("id AS start", "id + 5 AS stop")
    plan = in_ranges(points, ranges, "n")._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
