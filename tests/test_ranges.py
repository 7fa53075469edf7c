from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chainloom.errors import RangeError
from chainloom.plans.ranges import Range, clip, merge_requests, next_covered, parse_endpoint, range_of, resolve

ranges = st.builds(lambda a, n: Range(a, None if n is None else a + n), st.integers(0, 40), st.none() | st.integers(0, 20))


def members(r):
    return {b for b in range(100) if r and r.holds(b)}


@given(ranges, ranges)
def test_intersection_and_difference(a, b):
    assert members(a.intersect(b)) == members(a) & members(b)
    pieces = a.minus(b)
    assert set().union(*map(members, pieces)) == members(a) - members(b)
    assert len(pieces) <= 2


@given(st.lists(ranges, max_size=5))
def test_merge_covers_each_block_with_its_requests(rs):
    merged = merge_requests([(r, k) for k, r in enumerate(rs)])
    for block in range(100):
        want = [k for k, r in enumerate(rs) if r.holds(block)]
        got = [x for r, x in merged if r.holds(block)]
        assert got == ([want] if want else [])


@given(st.lists(ranges, max_size=5), ranges)
def test_clip(rs, bound):
    cut = clip([(r, k) for k, r in enumerate(rs)], bound)
    assert {(b, k) for r, k in cut for b in members(r)} == {(b, k) for k, r in enumerate(rs) for b in members(r) & members(bound)}


def test_coverage():
    rs = [Range(0, 4), Range(10, 12)]
    assert [next_covered(rs, b) for b in (3, 5, 12, 13)] == [3, 10, 12, None]
    assert range_of(rs, 11) == Range(10, 12) and range_of(rs, 7) is None


def test_parse():
    assert parse_endpoint("1,000_000") == 1_000_000
    assert parse_endpoint("+50", 10) == 60
    assert parse_endpoint("latest") == "latest"
    assert parse_endpoint("2024-01-01") == datetime(2024, 1, 1, tzinfo=UTC)
    for bad in ("+5", "x", -1):
        with pytest.raises(RangeError):
            parse_endpoint(bad)


def test_resolve(spark):
    blocks = spark.createDataFrame([(n, 1_700_000_000 + 10 * n) for n in range(100)], "number long, timestamp long")
    assert resolve(5, "+10", blocks) == Range(5, 15)
    assert resolve("2023-11-14T22:13:45Z", "latest", blocks) == Range(3, 99)
    assert resolve(0, None, blocks) == Range(0)
    assert resolve("latest", None, blocks) == Range(99)
    assert resolve("latest", None, blocks, cursor=40) == Range(41)
    assert resolve("latest", None, blocks, cursor=200) == Range(99)
    assert resolve(7, None, blocks, cursor=40) == Range(7)
    with pytest.raises(RangeError):
        resolve(9, 3, blocks)
    with pytest.raises(RangeError):
        resolve("latest", datetime(2024, 1, 1), blocks)
