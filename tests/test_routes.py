import pytest
from pyspark.sql import functions as F

from chainloom.errors import RelationCycleError
from chainloom.functions.abi import Event, Param, same_topics
from chainloom.operators import routes


def test_ids_come_from_the_first_source_that_has_one(spark):
    rows = spark.createDataFrame([("a", "x", 1, 0), ("", "x", 1, 1), (None, None, 1, 2)], "own string, drawn string, block int, place int")
    assert [r["_id"] for r in routes.with_id(rows, ["own", "drawn"], "block", "place").orderBy("place").collect()] == ["a", "x", "1:2"]


def test_only_the_first_of_an_id_counts_where_it_is_written_once(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, None)], "_id string, seq int, v string")
    assert sorted(map(tuple, routes.written_once(rows, ["seq"]).collect())) == [("a", 1, "early"), ("b", 3, None)]
    assert routes.written_once(rows.limit(0), ["seq"]).count() == 0


def test_signals_above_the_finalized_block_fail(spark):
    rows = spark.createDataFrame([(1,), (5,)], "block int")
    assert routes.finalized_only(rows, "block", 5).count() == 2
    for bound, data in ((4, rows), (None, rows), (9, rows.union(spark.sql("SELECT CAST(NULL AS INT)")))):
        with pytest.raises(Exception, match="E2427"):
            routes.finalized_only(data, "block", bound).collect()


def test_a_fork_without_a_common_block_is_a_dead_end_at_zero(spark):
    forks = spark.createDataFrame([("p", 1, 7), ("p", 2, None), ("q", 1, 3)], "pipe string, at int, safe int")
    found = sorted(map(tuple, routes.boundaries(forks, "at", "safe", ["pipe"]).collect()))
    assert found == [("p", 1, 1, 7, False), ("p", 2, 2, 0, True), ("q", 1, 1, 3, False)]


def test_pages_hold_every_row_once(spark):
    rows, seen, last = spark.range(25).select(F.col("id").alias("n")), [], None
    while part := [r["n"] for r in routes.page(rows, "n", last, 10).collect()]:
        seen, last = seen + part, part[-1]
    assert seen == list(range(24, -1, -1))


def test_children_are_cleared_before_parents():
    order = routes.children_first({"swap": ["pool", "token"], "pool": ["token"], "token": [], "self": ["self"]})
    assert order.index("swap") < order.index("pool") < order.index("token") and "self" in order
    with pytest.raises(RelationCycleError, match="E2106"):
        routes.children_first({"a": ["b"], "b": ["a"]})


def test_events_of_one_topic_and_as_many_indexed_parameters_are_told():
    value = Param("v", "uint256")
    twin = {"a": Event("T", (value,)), "b": Event("T", (Param("w", "uint256"),)), "c": Event("T", (Param("v", "uint256", True),))}
    assert same_topics(twin.values()) == [("T", "T")]
