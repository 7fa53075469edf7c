import pytest

from chainloom.llm import queries
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def test_each_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
