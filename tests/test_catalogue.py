import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chainloom.plans import calls, catalogue, examples, families, routing  # noqa: F401
from chainloom.plans.ranges import Range
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    assert_same(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["block_number", "tx", "address", "topic0", "topic1"]
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_scan_reaches_the_files(spark):
    plan = catalogue.queries()["q_log_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(And(GreaterThanOrEqual(l_orderkey" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_included_entities_reach_the_files(spark, tmp_path):
    """Ranges reach the scan of what is included, and lists of text the scan of what matches; no row is joined to be dropped."""
    logs = spark.range(1000).selectExpr("id AS block_number", "cast(id % 7 as int) AS transactionIndex", "concat('0xAB', id % 10) AS address", "'0xT0' AS topic0", "id AS wide")
    txs = spark.range(2000).selectExpr("id AS block_number", "cast(id % 7 as int) AS transactionIndex", "concat('0xs', id % 3) AS `from`")
    for name, df in {"logs": logs.withColumns({c: F.lower(c) for c in ("address", "topic0")}), "transactions": txs}.items():
        df.write.parquet(str(tmp_path / name))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("logs", "transactions")}
    asked = [families.request("evm", "log", Range(100, 300), ["transaction"], address=["0xAB3"]), families.request("evm", "transaction", **{"from": ["0xS1"]})]
    out = families.scan_family("evm", tables, asked, stored_lower=True)
    want = {n for n in range(2000) if n % 3 == 1} | {n for n in range(100, 301) if n % 10 == 3}
    assert sorted(r["block_number"] for r in out["transactions"].collect()) == sorted(want)
    assert {r["block_number"] for r in out["logs"].collect()} == {n for n in range(100, 301) if n % 10 == 3}
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = out["transactions"].filter("true")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    assert any("GreaterThanOrEqual(block_number,100)" in f and "from" in columns for f, columns in pushed)  # what is included
    assert any("from" in f and "0xs1" in f for f, _ in pushed) and any("0xab3" in f and "wide" not in columns for f, columns in pushed)
    assert "LeftOuter" not in plan and "LeftSemi" in plan
