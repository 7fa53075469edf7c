"""Canonical text of nested rows, and rows against declared columns."""

import json
import math
import random
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.errors import CanonicalError, RowError
from chainloom.functions.canonical import canonical_json
from chainloom.functions.validate import Group, Items, Leaf, checked, first_problem
from chainloom.operators.forks import Block
from chainloom.plans.ranges import Range
from chainloom.sinks.tables import CoverageSink


def texts(spark, kind, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], T.StructType([T.StructField("k", T.LongType()), T.StructField("v", kind)]))
    return [r["t"] for r in df.select("k", canonical_json(F.col("v"), kind).alias("t")).orderBy("k").collect()]


def test_plain_values(spark):
    doubles = {0.0: "0", -0.0: "0", 1.0: "1", -2.5: "-2.5", 0.1: "0.1", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 1e-7: "1e-7", 123456.789: "123456.789", 2.0**-44: "5.684341886080802e-14", 5e-324: "5e-324", 2.0**51 + 0.5: "2251799813685248.5", 9007199254740991.0: "9007199254740991"}
    assert texts(spark, T.DoubleType(), doubles) == [doubles[d] for d in doubles]
    assert texts(spark, T.DoubleType(), [-0.0]) == ["0"]
    assert texts(spark, T.LongType(), [2**63 - 1, -5, None]) == [f'"{2**63 - 1}"', '"-5"', None]
    assert texts(spark, T.IntegerType(), [7]) == ["7"] and texts(spark, T.BooleanType(), [True, False]) == ["true", "false"]
    assert texts(spark, T.DecimalType(38, 0), [Decimal(10) ** 37]) == [f'"{10**37}"']
    assert texts(spark, T.DecimalType(10, 3), [Decimal("1.500"), Decimal("100")]) == ['"1.500"', '"100.000"']
    assert texts(spark, T.BinaryType(), [b"\x00\xff", b""]) == ['"0x00ff"', '"0x"']
    assert texts(spark, T.StringType(), ['a"\\/\n\x1f é\U0001f600']) == ['"a\\"\\\\/\\n\\u001f é\U0001f600"']
    assert texts(spark, T.TimestampType(), [datetime(2024, 1, 2, 3, 4, 5, 678_999, tzinfo=UTC)]) == ['"2024-01-02T03:04:05.678Z"']
    assert texts(spark, T.DateType(), [date(1969, 12, 31)]) == ['"1969-12-31"']


def test_doubles_are_read_back(spark):
    rng = random.Random(0)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 15) for _ in range(3000)]
    for v, t in zip(values, texts(spark, T.DoubleType(), values), strict=True):
        assert float(t) == v and (len(t.lstrip("-").replace(".", "").partition("e")[0].strip("0")) <= 17)


def test_order_of_columns_does_not_count(spark):
    a = spark.sql("SELECT struct(1 AS b, array(struct('x' AS q, null AS p)) AS a, map('￿', 1, '\U0001f600', 2, 'k', 3) AS m) AS v")
    b = spark.sql("SELECT struct(map('k', 3, '\U0001f600', 2, '￿', 1) AS m, array(struct(null AS p, 'x' AS q)) AS a, 1 AS b) AS v")
    found = {df.select(canonical_json(F.col("v"), df.schema["v"].dataType).alias("t")).first()["t"] for df in (a.withColumn("v", F.col("v").cast(a.schema["v"].dataType.simpleString().replace("void", "string"))), b.withColumn("v", F.col("v").cast(b.schema["v"].dataType.simpleString().replace("void", "string"))))}
    (text,) = found
    assert text == '{"a":[{"p":null,"q":"x"}],"b":1,"m":{"k":3,"\U0001f600":2,"￿":1}}'
    assert json.loads(text)["m"]["k"] == 3


def test_what_has_no_form_is_refused(spark):
    for v in (math.nan, math.inf, 2.0**53):
        with pytest.raises(Exception, match=r"E2501.*at \$\[1\]"):
            texts(spark, T.ArrayType(T.DoubleType()), [[1.0, v]])
    for kind in ("map<int,string>", "struct<a:array<interval day>>"):
        with pytest.raises(CanonicalError):
            canonical_json(F.lit(None), T.StructType.fromDDL(f"v {kind}")["v"].dataType)


COLUMNS = {"n": Leaf("INT32"), "data": Group({"raw": Leaf("BYTE_ARRAY"), "tags": Items(Items(Leaf("UTF8")), optional=True), "at": Leaf("TIMESTAMP", optional=True)})}
DDL = "n long, data struct<raw:binary,tags:array<array<string>>,at:timestamp_ntz>, other string"


def test_paths_of_problems(spark):
    good, at = b"x", datetime(2024, 1, 1)
    rows = [
        (1, (good, [["a"], []], at), None, None),
        (1, (good, None, None), "x", None),
        (None, None, None, "n is required but null"),
        (2**31, (good, None, at), None, "n is out of INT32 range"),
        (-(2**31), None, None, "data is required but null"),
        (1, (None, [["a"]], at), None, "data.raw is required but null"),
        (1, (good, [["a"], ["b", None, None]], at), None, "data.tags[1][1] is required but null"),
        (1, (good, [["a"], None], at), None, "data.tags[1] is required but null"),
        (1, (good, [], datetime(1969, 12, 31)), None, "data.at is before 1970"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], DDL).withColumn("k", F.monotonically_increasing_id())
    assert [r["p"] for r in df.select("k", first_problem(df, COLUMNS).alias("p")).orderBy("k").collect()] == [r[3] for r in rows]
    assert checked(df.limit(2), COLUMNS).count() == 2
    with pytest.raises(Exception, match=r"E2316.*t: .* required but null"):
        checked(df.filter("n is null"), COLUMNS, "t").collect()


def test_declarations_that_never_fit(spark):
    df = spark.createDataFrame([], DDL)
    for columns in ({"n": Leaf("UTF8")}, {"missing": Leaf("UTF8")}, {"data": Items(Leaf("UTF8"))}, {"data": Group({"no": Leaf("UTF8")})}, {"other": Leaf("BYTE_ARRAY")}):
        with pytest.raises(RowError):
            first_problem(df, columns)


def test_coverage_sink_checks_rows(spark, tmp_path):
    sink = CoverageSink(spark, str(tmp_path), "p", columns={"t": {"v": Leaf("HEX")}})
    rows = lambda v: spark.createDataFrame([(1, v)], "block_number long, v string")
    with pytest.raises(Exception, match="t: v is no hex"):
        sink.write({"t": rows("0xabc")}, Range(0, 9), Block(20))
    assert sink.log.load()[1].cursor is None and sink.coverage("t") == []
    sink.write({"t": rows("0xab")}, Range(0, 9), Block(20))
    assert sink.coverage("t") == [Range(0, 9)]
