import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from chainloom.errors import CoverageError, FinalizedOnlyError, SinkError
from chainloom.operators.forks import Block
from chainloom.plans.ranges import Range
from chainloom.sinks.changelog import ChangelogSink
from chainloom.sinks.state import State, StateLog
from chainloom.sinks.tables import AppendSink, CoverageSink, MemorySink
from chainloom.sources.blocks import add_to_cache, cached_chain, check_ascending, query_key, read_blocks, run_migrations, split_statements, sql_files, stream_blocks
from chainloom.sources.schemas import FAMILIES, block_type
from chainloom.streaming import pipe


def frame(spark, *numbers):
    return spark.createDataFrame([(n, f"v{n}") for n in numbers], "block_number long, v string")


def heads(*names):
    return [Block(int(n.rstrip("ab")), n) for n in names]


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_fork_and_resume(spark, tmp_path):
    sink = AppendSink(spark, str(tmp_path), "p")
    sink.write({"t": frame(spark, 1, 2, 2)}, heads("1", "2"), Block(1, "1"))
    sink.write({"t": frame(spark, 3, 4)}, heads("3", "4"))
    assert values(sink.read("t")) == ["v1", "v2", "v2", "v3", "v4"]
    assert sink.rollback(heads("2", "3a", "4a")) == Block(2, "2")
    assert values(sink.read("t")) == ["v1", "v2", "v2"]
    sink.write({"t": frame(spark, 3)}, heads("3a"))
    assert values(sink.read("t")) == ["v1", "v2", "v2", "v3"]
    assert sink.recover().cursor == Block(3, "3a")
    assert values(sink.read("t")) == ["v1", "v2", "v2", "v3"]


def test_crashes_before_the_state(spark, tmp_path):
    a = AppendSink(spark, str(tmp_path / "a"), "p")
    a.write({"t": frame(spark, 1)}, heads("1"))
    frame(spark, 2).withColumn("sign", F.lit(1)).write.mode("append").parquet(str(tmp_path / "a/t"))
    a.recover()
    a.recover()
    assert values(a.read("t")) == ["v1"]


def test_coverage_files(spark, tmp_path):
    sink = CoverageSink(spark, str(tmp_path), "p")
    sink.write({"t": frame(spark, 1, 2, 99), "u": frame(spark).limit(0)}, Range(0, 9), Block(20))
    sink.write({"t": frame(spark, 12), "u": frame(spark, 11)}, Range(10, 19), Block(20))
    assert sink.coverage("t") == sink.coverage("u") == [Range(0, 9), Range(10, 19)]
    assert values(sink.read("t")) == ["v1", "v12", "v2"]
    with pytest.raises(FinalizedOnlyError):
        sink.write({"t": frame(spark, 20)}, Range(20, 29), Block(25))
    with pytest.raises(FileExistsError):
        sink.write({"t": frame(spark, 12)}, Range(10, 19), Block(20))
    with pytest.raises(CoverageError):
        sink.file_name(Range(5, 4))
    frame(spark, 25).coalesce(1).write.parquet(str(tmp_path / "_x"))
    part = next(p for p in (tmp_path / "_x").iterdir() if p.suffix == ".parquet")
    part.rename(tmp_path / "t/000000000020-000000000029.parquet")
    sink.recover()
    assert sink.coverage("t")[-1] == Range(10, 19)
    (tmp_path / "t/000000000010-000000000019.parquet").rename(tmp_path / "t/000000000010-000000000025.parquet")
    with pytest.raises(CoverageError):
        sink.recover()


def test_memory(spark):
    got = []
    MemorySink(lambda name, df: got.append((name, values(df)))).write({"t": frame(spark, 1, 5), "u": frame(spark, 9)}, heads("9"), Block(4))
    assert got == [("t", ["v1"])]


def test_state_is_single_writer(spark, tmp_path):
    log = StateLog(spark, str(tmp_path), "p")
    log.save(State(Block(5, "5"), Block(3, "3"), (Block(2, "2"), Block(4, "4"), Block(5, "5"))))
    assert log.save(State(Block(6, "6"), Block(1, "1"), (Block(4, "4"),))).floor == Block(3, "3")
    with pytest.raises(FileExistsError):
        log._folder.put("000000000002", {})


def test_changelog(spark, tmp_path):
    sent = []
    sink = ChangelogSink(spark, str(tmp_path), "p", ["k"], lambda df: sent.extend(json.loads(r["payload"]) for r in df.orderBy("seq").collect()))
    rows = lambda *x: spark.createDataFrame(x, "k string, block_number long, v int")
    sink.write(rows(("a", 1, 1), ("b", 1, 2)), heads("1"), Block(1, "1"))
    sink.fold()
    sink.write(rows(("a", 2, 5), ("c", 2, 6)), heads("2"))
    sink.write(rows(("a", 3, 7), ("b", 3, 8)), heads("3"))
    sink.rollback(heads("2", "3a"))
    last = {}
    for m in sent:
        last[m["_id"]] = m
    assert [int(m["_CHANGE_SEQUENCE_NUMBER"], 16) for m in sent] == list(range(1, len(sent) + 1))
    assert {k: (m["_CHANGE_TYPE"], m.get("v")) for k, m in last.items()} == {"a": ("UPSERT", 5), "b": ("UPSERT", 2), "c": ("UPSERT", 6)}
    before = len(sent)
    sink.recover()
    assert len(sent) == before


def test_changelog_with_stored_inverses(spark, tmp_path):
    sent = []
    undo = lambda df: df.filter("k <> 'd'").select("k", "seq", (F.col("v") * -1).alias("v"))
    sink = ChangelogSink(spark, str(tmp_path), "p", ["k"], lambda df: sent.extend(json.loads(r["payload"]) for r in df.orderBy("seq").collect()), inverse=undo)
    rows = lambda *x: spark.createDataFrame(x, "k string, block_number long, v int")
    sink.write(rows(("a", 1, 1), ("b", 1, 2)), heads("1"), Block(1, "1"))
    sink.fold()
    held = lambda: sorted((r["k"], r["v"]) for r in sink._table("inverses").collect())
    assert held() == []  # final keys need none
    sink.write(rows(("a", 2, 5)), heads("2"))
    sink.write(rows(("a", 3, 7), ("b", 3, 8), ("c", 3, 9), ("d", 3, 4)), heads("3"))
    sink.write(rows(("c", 4, 10)), heads("4"))
    assert held() == [("a", -7), ("a", -5), ("b", -8), ("c", -10), ("c", -9)]
    before = len(sent)
    sink.rollback(heads("2", "3a", "4a"))
    assert {m["_id"]: (m["_CHANGE_TYPE"], m.get("v")) for m in sent[before:]} == {"a": ("UPSERT", 5), "b": ("UPSERT", 2), "c": ("UPSERT", -9), "d": ("DELETE", None)}
    assert held() == [("a", -7), ("a", -5)]
    sink.write(rows(("c", 3, 11)), heads("3a"))
    before = len(sent)
    sink.rollback(heads("2", "3b"))
    assert [(m["_id"], m.get("v")) for m in sent[before:]] == [("c", -11)]


def block(number, name, parent, logs):
    return {"header": {"number": number, "hash": name, "parentHash": parent, "timestamp": number}, "logs": [{"logIndex": k, "address": a, "topics": ["t"], "data": "0x"} for k, a in enumerate(logs)]}


TIMES = itertools.count(1_700_000_000)


def write_blocks(path, *blocks):
    """A file later than all before it, since a stream takes files by their time."""
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text("".join(json.dumps(b) + "\n" for b in blocks))
    at = next(TIMES)
    os.utime(path, (at, at))


FIELDS = {"header": ["number", "hash", "parentHash", "timestamp"], "logs": ["logIndex", "address", "topics", "data"]}


def test_stream_with_fork(spark, tmp_path):
    write_blocks(tmp_path / "e0/1.json", block(1, "1", "0", ["a"]), block(2, "2", "1", ["b", "a"]))
    write_blocks(tmp_path / "e0/2.json", block(3, "3", "2", ["c"]))
    write_blocks(tmp_path / "e1/1.json", block(2, "2", "1", ["b", "a"]), block(3, "3a", "2", ["d"]), block(4, "4a", "3a", []))
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    outputs = {"logs": lambda t: t["logs"].select("block_number", "address", "topic0")}
    stream = lambda epoch: stream_blocks(spark, str(tmp_path / f"e{epoch}"), "evm", FIELDS, 1)
    assert pipe.run(stream, outputs, sink, str(tmp_path / "c0"), list, finality=5) == 0
    assert sorted((r[0], r[1]) for r in sink.read("logs").collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "c")]
    write_blocks(tmp_path / "f0/1.json", block(4, "4a", "3a", []))
    epochs = {0: "f0", 1: "e1"}
    forked = lambda epoch: stream_blocks(spark, str(tmp_path / epochs[epoch]), "evm", FIELDS, 1)
    assert pipe.run(forked, outputs, sink, str(tmp_path / "c1"), lambda: heads("2", "3a", "4a"), finality=5) == 1
    assert sorted((r[0], r[1]) for r in sink.read("logs").collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "d")]


def test_schemas(spark):
    for family in FAMILIES:
        assert "header" in block_type(family).names
    assert block_type("evm", {"logs": ["address"]})["logs"].dataType.elementType.names == ["address"]


def test_sources(spark, tmp_path):
    write_blocks(tmp_path / "b/1.json", block(1, "1", "0", ["a"]), block(2, "2", "x", []))
    blocks = read_blocks(spark, str(tmp_path / "b"), "evm", FIELDS)
    assert [r["number"] for r in check_ascending(blocks.select("header.*")).collect()] == [2]
    key = query_key({"type": "evm", "fromBlock": 1, "fields": {}})
    assert key == query_key({"type": "evm", "fromBlock": 9, "fields": {}})
    assert add_to_cache(blocks, str(tmp_path / "cache"), key, Range(1, 2), 1) == Range(1, 1)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1
    folders = spark.createDataFrame([(0, 4), (5, 9), (11, 12)], "first long, last long")
    assert sorted(tuple(r) for r in cached_chain(spark, folders, 2).collect()) == [(0, 4), (5, 9)]


def test_migrations(spark, tmp_path):
    (tmp_path / "2_fill.sql").write_text("-- a; b\nINSERT INTO m_t VALUES ('x;y', 'it''s; \\'q', \"z;\"); /* ; */ ;\n")
    (tmp_path / "1_make.sql").write_text(f"CREATE TABLE m_t (a STRING, `b;` STRING, c STRING) USING parquet LOCATION '{tmp_path}/t';")
    (tmp_path / "notes.txt").write_text("no; sql")
    assert run_migrations(spark, sql_files(spark, str(tmp_path))) == ["1_make.sql", "2_fill.sql"]
    try:
        assert [tuple(r) for r in spark.table("m_t").collect()] == [("x;y", "it's; 'q", "z;")]
        with pytest.raises(SinkError):
            run_migrations(spark, [("a", "DROP TABLE m_t"), ("a", "SELECT 1")])
        assert spark.catalog.tableExists("m_t")
    finally:
        spark.sql("DROP TABLE m_t")


def test_statements():
    assert split_statements("a;b;;c") == ["a", "b", "c"] and split_statements(" ; -- x;y\n") == []
    assert split_statements("SELECT 5 - 3 / 1 -- ;\n, ';' ; x") == ["SELECT 5 - 3 / 1  \n, ';'", "x"]
