"""Pipes that discover contracts, fork and start again."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from chainloom.errors import DeepForkError
from chainloom.operators.forks import Block
from chainloom.operators.registry import first_registrations
from chainloom.plans.ranges import Range
from chainloom.sinks.tables import AppendSink
from chainloom.sources.blocks import add_to_cache, read_blocks, replayed, stream_blocks
from chainloom.sources.schemas import entities
from chainloom.streaming import pipe
from chainloom.streaming.metrics import PipeMetrics
from chainloom.streaming.registry import ORDER, Discovery, GrowingRegistry, later_logs
from tests.test_sinks import heads, write_blocks

FIELDS = {"header": ["number", "hash", "parentHash", "timestamp"], "logs": ["logIndex", "transactionIndex", "address", "topics", "data"]}
SCHEMA = "child string, factory string, block_number long, transaction_index int, log_index int"


def block(number, name, parent, *logs):
    """logs: (address, topic, data); a log of topic 'new' creates the child named in its data."""
    return {"header": {"number": number, "hash": name, "parentHash": parent, "timestamp": number}, "logs": [{"logIndex": k, "transactionIndex": 0, "address": a, "topics": [t], "data": d} for k, (a, t, d) in enumerate(logs)]}


def placed(logs):
    return logs.withColumnsRenamed({"transactionIndex": "transaction_index", "logIndex": "log_index"})


def created(tables):
    return placed(tables["logs"]).filter("topic0 = 'new'").select(F.nullif("data", F.lit("")).alias("child"), F.col("address").alias("factory"), *ORDER)


def children(tables, known=None):
    logs = placed(tables["logs"]).filter("topic0 = 'use'")
    return later_logs(logs, tables["pools"] if known is None else known, "address", ["factory"]).select("block_number", "log_index", "address", "factory")


BLOCKS = [
    block(1, "1", "0", ("p1", "use", "x"), ("f", "new", "p1"), ("p1", "use", "x")),
    block(2, "2", "1", ("f", "new", "p2"), ("p1", "use", "x"), ("p2", "use", "x"), ("p3", "use", "x")),
    block(3, "3", "2", ("g", "new", "p1"), ("f", "new", "p3"), ("p3", "use", "x"), ("f", "new", "")),
    block(4, "4", "3", ("p1", "use", "x"), ("p2", "use", "x"), ("p3", "use", "x"), ("p9", "use", "x")),
]
WANT = [(1, 2, "p1", "f"), (2, 1, "p1", "f"), (2, 2, "p2", "f"), (3, 2, "p3", "f"), (4, 0, "p1", "f"), (4, 1, "p2", "f"), (4, 2, "p3", "f")]


def registry(spark, path):
    return GrowingRegistry(spark, str(path), SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_split_of_batches_gives_the_same(spark, tmp_path):
    write_blocks(tmp_path / "all/1.json", *BLOCKS)
    tables = entities(read_blocks(spark, str(tmp_path / "all"), "evm", FIELDS))
    assert rows(children(tables, first_registrations(created(tables), "child", ORDER))) == WANT
    for n, cuts in enumerate(itertools.product([False, True], repeat=3)):
        parts, place = [[BLOCKS[0]]], tmp_path / f"s{n}"
        for b, cut in zip(BLOCKS[1:], cuts, strict=True):
            if cut:
                parts.append([])
            parts[-1].append(b)
        for k, part in enumerate(parts):
            write_blocks(place / f"in/{k}.json", *part)
        sink = AppendSink(spark, str(place / "sink"), "p")
        pools = Discovery(registry(spark, place / "pools"), created)
        stream = lambda _, place=place: stream_blocks(spark, str(place / "in"), "evm", FIELDS, 1)
        assert pipe.run(stream, {"uses": children}, sink, str(place / "c"), list, discoveries={"pools": pools}) == 0
        assert rows(sink.read("uses")) == WANT


def test_fork_drops_what_it_undid_and_a_restart_goes_on(spark, tmp_path):
    for k, b in enumerate(BLOCKS[:3]):
        write_blocks(tmp_path / f"e0/{k}.json", b)
    write_blocks(tmp_path / "e0/9.json", block(4, "4a", "3a"))  # says that block 3 was another
    again = [block(3, "3a", "2", ("f", "new", "p5"), ("p3", "use", "x"), ("p5", "use", "x")), block(4, "4a", "3a", ("g", "new", "p3"), ("p2", "use", "x"), ("p3", "use", "x"))]
    for k, b in enumerate(again):
        write_blocks(tmp_path / f"e1/{k}.json", b)
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    pools = {"pools": Discovery(registry(spark, tmp_path / "pools"), created)}
    stream = lambda e: stream_blocks(spark, str(tmp_path / f"e{e}"), "evm", FIELDS, 1)
    head = lambda: Block(1, "1")
    assert pipe.run(stream, {"uses": children}, sink, str(tmp_path / "c"), lambda: heads("2", "3a", "4a"), finalized=head, discoveries=pools) == 1
    want = [*WANT[:3], (3, 2, "p5", "f"), (4, 1, "p2", "f"), (4, 2, "p3", "g")]
    assert rows(sink.read("uses")) == want
    _, state = sink.log.load()
    assert state.floor == Block(1, "1") and state.safe_blocks == (2,) and state.cursor == Block(4, "4a")

    # a new process: the epoch under way goes on, nothing is read twice, what comes later is
    write_blocks(tmp_path / "e1/7.json", block(5, "5a", "4a", ("p5", "use", "x"), ("p1", "use", "x")))
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    sink.recover()
    pools = {"pools": Discovery(registry(spark, tmp_path / "pools"), created)}
    lower = lambda: None
    assert pipe.run(stream, {"uses": children}, sink, str(tmp_path / "c"), list, finalized=lower, discoveries=pools) == 0
    want += [(5, 0, "p5", "f"), (5, 1, "p1", "f")]
    assert rows(sink.read("uses")) == want
    assert sink.log.load()[1].floor == Block(1, "1")

    reg = pools["pools"].registry
    before = rows(reg.read((2,)))
    assert {r[0]: r[1] for r in before} == {"p1": "f", "p2": "f", "p5": "f", "p3": "g"}
    reg.compact(1, 2, 3, (2,))
    reg.compact(1, 2, 3, (2,))
    assert rows(reg.read((2,))) == before
    assert {r[0] for r in rows(reg.read((2, 3)))} == {"p1", "p2", "p5"}  # a later fork still undoes block 4
    assert len(list((tmp_path / "pools").glob("epoch=*/batch=*/part=*"))) == 1


def test_restart_between_rollback_and_the_new_query(spark, tmp_path):
    write_blocks(tmp_path / "e0/0.json", BLOCKS[0], BLOCKS[1], BLOCKS[2])
    write_blocks(tmp_path / "e1/0.json", block(3, "3a", "2", ("p2", "use", "x")))
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    pools = {"pools": Discovery(registry(spark, tmp_path / "pools"), created)}
    stream = lambda e: stream_blocks(spark, str(tmp_path / f"e{e}"), "evm", FIELDS, 1)
    pipe.run(stream, {"uses": children}, sink, str(tmp_path / "c"), list, finalized=lambda: None, discoveries=pools)
    sink.rollback(heads("2", "3a"))  # and the process ends here
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    assert pipe.run(stream, {"uses": children}, sink, str(tmp_path / "c"), list, finalized=lambda: None, discoveries=pools) == 0
    assert rows(sink.read("uses")) == [*WANT[:3], (3, 0, "p2", "f")]


def test_contradicting_source_fails(spark, tmp_path):
    write_blocks(tmp_path / "e/0.json", BLOCKS[0])
    write_blocks(tmp_path / "e/1.json", block(2, "2", "other"))
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    stream = lambda e: stream_blocks(spark, str(tmp_path / "e"), "evm", FIELDS, 1)
    with pytest.raises(DeepForkError):
        pipe.run(stream, {}, sink, str(tmp_path / "c"), lambda: heads("1", "2"))


def test_metrics_of_a_run(spark, tmp_path):
    for k, b in enumerate(BLOCKS[:3]):
        write_blocks(tmp_path / f"e0/{k}.json", b)
    write_blocks(tmp_path / "e0/9.json", block(4, "4a", "3a"))
    write_blocks(tmp_path / "e1/0.json", block(3, "3a", "2", ("f", "new", "p5")), block(4, "4a", "3a"))
    heard = PipeMetrics()
    spark.streams.addListener(heard)
    try:
        sink = AppendSink(spark, str(tmp_path / "sink"), "p")
        stream = lambda e: stream_blocks(spark, str(tmp_path / f"e{e}"), "evm", FIELDS, 1)
        outputs = {"logs": lambda t: t["logs"].select("block_number", "address")}
        assert pipe.run(stream, outputs, sink, str(tmp_path / "c"), lambda: heads("2", "3a", "4a"), finalized=lambda: None) == 1
        for _ in range(100):
            found = heard.read()
            if found["queries"] == 2 and found["blocks"] >= 5:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert (found["queries"], found["forks"], found["failures"], found["last"]) == (2, 1, 0, 4)
    assert found["blocks"] == 5 and found["batches"] - found["skips"] == 4 and found["bytes"] > 500


def test_replay_then_live(spark, tmp_path):
    """No block is lost or doubled where the cache ends and the stream takes over, nor where the pipe starts again."""
    write_blocks(tmp_path / "all/1.json", *BLOCKS)
    blocks = read_blocks(spark, str(tmp_path / "all"), "evm", FIELDS)
    cache = str(tmp_path / "cache")
    for first, last in ((1, 2), (2, 3), (9, 12)):  # overlap, then a gap
        add_to_cache(blocks.filter(F.col("header.number").between(first, last)), cache, "q", Range(first, last), 99)
    found, cut = replayed(spark, cache, "q", 1)
    assert cut == 4 and sorted(r[0] for r in found.select("header.number").collect()) == [1, 2, 3]
    assert replayed(spark, cache, "other", 7) == (None, 7) and replayed(spark, cache, "q", 4) == (None, 4)
    assert [r[0] for r in replayed(spark, cache, "q", 3)[0].select("header.number").collect()] == [3]

    write_blocks(tmp_path / "live/0.json", BLOCKS[1], BLOCKS[2])  # the source still has some of what is cached
    write_blocks(tmp_path / "live/1.json", BLOCKS[3])
    live = lambda cut, epoch: stream_blocks(spark, str(tmp_path / "live"), "evm", FIELDS, 1)
    sink = AppendSink(spark, str(tmp_path / "sink"), "p")
    pools = {"pools": Discovery(registry(spark, tmp_path / "pools"), created)}
    go = lambda: pipe.run_behind_cache(replayed(spark, cache, "q", 1), live, {"uses": children}, sink, str(tmp_path / "c"), list, finalized=lambda: None, discoveries=pools)
    assert go() == 0
    assert rows(sink.read("uses")) == WANT
    write_blocks(tmp_path / "live/2.json", block(5, "5", "4", ("p2", "use", "x")))
    add_to_cache(blocks.filter("header.number = 4"), cache, "q", Range(4, 4), 99)  # cached behind the stream's back
    assert go() == 0
    assert rows(sink.read("uses")) == [*WANT, (5, 0, "p2", "f")]
