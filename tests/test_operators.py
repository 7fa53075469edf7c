import pytest
from pyspark.sql import functions as F

from chainloom.errors import AbiError, DiscriminatorError, StaleCanonicalError
from chainloom.functions import scalars, u256
from chainloom.functions.abi import ERC20, Event, Param, decode, encode, event_filter, events_of, keccak256, selector
from chainloom.functions.borsh import TOKEN_PROGRAM, Instruction, b58_to_hex, check_discriminators, decode_instructions, hex_to_b58
from chainloom.operators.forks import Block, resolve_fork, running_floor
from chainloom.operators.registry import first_registrations, of_children, rolled_back
from chainloom.operators.revisions import apply_changes, cancel_rows, compensate, net, sequenced, undo
from chainloom.plans.ranges import Range
from chainloom.plans.scan import Relation, Request, scan_all


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chain(*names):
    return [Block(int("".join(c for c in n if c.isdigit())), n) for n in names]


def old(*names):
    """Blocks of a chain that another one replaced."""
    return [Block(b.number, f"{b.hash}-old") for b in chain(*names)]


@pytest.mark.parametrize(
    ("records", "canonical", "want"),
    [
        ([(chain("5", "6", "7"), Block(4, "4"))], chain("5", "6a", "7a"), Block(5, "5")),
        ([(old("5", "6"), Block(4, "4"))], chain("5", "6"), None),
        ([([], Block(4, "4"))], chain("5", "6"), None),
        ([], chain("5", "6"), None),
        ([(old("6"), Block(5, "5"))], chain("5", "6"), Block(5, "5")),
        ([(old("7"), Block(5, "5"))], chain("5", "6"), None),
        ([(chain("8", "9", "10"), Block(7, "7")), (chain("5", "6", "7"), Block(4, "4"))], chain("8", "9a", "10a"), Block(8, "8")),
        ([(old("8", "9"), Block(7, "7x")), (chain("6", "7"), Block(5, "5"))], chain("6", "7", "8", "9"), Block(7, "7")),
        ([([], Block(9, "9")), ([], Block(7, "7")), (chain("5", "6"), Block(4, "4"))], chain("5", "6a"), Block(5, "5")),
        ([(chain("5", "6", "7"), Block(3, "3"))], chain("7a"), Block(6, "6")),
        ([(old("3"), Block(5, "5"))], chain("3"), None),
        ([(chain("5", "6"), Block(4, "4")), (chain("3", "4"), Block(2, "2"))], chain("5", "6a"), Block(5, "5")),
        ([(chain("5"), Block(4, "4"))], chain("5"), Block(5, "5")),
        ([(chain("5", "6"), Block(4, "4"))], chain("10", "11"), Block(5, "5")),
        ([(chain("5"), None)], chain("5"), Block(5, "5")),
        ([(old("5"), None)], chain("5"), None),
        ([(chain("3", "4", "5"), Block(1, "1"))], chain("4a", "5a"), Block(3, "3")),
        ([(chain("1", "2", "3", "4", "5"), Block(1, "1"))], chain("2", "3", "4a", "5a"), Block(3, "3")),
        ([(chain("2", "3"), Block(1, "1"))], chain("1a", "2a", "3a"), None),
        ([(chain("2"), Block(1, "1"))], chain("1", "2a"), Block(1, "1")),
    ],
)
def test_fork(records, canonical, want):
    assert resolve_fork(records, canonical) == want


def test_fork_reads_no_more_records_than_it_needs():
    def records():
        yield chain("5", "6"), Block(4, "4")
        raise AssertionError

    assert resolve_fork(records(), chain("5", "6a")) == Block(5, "5")


def test_stale_canonical_blocks():
    with pytest.raises(StaleCanonicalError):
        resolve_fork([(chain("1", "2"), None)], chain("1"), cursor=Block(2, "2"))


def test_floor_never_falls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 3), (4, None), (5, 9)], "batch long, finalized long")
    assert [r["floor"] for r in running_floor(df, "batch", "finalized").orderBy("batch").collect()] == [None, 5, 5, 5, 9]


def test_net_and_cancel(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 1), (2, "b", -1), (3, "c", 1)], "block long, v string, sign int")
    assert rows(net(df)) == [(1, "a", 2), (3, "c", 1)]
    undone = df.unionByName(cancel_rows(df, F.col("block") >= 1))
    assert rows(net(undone)) == []


def test_undo(spark):
    table = spark.createDataFrame([("a", 9), ("b", 8)], "k string, v int")
    images = spark.createDataFrame([("a", 5, "UPDATE", 1), ("a", 6, "UPDATE", 2), ("b", 7, "INSERT", None), ("c", 6, "DELETE", 3)], "k string, block long, op string, v int")
    assert rows(undo(table, images, ["k"], "block", "op", 4)) == [("a", 1), ("c", 3)]
    assert rows(undo(table, images, ["k"], "block", "op", 5)) == [("a", 2), ("c", 3)]


def test_changelog(spark):
    df = spark.createDataFrame([("a", 1, "UPSERT", 1), ("a", 2, "DELETE", 1), ("b", 1, "UPSERT", 5)], "k string, seq long, kind string, v int")
    assert rows(apply_changes(df, ["k"], ["seq"], "kind").select("k", "v")) == [("b", 5)]
    manifest = spark.createDataFrame([("a", 5, 1, "x"), ("a", 9, 2, "y"), ("b", 9, 3, "z"), ("c", 9, 4, "w")], "k string, block long, seq long, v string")
    base = spark.createDataFrame([("b", "old")], "k string, v string")
    assert rows(compensate(manifest, base, ["k"], "block", "seq", 7, ["v"])) == [("a", "surviving", "x"), ("b", "baseline", "old"), ("c", "delete", None)]


def test_sequence(spark):
    df = spark.createDataFrame([(b, i) for b in (3, 1, 2) for i in range(3)], "block long, i int")
    got = [(r["block"], r["i"]) for r in sequenced(df, "block", ["i"], 10).orderBy("seq").collect()]
    assert got == [(b, i) for b in (1, 2, 3) for i in range(3)]


def test_registry(spark):
    events = spark.createDataFrame([("p", "f1", 2), ("p", "f2", 1), (None, "f1", 0), ("q", "f1", 5)], "child string, factory string, block long")
    known = first_registrations(events, "child", ["block"])
    assert rows(known.select("child", "factory")) == [("p", "f2"), ("q", "f1")]
    logs = spark.createDataFrame([("p", 3), ("q", 3), ("r", 3)], "address string, n long")
    assert rows(of_children(logs, known, "address", "child", ["factory"])) == [("p", 3, "f2"), ("q", 3, "f1")]
    assert rows(of_children(logs, known, "address", "child", ["factory"], (["n"], ["block"]))) == [("p", 3, "f2")]
    assert rows(rolled_back(known, "block", 2).select("child")) == [("p",)]


def test_relations(spark):
    logs = spark.createDataFrame([(1, 1, "A"), (1, 2, "b"), (2, 3, "a")], "block_number long, tx long, address string")
    txs = spark.createDataFrame([(1, 1, "s"), (1, 2, "t"), (2, 3, "u")], "block_number long, tx long, sender string")
    out = scan_all({"log": logs, "tx": txs}, {"log": [Request(Range(0, 1), {"address": ["a"]}, ("tx",))], "tx": [Request(where={"sender": ["u"]})]}, {("log", "tx"): Relation("tx", ("tx",))})
    assert rows(out["log"]) == [(1, 1, "A")]
    assert rows(out["tx"]) == [(1, 1, "s"), (2, 3, "u")]
    empty = scan_all({"log": logs.limit(0), "tx": txs}, {"log": [Request(include=("tx",))]}, {("log", "tx"): Relation("tx", ("tx",))})
    assert rows(empty["tx"]) == []


def test_related_rows_keep_their_number(spark):
    """Equal rows that occur twice stay two, also where something is included."""
    logs = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "b")], "block_number long, tx long, address string")
    out = scan_all({"log": logs}, {"log": [Request(where={"address": ["a"]}, include=("same",))]}, {("log", "same"): Relation("log", ("tx",))})
    assert rows(out["log"]) == [(1, 1, "a"), (1, 1, "b"), (1, 1, "b")]


def test_family_requests():
    from chainloom.errors import RangeError
    from chainloom.plans.families import request

    entity, asked = request("tron", "transfer", include=["logs"], owner=["41ab"])
    assert entity == "transactions" and asked.where == {"type": ["TransferContract"], "owner": ["41ab"]}
    for wrong in ({"colour": ["red"]}, {"include": ["uncles"]}):
        with pytest.raises(RangeError):
            request("evm", "log", **wrong)


def test_family_columns(spark):
    from chainloom.plans.families import call_columns, instruction_columns

    one = instruction_columns(spark.createDataFrame([(["x", "y"], hex_to_b58("03e8ff00"))], "accounts array<string>, data string")).first()
    assert (one["d1"], one["d4"], one["d8"], one["a1"], one["a2"]) == ("0x03", "0x03e8ff00", None, "y", None)
    call = call_columns(spark.createDataFrame([('{"value": {"owner_address": "41aa", "data": "A9059CBB00"}}',)], "j string").select(F.parse_json("j").alias("parameter"))).first()
    assert (call["owner"], call["to"], call["sighash"]) == ("41aa", None, "a9059cbb")


def test_paths(spark):
    traces = spark.createDataFrame([(1, []), (1, [0]), (1, [0, 1]), (1, [1]), (2, [0])], "tx long, path array<int>")
    below = scan_all({"t": traces}, {"t": [Request(where={"path": []}, include=("down",))]}, {("t", "down"): Relation("t", ("tx",), "path")}, block="tx")
    assert below["t"].count() == 5


def test_keccak_and_signatures():
    assert keccak256(b"").hex().startswith("c5d2460186f7233c")
    assert ERC20["Transfer"].topic.startswith("0xddf252ad1be2c89b")
    assert selector("transfer(address,uint256)") == "0xa9059cbb"
    found = events_of([{"type": "event", "name": "E", "inputs": [{"type": "tuple[]", "components": [{"type": "uint8"}]}, {"type": "bytes", "name": "b"}]}, {"type": "event", "name": "E", "inputs": []}, {"type": "event", "name": "X", "anonymous": True}])
    assert list(found) == ["E"] and found["E"].signature == "E((uint8)[],bytes)" and found["E"].params[0].name == "_0"


def test_decode(spark):
    event = Event("Swap", (Param("who", "address", True), Param("delta", "int256"), Param("note", "string"), Param("small", "int24"), Param("ok", "bool")))
    word = lambda n: (n % 2**256).to_bytes(32, "big").hex()
    text = "héllo".encode()
    data = "0x" + word(-(10**20)) + word(128) + word(-5) + word(1) + word(len(text)) + text.hex().ljust(64, "0")
    who = "0x" + "ab" * 20
    topics = [event.topic, encode(who, "address")]
    logs = spark.createDataFrame([(1, topics, data), (2, [event.topic], data), (3, ["0x00"], "0x")], "n int, topics array<string>, data string")
    r = decode(logs, [*ERC20.values(), event]).collect()
    assert [(x["n"], x["event"]) for x in r] == [(1, "Swap")]
    assert r[0]["Swap"].asDict() == {"who": who, "delta": str(-(10**20)), "note": "héllo", "small": -5, "ok": True}
    assert logs.filter(event_filter(event, {"who": who.upper().replace("0X", "0x")})).count() == 1
    assert logs.filter(event_filter(event, {"who": "0x" + "cd" * 20})).count() == 0


def word(n):
    return (n % 2**256).to_bytes(32, "big").hex()


@pytest.mark.parametrize("n", [0, 5, -5, -(2**126), -(2**126) - 1, -(2**200), 2**200 + 7, -(2**255), 2**255 - 1])
def test_signed_words(spark, n):
    event = Event("E", (Param("x", "int256"),))
    logs = spark.createDataFrame([([event.topic], "0x" + word(n))], "topics array<string>, data string")
    plan = decode(logs, [event])
    assert plan.first()["E"]["x"] == str(n)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_decode_arrays_and_tuples(spark):
    legs = (Param("who", "address"), Param("note", "string"))
    event = Event("Batch", (Param("ids", "uint256[]"), Param("pair", "int8[2]"), Param("legs", "(address,string)[]", parts=legs), Param("fixed", "(uint8,bool)", parts=(Param("a", "uint8"), Param("b", "bool"))), Param("grid", "uint8[][]")))
    text = lambda t: word(len(t)) + t.encode().hex().ljust(64 * (-(-len(t) // 32)), "0")
    leg = lambda n, t: word(n) + word(64) + text(t)
    ids, tuples = word(2) + word(7) + word(2**200), word(2) + word(64) + word(64 + len(leg(1, "a")) // 2) + leg(1, "a") + leg(2, "x" * 40)
    grid = word(2) + word(64) + word(128) + word(1) + word(9) + word(0)
    head, tails, at = [], "", 32 * 7
    for part in (ids, -3, 4, tuples, 200, 1, grid):
        head.append(word(part if isinstance(part, int) else at + len(tails) // 2))
        tails += part if isinstance(part, str) else ""
    logs = spark.createDataFrame([(1, [event.topic], "0x" + "".join(head) + tails), (2, [event.topic], "0x" + "".join(head)[:100])], "n int, topics array<string>, data string")
    got = decode(logs, [event], on_error="keep").orderBy("n").collect()
    assert got[0]["Batch"].asDict(True) == {"ids": ["7", str(2**200)], "pair": [-3, 4], "legs": [{"who": f"0x{1:040x}", "note": "a"}, {"who": f"0x{2:040x}", "note": "x" * 40}], "fixed": {"a": 200, "b": True}, "grid": [[9], []]}
    assert got[1]["Batch"] is None and got[1]["decode_error"]
    assert decode(logs, [event], on_error="drop").count() == 1
    with pytest.raises(Exception, match="end early"):
        decode(logs, [event]).collect()
    with pytest.raises(AbiError):
        decode(logs, [event, Event("Batch", event.params)])


def test_u256(spark):
    values = [0, 1, 2**64 - 1, 2**126 - 1, 2**126, 2**255 + 17, 2**256 - 1]
    df = spark.createDataFrame([(hex(v),) for v in values], "h string").withColumn("w", u256.word("h"))
    assert [r[0] for r in df.select(u256.decimal_text("w")).collect()] == [str(v) for v in values]
    assert u256.sums(df, [], "w", "total").first()["total"] == str(sum(values))
    assert df.select(u256.word(F.lit("0x" + "f" * 65)).alias("x")).first()["x"] is None
    order = [r["h"] for r in df.orderBy(u256.signed_key("w")).collect()]
    assert [int(h, 16) for h in order] == sorted(values, key=lambda v: v - 2**256 if v >= 2**255 else v)


def test_borsh(spark):
    for data in ("", "00", "0000ff", "03e803000000000000"):
        assert b58_to_hex(hex_to_b58(data)) == data
    key = "11" * 32
    table = [("p", ["a", "b", "c"], hex_to_b58("03" + (1000).to_bytes(8, "little").hex())), ("p", ["a"], hex_to_b58("03")), ("p", ["o", "w"], hex_to_b58("060201" + key)), ("x", ["a"], hex_to_b58("03")), ("p", ["a"], "0OIl")]
    df = decode_instructions(spark.createDataFrame(table, "programId string, accounts array<string>, data string"), "p", TOKEN_PROGRAM)
    r = df.select("instruction", "decode_error", "transfer", "setAuthority").collect()
    assert [x["instruction"] for x in r] == ["transfer", "transfer", "setAuthority"]
    assert r[0]["transfer"].asDict() == {"source": "a", "destination": "b", "authority": "c", "amount": 1000}
    assert r[1]["transfer"] is None and r[1]["decode_error"]
    assert r[2]["setAuthority"]["newAuthority"] == hex_to_b58(key)
    with pytest.raises(DiscriminatorError):
        check_discriminators([Instruction("a", "01"), Instruction("b", "01")])


def test_scalars(spark):
    df = spark.createDataFrame([("OP_RETURN 68656c6c6f", "nulldata"), ("OP_RETURN 00ff", "x"), ("OP_DUP", "pubkeyhash")], "asm string, kind string")
    assert [tuple(r) for r in df.select(scalars.return_payload("asm"), scalars.script_kind("kind")).collect()] == [("hello", "OP_RETURN"), ("0x00ff", "unknown"), (None, "P2PKH")]
    one = spark.range(1).select(scalars.varint_size(F.lit(127)), scalars.varint_size(F.lit(128)), scalars.parsed_number(F.lit("1,000_0")), scalars.scaled(F.lit(1500000), 6), scalars.sorted_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))))
    assert tuple(one.first()) == (1, 2, 10000, 1.5, {"a": 2, "b": 1})


def test_throughput(spark):
    from chainloom.operators.progress import throughput

    df = spark.createDataFrame([(k, 1_700_000_000_000 + 1000 * k + 60_000 * (k >= 3), 100 * k, 10) for k in range(5)], "batch long, ms long, block long, bytes long")
    got = throughput(df.withColumn("at", F.timestamp_millis("ms")), 1000, frame=3).orderBy("batch").collect()
    assert [r["blocks_per_second"] for r in got][:4] == [0.0, 100.0, 100.0, 0.0]
    assert got[2]["bytes_per_second"] == 15.0 and got[2]["percent"] == 20.0 and got[2]["seconds_left"] == 8.0
    assert got[3]["seconds_left"] is None
