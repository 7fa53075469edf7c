"""Instruction data of variable length, and base58 by the batch."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from chainloom.errors import AbiError
from chainloom.functions import base58
from chainloom.functions.borsh import Instruction, decode_instructions
from chainloom.functions.layout import Array, Enum, Option, Struct, Vec, read_layout


def plain_b58(data):
    n, out = int.from_bytes(data, "big"), b""
    while n:
        n, k = divmod(n, 58)
        out = base58.ALPHABET[k : k + 1] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out.decode()


def test_base58_batches():
    rng = random.Random(0)
    data = [rng.randbytes(rng.randrange(90)) for _ in range(800)] + [b"\0" * k + rng.randbytes(5) for k in range(9)] + [b"", b"\0", b"\xff" * 64, b"\0" * 40, None]
    want = [None if x is None else plain_b58(x) for x in data]
    assert base58.encode(data) == want
    assert base58.decode([None if x is None else x.encode() for x in want]) == data
    assert base58.decode([b"0", b"ab l", "ü".encode(), b"1"]) == [None, None, None, b"\0"]
    assert base58.encode([]) == [] and base58.decode([]) == []


KIND = Enum((("none", ()), ("buy", (("size", "u16"),)), ("split", (("a", "u8"), ("b", "option<u64>")))))
FIELDS = (("steps", Vec(Struct((("pool", "u32"), ("kind", KIND))))), ("memo", "string"), ("limit", Option("i128")), ("tail", Array("u8", 3)), ("keys", "vec<pubkey>"), ("grid", "vec<vec<i8>>"), ("raw", "bytes"), ("rate", "f64"), ("on", "bool"), ("big", "u128"))


def u32(n):
    return struct.pack("<I", n)


def written(v):
    out = u32(len(v["steps"]))
    for s in v["steps"]:
        k = s["kind"]
        out += u32(s["pool"]) + bytes([["none", "buy", "split"].index(k["kind"])])
        if k["kind"] == "buy":
            out += struct.pack("<H", k["buy"]["size"])
        if k["kind"] == "split":
            b = k["split"]["b"]
            out += bytes([k["split"]["a"]]) + (b"\0" if b is None else b"\1" + struct.pack("<Q", b))
    memo = v["memo"].encode()
    out += u32(len(memo)) + memo
    out += b"\0" if v["limit"] is None else b"\1" + int(v["limit"]).to_bytes(16, "little", signed=True)
    out += bytes(v["tail"]) + u32(len(v["keys"])) + b"".join(base58.decode([k.encode()])[0] for k in v["keys"])
    out += u32(len(v["grid"])) + b"".join(u32(len(g)) + struct.pack(f"{len(g)}b", *g) for g in v["grid"])
    return out + u32(len(v["raw"])) + v["raw"] + struct.pack("<d", v["rate"]) + bytes([v["on"]]) + int(v["big"]).to_bytes(16, "little")


def value(rng):
    def kind():
        k = rng.choice(["none", "buy", "split"])
        return {"kind": k, "buy": {"size": rng.randrange(2**16)} if k == "buy" else None, "split": {"a": rng.randrange(256), "b": rng.choice([None, 2**64 - 1, 5])} if k == "split" else None}

    return {
        "steps": [{"pool": rng.randrange(2**32), "kind": kind()} for _ in range(rng.randrange(5))],
        "memo": rng.choice(["", "é" * 50, "memo"]),
        "limit": rng.choice([None, str(-(2**127)), "7"]),
        "tail": [rng.randrange(256) for _ in range(3)],
        "keys": [plain_b58(rng.randbytes(32)) for _ in range(rng.randrange(3))],
        "grid": [[rng.randrange(-128, 128) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(3))],
        "raw": rng.randbytes(rng.randrange(5)),
        "rate": rng.random(),
        "on": rng.random() < 0.5,
        "big": str(rng.choice([2**128 - 1, 0, 12])),
    }


def as_plain(x):
    if hasattr(x, "asDict"):
        return {k: as_plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [as_plain(v) for v in x]
    return bytes(x) if isinstance(x, bytearray) else int(x) if type(x).__name__ == "Decimal" else x


def test_every_type(spark):
    rng = random.Random(1)
    values = [value(rng) for _ in range(300)]
    data = [(k, written(v)) for k, v in enumerate(values)]
    cut = [(1000 + k, d[: rng.randrange(len(d))]) for k, d in data[:60]]
    rows = data + cut + [(2000, None), (2001, b""), (2002, data[0][1] + b"more"), (2003, u32(2**32 - 1))]
    df = spark.createDataFrame(rows, "id long, data binary").withColumn("x", read_layout(F.col("data"), FIELDS))
    got = {r["id"]: as_plain(r["x"]) for r in df.select("id", "x").collect()}
    for k, v in enumerate(values):
        assert got[k] == {**v, "_error": None}
    empty = dict.fromkeys(dict(FIELDS))
    for k, d in [*cut, (2001, b""), (2003, b"")]:
        assert got[k] == {**empty, "_error": "data end early"}, (k, d)
    assert got[2000] is None and got[2002] == {**values[0], "_error": None}


def test_bad_types():
    for kind in ("u7", Option("option<u8>"), Vec("map")):
        with pytest.raises(AbiError):
            read_layout(F.lit(b""), [("a", kind)])


def test_instructions_of_both_sorts(spark):
    program = (Instruction("swap", "01", ("user",), (("amount", "u64"),)), Instruction("route", "02", ("user", "pool"), (("path", "vec<u8>"), ("least", "option<u64>"), ("name", "string"))))
    b58 = lambda x: plain_b58(bytes.fromhex(x))
    rows = [("p", ["a"], b58("01" + "05" + "00" * 7)), ("p", ["a", "b"], b58("02020000000709" + "01" + "06" + "00" * 7 + "020000006869")), ("p", ["a"], b58("0202000000")), ("p", [], b58("02" + "00" * 4 + "00" + "00" * 4)), ("p", ["z"], b58("03"))]
    found = decode_instructions(spark.createDataFrame(rows, "programId string, accounts array<string>, data string"), "p", program)
    got = [(r["instruction"], r["decode_error"], as_plain(r["swap"]) if r["swap"] else None, as_plain(r["route"]) if r["route"] else None) for r in found.collect()]
    assert got == [
        ("swap", None, {"user": "a", "amount": 5}, None),
        ("route", None, None, {"user": "a", "pool": "b", "path": [7, 9], "least": 6, "name": "hi"}),
        ("route", "data end early", None, None),
        ("route", None, None, {"user": None, "pool": None, "path": [], "least": None, "name": ""}),
    ]
    assert [c for c in found.columns if c.startswith("_")] == []
