"""What lies below a row of a tree, and swaps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chainloom.functions.borsh import hex_to_b58
from chainloom.operators.trees import ends_below
from chainloom.plans.calls import SWAPS, TOKEN, swaps


@pytest.mark.parametrize("seed", range(2))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), [rng.randrange(3) for _ in range(rng.randrange(1, 6))], k) for k in range(400)]
    rows += [(0, [], 900), (7, [1], 901), (7, [1, 0], 902), (7, [1, 0], 902)]
    df = spark.createDataFrame(rows, "tx int, path array<int>, v int")
    outer, inner = df.filter("v % 3 = 0 or v > 899"), df.filter("v % 3 <> 0 or v > 900")
    got = Counter((r["tx"], tuple(r["path"]), r["v"], r["n_below"], r["first"] and r["first"]["v"], r["last"] and r["last"]["v"]) for r in ends_below(outer, inner, ["tx"], "path", ["v"]).collect())
    want = Counter()
    for tx, path, v in rows:
        if v % 3 == 0 or v > 899:
            below = sorted((q, w) for t, q, w in rows if (w % 3 or w > 900) and t == tx and len(q) > len(path) and q[: len(path)] == path)
            want[tx, tuple(path), v, len(below), below[0][1] if below else None, below[-1][1] if below else None] += 1
    assert got == want


def test_swaps_of_nested_routes(spark):
    address, known = SWAPS["raydium_clmm"]
    amm = SWAPS["raydium_amm"][0]
    move = lambda n, checked=False: hex_to_b58(("0c" if checked else "03") + n.to_bytes(8, "little").hex() + ("06" if checked else ""))
    rows = [
        (1, 0, [0], "router", ["u"], hex_to_b58("aa")),
        (1, 0, [0, 0], address, ["u1"], hex_to_b58(known[1].discriminator + "00")),
        (1, 0, [0, 0, 0], TOKEN, ["a", "b", "o"], move(5)),
        (1, 0, [0, 0, 1], amm, ["u2"], hex_to_b58("09")),
        (1, 0, [0, 0, 1, 0], TOKEN, ["c", "mint", "d", "o"], move(6, True)),
        (1, 0, [0, 0, 1, 1], TOKEN, ["x"], hex_to_b58("03")),  # cut short
        (1, 0, [0, 0, 10], TOKEN, ["e", "f", "o"], move(7)),
        (1, 0, [1], TOKEN, ["g", "h", "o"], move(8)),
        (1, 1, [0], amm, ["u3"], hex_to_b58("0b01")),
        (1, 1, [1], amm, ["u4"], hex_to_b58("0c")),
        (2, 0, [0], address, [], None),
    ]
    df = spark.createDataFrame(rows, "block_number long, transactionIndex int, instructionAddress array<int>, programId string, accounts array<string>, data string").withColumn("extra", F.lit(1))
    side = lambda x: x and (x["source"], x["destination"], int(x["amount"]))
    got = {r["user"]: (r["exchange"], r["instruction"], r["n_transfers"], side(r["sent"]), side(r["received"])) for r in swaps(df).collect()}
    assert got == {
        "u1": ("raydium_clmm", "swap_v2", 3, ("a", "b", 5), ("e", "f", 7)),
        "u2": ("raydium_amm", "swap_base_in", 1, ("c", "d", 6), ("c", "d", 6)),
        "u3": ("raydium_amm", "swap_base_out", 0, None, None),
    }
    plan = swaps(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_discriminators_are_those_of_the_programs():
    # What the programs' instructions begin with.
    assert [i.discriminator for i in SWAPS["meteora_dlmm"][1]] == ["f8c69e91e17587c8", "fa49652126cf4bb8", "38ade6d0ade49ccd"]
    assert [i.discriminator for i in SWAPS["raydium_cpmm"][1]] == ["8fbe5adac41e33de", "37d96256a34ab4ad"]
    assert SWAPS["orca_whirlpool"][1][1].discriminator == "2b04ed0b1ac91e62"
