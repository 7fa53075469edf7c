"""Function calls and what they return."""

import json

import pytest

from chainloom.errors import AbiError
from chainloom.functions.abi import Param, encode
from chainloom.functions.calls import ERC20_FUNCTIONS, Function, decode_calls, functions_of

ABI = [
    {"type": "function", "name": "quote", "inputs": [{"name": "path", "type": "address[]"}, {"name": "", "type": "tuple", "components": [{"name": "fee", "type": "uint24"}, {"name": "memo", "type": "string"}]}], "outputs": [{"name": "out", "type": "uint256"}, {"name": "", "type": "int256[2]"}]},
    {"type": "function", "name": "ping", "inputs": [], "outputs": []},
    {"type": "event", "name": "E", "inputs": []},
    {"type": "function", "name": "ping", "inputs": [{"name": "x", "type": "bool"}]},
]


def w(*values):
    return "".join(encode(v, "uint256")[2:] for v in values)


def called(spark, rows, functions, **kw):
    df = spark.createDataFrame(rows, "id int, callInput string, callResultOutput string")
    return {r["id"]: r for r in decode_calls(df, functions, **kw).collect()}


def test_selectors():
    # Selectors of the token functions.
    want = {"name": "06fdde03", "approve": "095ea7b3", "totalSupply": "18160ddd", "transferFrom": "23b872dd", "decimals": "313ce567", "balanceOf": "70a08231", "symbol": "95d89b41", "transfer": "a9059cbb", "allowance": "dd62ed3e"}
    assert {n: f.selector[2:] for n, f in ERC20_FUNCTIONS.items()} == want


def test_arrays_tuples_and_several_outputs(spark):
    found = functions_of(json.dumps({"abi": ABI}))
    assert list(found) == ["quote", "ping"] and found["quote"].signature == "quote(address[],(uint24,string))" and found["ping"].params == ()
    body = w(64, 160) + w(2, 7, 8) + w(500, 64, 3) + b"abc".hex().ljust(64, "0")
    rows = [
        (1, found["quote"].selector + body, "0x" + w(2**255) + w(-5, 6)),
        (2, found["quote"].selector.upper().replace("0X", "0x") + body, "0x"),
        (3, found["ping"].selector, None),
        (4, "0xffffffff", "0x"),
        (5, "0x", None),
        (6, None, None),
    ]
    got = called(spark, rows, list(found.values()))
    assert sorted(got) == [1, 2, 3]
    q = got[1]["quote"]
    assert [a[-1] for a in q["path"]] == ["7", "8"] and q["_1"].asDict() == {"fee": 500, "memo": "abc"}
    assert q["result"]["out"] == str(2**255) and q["result"]["_1"] == ["-5", "6"]
    assert got[2]["quote"]["path"] == q["path"] and got[2]["quote"]["result"] is None and got[1]["ping"] is None
    assert got[3]["function"] == "ping" and got[3]["ping"]["result"] is None


def test_data_that_end_early(spark):
    f = ERC20_FUNCTIONS["transfer"]
    rows = [(1, f.selector + w(1), "0x" + w(1)), (2, f.selector + w(1, 2), "0x" + w(1)[:10]), (3, f.selector + w(1, 2), "0x" + w(1))]
    kept = called(spark, rows, [f], on_error="keep")
    assert [(k, r["decode_error"], r["transfer"] and r["transfer"]["result"]) for k, r in sorted(kept.items())] == [(1, "input ends early", None), (2, "result ends early", None), (3, None, True)]
    assert kept[2]["transfer"]["_value"] == "2"
    assert sorted(called(spark, rows, [f], on_error="drop")) == [2, 3]
    with pytest.raises(Exception, match="ends early: transfer"):
        called(spark, rows, [f])


def test_functions_that_cannot_be_told_apart():
    f = ERC20_FUNCTIONS["transfer"]
    with pytest.raises(AbiError):
        decode_calls(None, [f, Function("transfer", (Param("a", "address"), Param("b", "uint256")))])
    with pytest.raises(AbiError):
        decode_calls(None, [f, f])
