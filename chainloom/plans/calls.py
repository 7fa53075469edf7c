"""Queries over calls and instructions: function calls, instruction data of variable length, swaps of several programs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.borsh import TOKEN_PROGRAM, Instruction, b58hex, decode_instructions, hexb58, little_endian
from chainloom.functions.calls import ERC20_FUNCTIONS, call_filter, decode_calls
from chainloom.functions.layout import Enum, Struct, Vec
from chainloom.operators.trees import ends_below
from chainloom.plans.catalogue import query, table

_ORDER = ("name", "approve", "totalSupply", "transferFrom", "decimals", "balanceOf", "symbol", "transfer", "allowance")


def _word(n: Column) -> Column:
    """A number as 64 hex digits."""
    return F.lpad(F.lower(F.hex(n.cast("long"))), 64, "0")


def _text(value: Column) -> Column:
    """A text of up to 32 bytes as it is returned: where it stands, its length and its bytes filled up."""
    return F.concat(_word(F.lit(32)), _word(F.octet_length(value)), F.rpad(F.lower(F.hex(value)), 64, "0"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 10 AS k, l_returnflag = 'R' AS failed FROM lineitem)
SELECT l_orderkey AS tx, l_linenumber, ['name', 'approve', 'totalSupply', 'transferFrom', 'decimals', 'balanceOf', 'symbol', 'transfer', 'allowance'][k + 1] AS function,
'0x' || lpad(printf('%x', CASE WHEN k IN (1, 3, 5, 7, 8) THEN l_partkey END), 40, '0') AS first_address,
CASE WHEN k IN (1, 3, 7) THEN (l_orderkey * 1000000007)::VARCHAR END AS value,
CASE WHEN failed THEN NULL WHEN k IN (0, 6) THEN 'T' || l_suppkey WHEN k IN (1, 3, 7) THEN CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE 'false' END WHEN k = 4 THEN (l_suppkey % 256)::VARCHAR ELSE (l_partkey::HUGEINT * 18446744073709551616 + l_suppkey)::VARCHAR END AS result
FROM c WHERE k < 9""")
def q_decode_calls(spark, sf_dir):
    """DC-3, DC-5: calls of the nine token functions among others, with what they returned; failed calls returned nothing."""
    rows = table(spark, sf_dir, "lineitem")
    k, part, supplier = (F.col("l_orderkey") + F.col("l_linenumber")) % 10, F.col("l_partkey"), F.col("l_suppkey")
    amount = _word(F.col("l_orderkey") * 1000000007)
    wide = F.concat(F.lit("0" * 32), F.lpad(F.lower(F.hex(part)), 16, "0"), F.lpad(F.lower(F.hex(supplier)), 16, "0"))
    arguments = F.when(k.isin(1, 7), F.concat(_word(part), amount)).when(k == 3, F.concat(_word(part), _word(supplier), amount)).when(k == 5, _word(part)).when(k == 8, F.concat(_word(part), _word(supplier))).otherwise("")
    returned = F.when(k.isin(0, 6), _text(F.concat(F.lit("T"), supplier.cast("string")))).when(k.isin(1, 3, 7), _word(1 - supplier % 2)).when(k == 4, _word(supplier % 256)).otherwise(wide)
    selectors = F.array(*(F.lit(ERC20_FUNCTIONS[n].selector) for n in _ORDER), F.lit("0xffffffff"))
    sighash = F.element_at(selectors, (k + 1).cast("int"))
    traces = rows.select(F.col("l_orderkey").alias("tx"), "l_linenumber", sighash.alias("callSighash"), F.concat(sighash, arguments).alias("callInput"), F.when(F.col("l_returnflag") == "R", "0x").otherwise(F.concat(F.lit("0x"), returned)).alias("callResultOutput"))
    found = decode_calls(traces.filter(call_filter(ERC20_FUNCTIONS.values())), list(ERC20_FUNCTIONS.values()))
    first = F.coalesce("approve._spender", "transferFrom._from", "balanceOf._owner", "transfer._to", "allowance._owner")
    result = F.coalesce(*(F.col(f"{n}.result").cast("string") for n in _ORDER))
    return found.select("tx", "l_linenumber", "function", first.alias("first_address"), F.coalesce("approve._value", "transferFrom._value", "transfer._value").alias("value"), result.alias("result"))


def _little(n: Column, size: int) -> Column:
    """A number as hex, the lowest byte first."""
    digits = F.lpad(F.lower(F.hex(n.cast("long"))), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)))


_STEP = Struct((("pool", "u32"), ("kind", Enum((("direct", ()), ("limited", (("most", "u16"),)), ("split", (("share", "u8"), ("rest", "option<u64>"))))))))
ROUTE = Instruction("route", "e5", ("user", "vault"), (("steps", Vec(_STEP)), ("memo", "string"), ("least", "option<u64>"), ("tail", "array<u8,2>")))
CLOSE = Instruction("close", "e6", ("user",), (("at", "u64"),))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, unnest(range(o_orderkey % 5)) AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey AS tx, k::INTEGER AS step, o_custkey + k AS pool, ['direct', 'limited', 'split'][(o_custkey + k) % 3 + 1] AS kind,
CASE (o_custkey + k) % 3 WHEN 1 THEN k * 7 WHEN 2 THEN CASE WHEN k % 2 = 1 THEN o_orderkey END END::BIGINT AS amount, o_orderpriority AS memo,
CASE WHEN o_custkey % 2 = 0 THEN o_custkey END::BIGINT AS least, o_orderkey % 250 + 1 AS tail FROM r""")
def q_decode_layouts(spark, sf_dir):
    """DC-6: a vector of structs with an enum, then text, an option and an array behind it, from base58."""
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    tx, user = F.col("o_orderkey"), F.col("o_custkey")
    count = (tx % 5).cast("int")

    def step(k: Column) -> Column:
        kind = (user + k) % 3
        rest = F.when(k % 2 == 1, F.concat(F.lit("01"), _little(tx, 8))).otherwise("00")
        body = F.when(kind == 0, "00").when(kind == 1, F.concat(F.lit("01"), _little(k * 7, 2))).otherwise(F.concat(F.lit("02"), _little(k, 1), rest))
        return F.concat(_little(user + k, 4), body)

    steps = F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), step), "")).otherwise("")
    memo = F.col("o_orderpriority")
    tail = F.concat(_little(tx % 250, 1), _little(tx % 250 + 1, 1))
    least = F.when(user % 2 == 0, F.concat(F.lit("01"), _little(user, 8))).otherwise("00")
    data = F.concat(F.lit("e5"), _little(count, 4), steps, _little(F.octet_length(memo), 4), F.lower(F.hex(memo)), least, tail)
    raw = rows.select(tx.alias("tx"), F.lit("router").alias("programId"), F.array(user.cast("string")).alias("accounts"), hexb58(data).alias("data"))
    found = decode_instructions(raw, "router", (ROUTE, CLOSE))
    each = found.select("tx", "route.memo", "route.least", F.element_at("route.tail", 2).alias("tail"), F.posexplode("route.steps").alias("step", "s"))
    amount = F.coalesce("s.kind.limited.most", F.col("s.kind.split.rest").cast("long"))
    return each.select("tx", "step", "s.pool", "s.kind.kind", amount.alias("amount"), "memo", F.col("least").cast("long").alias("least"), "tail")


def _anchor(name: str) -> str:
    """The discriminator that a framework gives an instruction by its name."""
    return hashlib.sha256(f"global:{name}".encode()).hexdigest()[:16]


def _program(*names: str) -> tuple[Instruction, ...]:
    return tuple(Instruction(n, _anchor(n), ("user",)) for n in names)


# Addresses and swap instructions of six exchange programs, and of the token program.
SWAPS: dict[str, tuple[str, tuple[Instruction, ...]]] = {
    "orca_whirlpool": ("whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc", _program("swap", "swap_v2")),
    "meteora_damm": ("Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB", _program("swap")),
    "meteora_dlmm": ("LBUZKhRxPF3XUpBCjp4YzTKgLccjZhTSDM9YuVaPwxo", _program("swap", "swap_exact_out", "swap_with_price_impact")),
    "raydium_amm": ("675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8", (Instruction("swap_base_in", "09", ("user",)), Instruction("swap_base_out", "0b", ("user",)))),
    "raydium_clmm": ("CAMMCzo5YL8w4VFF8KVHrK22GGUsp5VTaW7grrKgrWqK", _program("swap", "swap_v2")),
    "raydium_cpmm": ("CPMMoo8L3F4NbTegBCKVNunggL7H1ZpdTHKxQB5qKP1C", _program("swap_base_input", "swap_base_output")),
}
TOKEN = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"


def swaps(instructions: DataFrame, keys: Sequence[str] = ("block_number", "transactionIndex"), path: str = "instructionAddress") -> DataFrame:
    """Swaps of six exchange programs: their keys, path, exchange, instruction and user, how many token transfers are
    below them, and what went in and out: the first and the last of these.

    One read: rows of the programs are picked by address (text as it is stored, so files can be asked), swaps by their
    discriminators after one base58 pass over what is left."""
    programs = F.create_map(*(F.lit(x) for name, (address, _) in SWAPS.items() for x in (address, name)))
    some = instructions.filter(F.col("programId").isin([TOKEN, *(a for a, _ in SWAPS.values())]))
    some = some.withColumn("data_hex", b58hex("data"))
    tells = [(a, i) for a, known in SWAPS.values() for i in known]
    kind = reduce(lambda acc, x: F.when((F.col("programId") == x[0]) & F.startswith("data_hex", F.lit(x[1].discriminator)), x[1].name).otherwise(acc), tells, F.lit(None).cast("string"))
    moved = next(i for i in TOKEN_PROGRAM if i.name == "transfer")
    checked = next(i for i in TOKEN_PROGRAM if i.name == "transferChecked")
    amount = little_endian(F.col("data_hex"), 1, 8)
    whole = F.length("data_hex") >= 18
    transfers = some.filter((F.col("programId") == TOKEN) & F.substring("data_hex", 1, 2).isin(moved.discriminator, checked.discriminator) & whole)
    target = F.when(F.startswith("data_hex", F.lit(checked.discriminator)), F.get("accounts", F.lit(2))).otherwise(F.get("accounts", F.lit(1)))
    transfers = transfers.select(*keys, path, F.get("accounts", F.lit(0)).alias("source"), target.alias("destination"), amount.alias("amount"))
    outer = some.withColumn("instruction", kind).filter("instruction is not null")
    outer = outer.select(*keys, path, F.element_at(programs, F.col("programId")).alias("exchange"), "instruction", F.get("accounts", F.lit(0)).alias("user"))
    return ends_below(outer, transfers, keys, path, ["source", "destination", "amount"]).withColumnsRenamed({"n_below": "n_transfers", "first": "sent", "last": "received"})


@query("""WITH p AS (SELECT p_partkey AS key, p_partkey // 40 AS tx, bin(p_partkey % 40 + 1) AS path, p_size % 3 AS role, (p_partkey * 7 + p_size) % 11 AS k FROM part),
s AS (SELECT * FROM p WHERE role = 0), t AS (SELECT * FROM p WHERE role = 1),
j AS (SELECT s.key, count(t.key) AS n, min_by(t.key, t.path) AS a, max_by(t.key, t.path) AS b FROM s LEFT JOIN t ON t.tx = s.tx AND length(t.path) > length(s.path) AND starts_with(t.path, s.path) GROUP BY s.key)
SELECT key, ['orca_whirlpool', 'orca_whirlpool', 'meteora_damm', 'meteora_dlmm', 'meteora_dlmm', 'meteora_dlmm', 'raydium_amm', 'raydium_amm', 'raydium_clmm', 'raydium_clmm', 'raydium_cpmm'][k + 1] AS exchange,
['swap', 'swap_v2', 'swap', 'swap', 'swap_exact_out', 'swap_with_price_impact', 'swap_base_in', 'swap_base_out', 'swap', 'swap_v2', 'swap_base_input'][k + 1] AS instruction,
n AS n_transfers, (a * 1000003)::VARCHAR AS sent, (b * 1000003)::VARCHAR AS received, 'd' || b AS destination FROM s JOIN j USING (key)""")
def q_swaps(spark, sf_dir):
    """EX-6: swaps of six programs, nested ones too, with the first and last transfer below each."""
    digits = F.bin(F.col("p_partkey") % 40 + 1)
    path = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.substring(digits, k, F.lit(1)).cast("int"))
    key = F.col("p_partkey")
    known = [(address, i) for address, some in SWAPS.values() for i in some][:11]
    k, role = ((key * 7 + F.col("p_size")) % 11 + 1).cast("int"), F.col("p_size") % 3
    program = F.when(role == 0, F.element_at(F.array(*(F.lit(a) for a, _ in known)), k)).otherwise(TOKEN)
    transfer = F.concat(F.when(key % 2 == 0, "03").otherwise("0c"), _little(key * 1000003, 8), F.when(key % 2 == 0, "").otherwise("06"))
    data = F.when(role == 0, F.concat(F.element_at(F.array(*(F.lit(i.discriminator) for _, i in known)), k), F.lit("00ff"))).when(role == 1, transfer).otherwise("09")
    places = F.concat(F.lit("d"), key.cast("string"))
    accounts = F.when(role == 0, F.array(F.lit("u"))).when(key % 2 == 0, F.array(F.lit("s"), places, F.lit("o"))).otherwise(F.array(F.lit("s"), F.lit("mint"), places, F.lit("o")))
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("block_number"), F.lit(0).alias("transactionIndex"), path.alias("instructionAddress"), program.alias("programId"), accounts.alias("accounts"), hexb58(data).alias("data"))
    back = F.conv(F.array_join(F.transform("instructionAddress", lambda d: d.cast("string")), ""), 2, 10).cast("long") - 1
    found = swaps(rows)
    return found.select((F.col("block_number") * 40 + back).alias("key"), "exchange", "instruction", "n_transfers", F.col("sent.amount").cast("string").alias("sent"), F.col("received.amount").cast("string").alias("received"), "received.destination")
