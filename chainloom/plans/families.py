"""Requests of the chain families: their filters, the entities they relate to, and queries over stand-ins of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.errors import RangeError
from chainloom.functions.abi import Event, Param, decode
from chainloom.functions.borsh import b58hex
from chainloom.operators.registry import of_children
from chainloom.plans.catalogue import query, table, whole
from chainloom.plans.ranges import Range
from chainloom.plans.scan import Relation, Request, collected, scan_all
from chainloom.sources.schemas import FILTERS

TX = ("block_number", "transactionIndex")


def _to(entity: str, *keys: str, path: str | None = None, side: str = "children") -> Relation:
    return Relation(entity, keys or TX, path, side)


# What a request of each family may include, by the entity that it matches.
RELATIONS: dict[str, dict[tuple[str, str], Relation]] = {
    "evm": {
        ("logs", "transaction"): _to("transactions"), ("logs", "transactionLogs"): _to("logs"), ("logs", "transactionTraces"): _to("traces"),
        ("transactions", "logs"): _to("logs"), ("transactions", "traces"): _to("traces"), ("transactions", "stateDiffs"): _to("stateDiffs"),
        ("traces", "transaction"): _to("transactions"), ("traces", "transactionLogs"): _to("logs"), ("traces", "subtraces"): _to("traces", path="traceAddress"), ("traces", "parents"): _to("traces", path="traceAddress", side="parents"),
        ("stateDiffs", "transaction"): _to("transactions"),
    },
    "solana": {
        ("transactions", "instructions"): _to("instructions"), ("transactions", "logs"): _to("logs"),
        ("instructions", "transaction"): _to("transactions"), ("instructions", "transactionBalances"): _to("balances"), ("instructions", "transactionTokenBalances"): _to("tokenBalances"), ("instructions", "transactionInstructions"): _to("instructions"),
        ("instructions", "logs"): _to("logs", *TX, "instructionAddress"), ("instructions", "innerInstructions"): _to("instructions", path="instructionAddress"),
        ("logs", "transaction"): _to("transactions"), ("logs", "instruction"): _to("instructions", *TX, "instructionAddress"),
        ("balances", "transaction"): _to("transactions"), ("balances", "transactionInstructions"): _to("instructions"),
        ("tokenBalances", "transaction"): _to("transactions"), ("tokenBalances", "transactionInstructions"): _to("instructions"),
    },
    "bitcoin": {
        ("transactions", "inputs"): _to("inputs"), ("transactions", "outputs"): _to("outputs"),
        **{(e, name): _to(to) for e in ("inputs", "outputs") for name, to in (("transaction", "transactions"), ("transactionInputs", "inputs"), ("transactionOutputs", "outputs"))},
    },
    "tron": {("transactions", "logs"): _to("logs"), ("transactions", "internalTransactions"): _to("internalTransactions"), ("logs", "transaction"): _to("transactions"), ("internalTransactions", "transaction"): _to("transactions")},
    "hyperliquidFills": {},
    "substrate": {
        ("events", "extrinsic"): _to("extrinsics", "block_number", "extrinsicIndex"), ("events", "call"): _to("calls", "block_number", "extrinsicIndex"),
        ("calls", "extrinsic"): _to("extrinsics", "block_number", "extrinsicIndex"), ("calls", "events"): _to("events", "block_number", "extrinsicIndex"), ("calls", "subcalls"): _to("calls", "block_number", "extrinsicIndex", path="address"), ("calls", "stack"): _to("calls", "block_number", "extrinsicIndex", path="address", side="parents"),
    },
}

#: Transaction types that requests with filters on the call's parameters are about.
TRON_TYPES = {"transfer": "TransferContract", "transferAsset": "TransferAssetContract", "triggerSmartContract": "TriggerSmartContract"}


def request(family: str, kind: str, /, within: Range = Range(0), include: Sequence[str] = (), **where) -> tuple[str, Request]:
    """(entity, request) of a family; filters and included entities that it doesn't have are refused."""
    entity, columns = FILTERS[family][kind]
    if wrong := set(where) - set(columns):
        raise RangeError(f"{family} {kind} has no filter {sorted(wrong)}")
    if wrong := [n for n in include if (entity, n) not in RELATIONS[family]]:
        raise RangeError(f"{family} {kind} cannot include {wrong}")
    kept = {"type": [TRON_TYPES[kind]]} if kind in TRON_TYPES else {}
    return entity, Request(within, kept | {k: v for k, v in where.items() if v is not None}, tuple(include))


def scan_family(family: str, tables: Mapping[str, DataFrame], asked: Sequence[tuple[str, Request]], fields: Mapping[str, Sequence[str]] | None = None, stored_lower: bool = False) -> dict[str, DataFrame]:
    """The entities that the requests match or include (see scan_all); stored_lower for tables that schemas.entities made
    of families whose text is hex."""
    by_entity: dict[str, list[Request]] = {}
    for entity, r in asked:
        by_entity.setdefault(entity, []).append(r)
    return scan_all(tables, by_entity, RELATIONS[family], fields, stored_lower=stored_lower)


def instruction_columns(rows: DataFrame, data: str = "data") -> DataFrame:
    """Instructions with what their filters compare: the first 1, 2, 4 and 8 bytes of their data and each account."""
    raw = rows.withColumn("_hex", b58hex(data))
    heads = [F.when(F.length("_hex") >= 2 * n, F.concat(F.lit("0x"), F.substring("_hex", 1, 2 * n))).alias(f"d{n}") for n in (1, 2, 4, 8)]
    return raw.select(*rows.columns, *heads, *(F.get("accounts", F.lit(k)).alias(f"a{k}") for k in range(16)))


def call_columns(rows: DataFrame, parameter: str = "parameter") -> DataFrame:
    """Tron transactions with what their filters compare, out of the call's parameter, JSON text or a variant."""
    value = F.col(parameter)
    text = F.to_json(value) if rows.schema[parameter].dataType.typeName() == "variant" else value
    field = lambda name: F.get_json_object(text, f"$.value.{name}")
    data = F.regexp_replace(F.lower(field("data")), "^0x", "")
    found = {"owner": field("owner_address"), "to": field("to_address"), "asset": field("asset_name"), "contract": field("contract_address"), "sighash": F.when(F.length(data) >= 8, F.substring(data, 1, 8))}
    return rows.select("*", *(c.alias(name) for name, c in found.items()))


def _placed(rows: DataFrame, order: str, *columns) -> DataFrame:
    """Rows of an order's table under the block and transaction of the stand-in chain."""
    return rows.select(whole(order, 10).alias("block_number"), (F.col(order) % 10).cast("int").alias("transactionIndex"), *columns)


_PLACE = "l_orderkey // 10 AS block_number, (l_orderkey % 10)::INT AS tx"


@query("""WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (2, 3) AND l_suppkey % 10 = 4 AND l_orderkey >= 200),
b AS (SELECT l_orderkey AS o, count(*) AS balances, sum(l_partkey)::BIGINT AS total FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey)
SELECT i.o AS tx, i.n::INT AS place, o_custkey AS payer, coalesce(balances, 0)::INT AS balances, coalesce(total, 0)::BIGINT AS total FROM i LEFT JOIN b USING (o) JOIN orders ON o_orderkey = i.o""")
def q_solana_instructions(spark, sf_dir):
    """PF-7, PF-17, J-5, J-6, J-8d: instructions by program, discriminator and account, with their transaction and its token balances."""
    lines = table(spark, sf_dir, "lineitem")
    account = F.concat(F.lit("acc"), (F.col("l_suppkey") % 10).cast("string"))
    data = F.element_at(F.array(*(F.lit(x) for x in ("1", "2", "3", "4", "5", "6", "7", "8", "9"))), F.col("l_linenumber"))  # base58 of the bytes 0 to 8
    tables = {
        "instructions": instruction_columns(_placed(lines, "l_orderkey", F.array(F.col("l_linenumber")).alias("instructionAddress"), F.col("l_returnflag").alias("programId"), F.array(F.lit("x"), account).alias("accounts"), data.alias("data"))),
        "tokenBalances": _placed(lines.filter("l_linestatus = 'F'"), "l_orderkey", F.col("l_partkey").alias("postAmount")),
        "transactions": _placed(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey").alias("feePayer")),
    }
    asked = request("solana", "instruction", Range(20), ["transaction", "transactionTokenBalances"], programId=["R"], d1=["0x01", "0x02"], a1=["acc4"])
    out = scan_family("solana", tables, [asked])
    found = collected(out["instructions"], out["tokenBalances"], TX, "balances").join(out["transactions"], list(TX))
    total = F.aggregate("balances", F.lit(0).cast("long"), lambda s, b: s + b["postAmount"])
    return found.select((F.col("block_number") * 10 + F.col("transactionIndex")).alias("tx"), F.col("instructionAddress")[0].alias("place"), F.col("feePayer").alias("payer"), F.size("balances").alias("balances"), total.alias("total"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS o FROM lineitem WHERE l_partkey IN (3, 8, 21) OR (l_suppkey = 5 AND l_returnflag = 'A'))
SELECT o AS tx, count(*) AS instructions FROM m JOIN lineitem ON l_orderkey = o GROUP BY o""")
def q_solana_balances(spark, sf_dir):
    """PF-8, J-8e: instructions of the transactions whose balances or token balances match."""
    lines = table(spark, sf_dir, "lineitem")
    tables = {
        "balances": _placed(lines, "l_orderkey", F.col("l_partkey").alias("account")),
        "tokenBalances": _placed(lines, "l_orderkey", F.col("l_suppkey").alias("account"), F.col("l_returnflag").alias("postMint")),
        "instructions": _placed(lines, "l_orderkey", F.col("l_linenumber")),
    }
    asked = [request("solana", "balance", include=["transactionInstructions"], account=[3, 8, 21]), request("solana", "tokenBalance", include=["transactionInstructions"], account=[5], postMint=["a"])]
    rows = scan_family("solana", tables, asked)["instructions"]
    return rows.groupBy((F.col("block_number") * 10 + F.col("transactionIndex")).alias("tx")).agg(F.count("*").alias("instructions"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS o FROM lineitem WHERE l_returnflag = 'N' AND l_partkey IN (2, 4, 6))
SELECT o AS tx, count(*) FILTER (l_linestatus = 'O') AS outputs, count(*) FILTER (l_returnflag = 'N') AS inputs FROM m JOIN lineitem ON l_orderkey = o GROUP BY o""")
def q_bitcoin_io(spark, sf_dir):
    """PF-9, J-8f: transactions that spend from the addresses, with all their inputs and outputs."""
    lines = table(spark, sf_dir, "lineitem")
    tables = {
        "inputs": _placed(lines.filter("l_returnflag = 'N'"), "l_orderkey", F.col("l_partkey").alias("prevoutScriptPubKeyAddress")),
        "outputs": _placed(lines.filter("l_linestatus = 'O'"), "l_orderkey", F.col("l_suppkey").alias("scriptPubKeyAddress")),
        "transactions": _placed(table(spark, sf_dir, "orders"), "o_orderkey"),
    }
    asked = request("bitcoin", "input", include=["transaction", "transactionInputs", "transactionOutputs"], prevoutScriptPubKeyAddress=[2, 4, 6])
    out = scan_family("bitcoin", tables, [asked])
    count = lambda e: out[e].groupBy(*TX).agg(F.count("*").alias(e))
    rows = out["transactions"].join(count("inputs"), list(TX), "left").join(count("outputs"), list(TX), "left")
    return rows.select((F.col("block_number") * 10 + F.col("transactionIndex")).alias("tx"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("outputs", "inputs")))


@query("""SELECT o_orderkey AS tx, kind, coalesce(n, 0)::BIGINT AS internals FROM (
SELECT o_orderkey, 'call' AS kind FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 3 AND o_orderkey % 5 = 2 UNION ALL
SELECT o_orderkey, 'transfer' FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 100 = 9)
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_tron_calls(spark, sf_dir):
    """PF-10, J-8g, EX-8: calls and transfers by fields inside their parameter, with internal transactions."""
    kind = F.when(F.col("o_orderstatus") == "F", "TriggerSmartContract").when(F.col("o_orderstatus") == "O", "TransferContract").otherwise("VoteWitnessContract")
    text = lambda c: F.col(c).cast("string")
    value = F.struct((F.col("o_custkey") % 100).cast("string").alias("owner_address"), (F.col("o_custkey") % 7).cast("string").alias("contract_address"), F.concat(F.lit("A9059CB"), (F.col("o_orderkey") % 5).cast("string"), text("o_orderkey")).alias("data"))
    calls = call_columns(_placed(table(spark, sf_dir, "orders"), "o_orderkey", kind.alias("type"), F.to_json(F.struct(value.alias("value"))).alias("parameter")))
    tables = {"transactions": calls, "internalTransactions": _placed(table(spark, sf_dir, "lineitem"), "l_orderkey")}
    asked = [request("tron", "triggerSmartContract", include=["internalTransactions"], contract=["3"], sighash=["a9059cb2"]), request("tron", "transfer", include=["internalTransactions"], owner=["9"])]
    out = scan_family("tron", tables, asked)
    internals = out["internalTransactions"].groupBy(*TX).agg(F.count("*").alias("internals"))
    rows = out["transactions"].join(internals, list(TX), "left")
    name = F.when(F.col("type") == "TriggerSmartContract", "call").otherwise("transfer")
    return rows.select((F.col("block_number") * 10 + F.col("transactionIndex")).alias("tx"), name.alias("kind"), F.coalesce("internals", F.lit(0)).cast("long").alias("internals"))


@query("""SELECT user_id, event_type AS coin, count(*) AS fills, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 100))::BIGINT AS net
FROM events WHERE (user_id IN (3, 4, 5) AND event_type IN ('click', 'view')) OR event_type = 'purchase' GROUP BY ALL""")
def q_fills(spark, sf_dir):
    """PF-11, EX-9: fills of users and coins, with their net size."""
    fills = table(spark, sf_dir, "events").select(whole("event_id", 10).alias("block_number"), F.col("user_id").alias("user"), F.col("event_type").alias("coin"), F.when(F.col("event_id") % 2 == 0, "B").otherwise("A").alias("side"), (F.col("event_id") % 100).alias("sz"))
    asked = [request("hyperliquidFills", "fill", user=[3, 4, 5], coin=["CLICK", "view"]), request("hyperliquidFills", "fill", coin=["purchase"])]
    rows = scan_family("hyperliquidFills", {"fills": fills}, asked)["fills"]
    signed = F.when(F.col("side") == "B", F.col("sz")).otherwise(-F.col("sz"))
    return rows.groupBy(F.col("user").alias("user_id"), "coin").agg(F.count("*").alias("fills"), F.sum(signed).cast("long").alias("net"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS o FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (1, 2))
SELECT o AS extrinsic, o_custkey AS signer, (SELECT count(*) FROM lineitem WHERE l_orderkey = o AND l_linestatus = 'F') AS calls FROM e JOIN orders ON o_orderkey = o""")
def q_substrate_events(spark, sf_dir):
    """PF-12, J-8h: extrinsics and calls of the events asked for by name."""
    place = lambda df, order, *c: _placed(df, order, *c).withColumnRenamed("transactionIndex", "extrinsicIndex")
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat_ws(".", F.when(F.col("l_returnflag") == "R", "Balances").otherwise("System"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string")))
    tables = {"events": place(lines, "l_orderkey", name.alias("name")), "calls": place(lines.filter("l_linestatus = 'F'"), "l_orderkey"), "extrinsics": place(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey").alias("signer"))}
    out = scan_family("substrate", tables, [request("substrate", "event", include=["extrinsic", "call"], name=["Balances.E1", "Balances.E2"])])
    key = ["block_number", "extrinsicIndex"]
    rows = out["extrinsics"].join(out["calls"].groupBy(*key).agg(F.count("*").alias("calls")), key, "left")
    return rows.select((F.col("block_number") * 10 + F.col("extrinsicIndex")).alias("extrinsic"), "signer", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


_TRACES = "(SELECT p_partkey // 40 AS tx, p_partkey AS key, bin(p_partkey % 40 + 1) AS path, p_size % 4 AS kind FROM part)"


@query(f"""WITH m AS (SELECT * FROM {_TRACES} WHERE kind = 2)
SELECT t.key, t.kind FROM {_TRACES} t WHERE t.kind = 2 OR EXISTS (SELECT 1 FROM m WHERE m.tx = t.tx AND length(m.path) > length(t.path) AND starts_with(m.path, t.path))""")
def q_evm_traces(spark, sf_dir):
    """PF-5, J-8b: traces by type, with the traces above them, from one read."""
    digits = F.bin(F.col("p_partkey") % 40 + 1)
    path = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.substring(digits, k, F.lit(1)).cast("int"))
    rows = table(spark, sf_dir, "part").select(whole("p_partkey", 40).alias("block_number"), F.lit(0).alias("transactionIndex"), path.alias("traceAddress"), F.concat(F.lit("K"), (F.col("p_size") % 4).cast("string")).alias("type"), F.col("p_partkey").alias("key"))
    found = scan_family("evm", {"traces": rows}, [request("evm", "trace", include=["parents"], type=["k2"])])["traces"]
    return found.select("key", F.substring("type", 2, 1).cast("int").alias("kind"))


@query("""SELECT l_orderkey AS tx, o_custkey AS sender FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (5, 6) AND l_returnflag IN ('A', 'R')""")
def q_evm_state_diffs(spark, sf_dir):
    """PF-6, J-8c: state changes of contracts by kind, with their transactions."""
    lines = table(spark, sf_dir, "lineitem")
    tables = {"stateDiffs": _placed(lines, "l_orderkey", F.col("l_partkey").alias("address"), F.col("l_returnflag").alias("kind")), "transactions": _placed(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey").alias("sender"))}
    out = scan_family("evm", tables, [request("evm", "stateDiff", include=["transaction"], address=[5, 6], kind=["a", "r"])])
    rows = out["stateDiffs"].join(out["transactions"], list(TX))
    return rows.select((F.col("block_number") * 10 + F.col("transactionIndex")).alias("tx"), "sender")


# The creation and swap events of a pool contract.
SWAP = Event("Swap", (Param("sender", "address", True), Param("recipient", "address", True), Param("amount0", "int256"), Param("amount1", "int256"), Param("sqrtPriceX96", "uint160"), Param("liquidity", "uint128"), Param("tick", "int24")))


def _word(n: Column, negative: Column | None = None) -> Column:
    """A signed long as 64 hex digits, two's complement."""
    fill = F.when(n < 0, F.lit("f" * 48)).otherwise(F.lit("0" * 48)) if negative is None else negative
    return F.concat(fill, F.lpad(F.lower(F.hex(n)), 16, "0"))


@query("""SELECT l_orderkey AS tx, l_linenumber, p_brand AS factory, (-l_orderkey * 1000003)::VARCHAR AS amount0, (l_partkey::HUGEINT * 18446744073709551616 + l_suppkey)::VARCHAR AS amount1, (l_suppkey - 50)::BIGINT AS tick
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size IN (1, 2, 3)""")
def q_decode_swap(spark, sf_dir):
    """EX-2: swaps of pools that the factory created, with signed 256-bit amounts."""
    rows = table(spark, sf_dir, "lineitem")
    amount1 = F.concat(F.lit("0" * 32), F.lpad(F.lower(F.hex("l_partkey")), 16, "0"), F.lpad(F.lower(F.hex("l_suppkey")), 16, "0"))
    data = F.concat(F.lit("0x"), _word(-F.col("l_orderkey") * 1000003), amount1, _word(F.lit(79)), _word(F.lit(5)), _word(F.col("l_suppkey") - 50))
    topics = F.array(F.lit(SWAP.topic), F.concat(F.lit("0x"), _word(F.col("l_suppkey"))), F.concat(F.lit("0x"), _word(F.col("l_partkey"))))
    logs = rows.select(F.col("l_orderkey").alias("tx"), "l_linenumber", F.col("l_partkey").alias("address"), topics.alias("topics"), data.alias("data"))
    pools = table(spark, sf_dir, "part").filter("p_size in (1, 2, 3)").select(F.col("p_partkey").alias("pool"), F.col("p_brand").alias("factory"))
    found = decode(of_children(logs, pools, "address", "pool", ["factory"]), [SWAP])
    return found.select("tx", "l_linenumber", "factory", "Swap.amount0", "Swap.amount1", "Swap.tick")


BATCH = Event("TransferBatch", (Param("operator", "address", True), Param("ids", "uint256[]"), Param("legs", "(address,uint32)[]", parts=(Param("to", "address"), Param("share", "uint32")))))


@query("""SELECT o_orderkey AS tx, list_transform(range(o_orderkey % 4), lambda k: (o_custkey + k)::VARCHAR) AS ids, o_orderkey % 3 AS legs,
list_sum(list_transform(range(o_orderkey % 3), lambda k: k + o_custkey))::BIGINT AS shares FROM orders""")
def q_decode_arrays(spark, sf_dir):
    """DC-1: events with arrays of numbers and of tuples, cut from the data natively."""
    rows = table(spark, sf_dir, "orders")
    n, m, start = F.col("o_orderkey") % 4, F.col("o_orderkey") % 3, F.col("o_custkey")
    many = lambda count, f: F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), f), "")).otherwise("")
    ids = F.concat(_word(n), many(n, lambda k: _word(start + k)))
    legs = F.concat(_word(m), many(m, lambda k: F.concat(_word(k), _word(start + k))))
    data = F.concat(F.lit("0x"), _word(F.lit(64)), _word(F.lit(96) + 32 * n), ids, legs)
    logs = rows.select(F.col("o_orderkey").alias("tx"), F.array(F.lit(BATCH.topic), F.concat(F.lit("0x"), _word(start))).alias("topics"), data.alias("data"))
    found = decode(logs, [BATCH]).select("tx", "TransferBatch.*")
    shares = F.when(F.size("legs") > 0, F.aggregate("legs", F.lit(0).cast("long"), lambda s, x: s + x["share"]))
    return found.select("tx", "ids", F.size("legs").cast("long").alias("legs"), shares.alias("shares"))


__all__ = ["RELATIONS", "call_columns", "instruction_columns", "request", "scan_family"]
