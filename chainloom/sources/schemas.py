"""Row types of the chain families: one flat table per entity, keyed by block_number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _S, _I, _B, _D = "bigint", "string", "int", "boolean", "double"
_U64, _VAR = "decimal(20,0)", "variant"


def _type(fields: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields.items()])


def _named(text: str, kind: str = _S) -> dict[str, str]:
    return {name: kind for name in text.split()}


# The fields of each family's entities.
FAMILIES: dict[str, dict[str, dict[str, str]]] = {
    "evm": {
        "header": _named("number timestamp", _L) | _named("hash parentHash nonce sha3Uncles logsBloom transactionsRoot stateRoot receiptsRoot mixHash miner difficulty totalDifficulty extraData size gasLimit gasUsed baseFeePerGas"),
        "transactions": _named("transactionIndex type status chainId v yParity", _I) | {"nonce": _U64} | _named("hash from to input value gas gasPrice maxFeePerGas maxPriorityFeePerGas r s gasUsed cumulativeGasUsed effectiveGasPrice contractAddress sighash"),
        "logs": _named("logIndex transactionIndex", _I) | _named("transactionHash address data") | {"topics": "array<string>"},
        "traces": {"transactionIndex": _I, "traceAddress": "array<int>", "subtraces": _I} | _named("type error revertReason createFrom createValue createGas createInit createResultGasUsed createResultCode createResultAddress callFrom callTo callValue callGas callInput callSighash callType callResultGasUsed callResultOutput suicideAddress suicideRefundAddress suicideBalance rewardAuthor rewardValue rewardType"),
        "stateDiffs": {"transactionIndex": _I} | _named("address key kind prev next"),
    },
    "solana": {
        "header": _named("number height parentNumber timestamp", _L) | _named("hash parentHash"),
        "transactions": {"transactionIndex": _I, "version": _S, "signatures": "array<string>", "accountKeys": "array<string>", "fee": _U64, "computeUnitsConsumed": _U64, "feePayer": _S, "err": _VAR, "hasDroppedLogMessages": _B},
        "instructions": {"transactionIndex": _I, "instructionAddress": "array<int>", "programId": _S, "accounts": "array<string>", "data": _S, "isCommitted": _B, "hasDroppedLogMessages": _B, "error": _S, "computeUnitsConsumed": _U64},
        "logs": {"transactionIndex": _I, "logIndex": _I, "instructionAddress": "array<int>"} | _named("programId kind message"),
        "balances": {"transactionIndex": _I, "account": _S, "pre": _U64, "post": _U64},
        "tokenBalances": {"transactionIndex": _I, "account": _S} | _named("preMint postMint preOwner postOwner preProgramId postProgramId") | _named("preAmount postAmount", _U64) | _named("preDecimals postDecimals", _I),
        "rewards": {"pubkey": _S, "lamports": "decimal(20,0)", "postBalance": _U64, "rewardType": _S, "commission": _I},
    },
    "bitcoin": {
        "header": _named("number timestamp medianTime version nonce strippedSize size weight", _L) | _named("hash parentHash merkleRoot target bits chainWork") | {"difficulty": _D},
        "transactions": {"transactionIndex": _I} | _named("hex txid hash") | _named("size vsize weight version locktime", _L),
        "inputs": _named("transactionIndex inputIndex vout", _I) | _named("type txid scriptSigHex scriptSigAsm coinbase prevoutScriptPubKeyHex prevoutScriptPubKeyAsm prevoutScriptPubKeyType prevoutScriptPubKeyAddress") | {"sequence": _L, "txInWitness": "array<string>", "prevoutGenerated": _B, "prevoutHeight": _L, "prevoutValue": _D},
        "outputs": _named("transactionIndex outputIndex", _I) | {"value": _D} | _named("scriptPubKeyHex scriptPubKeyAsm scriptPubKeyDesc scriptPubKeyType scriptPubKeyAddress"),
    },
    "tron": {
        "header": _named("number timestamp version", _L) | _named("hash parentHash txTrieRoot witnessAddress witnessSignature"),
        "transactions": {"transactionIndex": _I, "hash": _S, "signature": "array<string>", "type": _S, "parameter": _VAR, "ret": _VAR} | _named("feeLimit fee timestamp expiration energyUsage energyUsageTotal energyFee netUsage netFee", _L) | {"contractResult": _S, "contractAddress": _S, "cancelUnfreezeV2Amount": "map<string,string>"},
        "logs": _named("transactionIndex logIndex", _I) | _named("address data") | {"topics": "array<string>"},
        "internalTransactions": _named("transactionIndex internalTransactionIndex", _I) | _named("hash callerAddress transferToAddress note extra") | {"callValueInfo": _VAR, "rejected": _B},
    },
    "hyperliquidFills": {
        "header": _named("number timestamp", _L) | {"hash": _S},
        "fills": {"fillIndex": _I} | _named("user coin side dir hash cloid feeToken builder") | _named("px sz startPosition closedPnl fee builderFee", _D) | {"crossed": _B, "oid": _L, "tid": _L, "time": _L},
    },
    "substrate": {
        "header": _named("number timestamp", _L) | _named("hash parentHash stateRoot extrinsicsRoot specName implName validator") | _named("specVersion implVersion", _L),
        "extrinsics": {"index": _I, "version": _I, "success": _B, "hash": _S, "fee": _U64, "tip": _U64, "error": _VAR, "signature": _VAR},
        "calls": {"extrinsicIndex": _I, "address": "array<int>", "name": _S, "args": _VAR, "origin": _VAR, "success": _B, "error": _VAR},
        "events": {"index": _I, "extrinsicIndex": _I, "callAddress": "array<int>", "name": _S, "phase": _S, "args": _VAR, "topics": "array<string>"},
    },
}

_PLACES = tuple(f"a{k}" for k in range(16))

# Columns of the filters of each family, by request.
FILTERS: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "evm": {"log": ("logs", ("address", "topic0", "topic1", "topic2", "topic3")), "transaction": ("transactions", ("from", "to", "sighash", "type")), "trace": ("traces", ("type", "createFrom", "callTo", "callFrom", "callSighash", "suicideRefundAddress", "rewardAuthor")), "stateDiff": ("stateDiffs", ("address", "key", "kind"))},
    "solana": {"transaction": ("transactions", ("feePayer",)), "instruction": ("instructions", ("programId", "d1", "d2", "d4", "d8", *_PLACES, "isCommitted")), "log": ("logs", ("programId", "kind")), "balance": ("balances", ("account",)), "tokenBalance": ("tokenBalances", ("account", "preMint", "postMint", "preOwner", "postOwner", "preProgramId", "postProgramId")), "reward": ("rewards", ("pubkey",))},
    "bitcoin": {"transaction": ("transactions", ()), "input": ("inputs", ("type", "prevoutScriptPubKeyAddress", "prevoutScriptPubKeyType", "prevoutGenerated")), "output": ("outputs", ("scriptPubKeyAddress", "scriptPubKeyType"))},
    "tron": {"transaction": ("transactions", ("type",)), "transfer": ("transactions", ("owner", "to")), "transferAsset": ("transactions", ("owner", "to", "asset")), "triggerSmartContract": ("transactions", ("owner", "contract", "sighash")), "log": ("logs", ("address", "topic0", "topic1", "topic2", "topic3")), "internalTransaction": ("internalTransactions", ("callerAddress", "transferToAddress"))},
    "hyperliquidFills": {"fill": ("fills", ("user", "coin", "dir", "cloid", "feeToken", "builder"))},
    "substrate": {"event": ("events", ("name",)), "call": ("calls", ("name",))},
}


def header_type(family: str) -> T.StructType:
    return _type(FAMILIES[family]["header"])


def block_type(family: str, fields: Mapping[str, Sequence[str]] | None = None) -> T.StructType:
    """The type of a block with nested entities, all or the chosen fields of each; number and hash always."""
    out = []
    for entity, kinds in FAMILIES[family].items():
        if fields is not None and entity not in fields and entity != "header":
            continue
        chosen = kinds if fields is None or entity not in fields else {k: kinds[k] for k in kinds if k in fields[entity] or (entity == "header" and k in ("number", "hash"))}
        kind = _type(chosen)
        out.append(T.StructField(entity, kind if entity == "header" else T.ArrayType(kind)))
    return T.StructType(out)


# Columns of hex text, whose case means nothing.
HEX = frozenset("address topic0 topic1 topic2 topic3 from to sighash createFrom callTo callFrom callSighash suicideRefundAddress rewardAuthor key hash transactionHash contractAddress".split())


def entities(blocks: DataFrame, lower_hex: bool = False) -> dict[str, DataFrame]:
    """Flat tables of nested blocks: block per header, and a row per element of each array with block_number and
    block_hash; absent arrays are empty. Topics are also columns topic0 to topic3, for filters. lower_hex: hex text that
    filters compare is stored in lower case, once and for all, so that scans can ask files for it (stored_lower)."""
    out = {"block": blocks.select("header.*")}
    for f in blocks.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            rows = blocks.select(F.col("header.number").alias("block_number"), F.col("header.hash").alias("block_hash"), F.explode(f.name).alias("_x")).select("block_number", "block_hash", "_x.*")
            if "topics" in rows.columns:
                rows = rows.select("*", *(F.get("topics", F.lit(k)).alias(f"topic{k}") for k in range(4)))
            if lower_hex:
                rows = rows.withColumns({c: F.lower(c) for c in rows.columns if c in HEX and isinstance(rows.schema[c].dataType, T.StringType)})
            out[f.name] = rows
    return out
