"""Further queries of the catalogue: decoders, sinks' tables and example pipelines on the stand-in chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions.abi import ERC20, decode, encode
from chainloom.functions.borsh import TOKEN_PROGRAM, decode_instructions, hexb58
from chainloom.functions.scalars import parsed_number, return_payload, scaled, script_kind, varint_size
from chainloom.operators.forks import Block
from chainloom.operators.progress import merge_batches
from chainloom.operators.registry import first_registrations, of_children, rolled_back
from chainloom.operators.revisions import latest_per_key, sequenced
from chainloom.operators.windows import tumbling, window_messages, with_empty
from chainloom.plans.catalogue import _LOGS, _TXS, logs, query, table, transactions, whole
from chainloom.plans.ranges import Range, clip
from chainloom.plans.scan import Relation, Request, related, scan
from chainloom.sinks.changelog import messages, too_large
from chainloom.sources.blocks import cached_chain, check_ascending, finalized_only


@query(f"SELECT block_number, count(*) AS n FROM {_LOGS} WHERE block_number BETWEEN 601 AND 700 OR (block_number BETWEEN 800 AND 900 AND topic0 = 'A') GROUP BY block_number")
def q_resume_clip(spark, sf_dir):
    """RG-5: requests clipped to what follows the cursor, block 600."""
    asked = clip([(Range(0, 700), {}), (Range(100, 500), {}), (Range(800, 900), {"topic0": ["A"]})], Range(601))
    found = scan(logs(spark, sf_dir), [Request(r, where) for r, where in asked], key=("tx", 10))
    return found.groupBy("block_number").agg(F.count("*").alias("n"))


@query(f"SELECT block_number <= 700 AS final, count(*) AS n FROM {_TXS} GROUP BY 1")
def q_finalized_split(spark, sf_dir):
    """PF-18, SC-14: rows at or below the finalized head, and the rest."""
    rows = transactions(spark, sf_dir)
    final = finalized_only(rows, 700, "block_number").select(F.lit(True).alias("final"))
    return final.unionByName(rows.filter("block_number > 700").select(F.lit(False).alias("final"))).groupBy("final").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS tx, l_linenumber, 'acc' || l_partkey AS source, 'acc' || l_suppkey AS destination, (l_orderkey * 1000003 + l_partkey)::VARCHAR AS amount
FROM lineitem WHERE l_returnflag = 'N'""")
def q_decode_instruction(spark, sf_dir):
    """DC-6, DC-9: token transfers from base58 data, accounts by place."""
    rows = table(spark, sf_dir, "lineitem")
    amount = F.lower(F.lpad(F.hex(F.col("l_orderkey") * 1000003 + F.col("l_partkey")), 16, "0"))
    turned = F.concat(*(F.substring(amount, 15 - 2 * k, 2) for k in range(8)))
    kind = F.when(F.col("l_returnflag") == "N", "03").otherwise("ff")
    account = lambda c: F.concat(F.lit("acc"), F.col(c).cast("string"))
    raw = rows.select(F.col("l_orderkey").alias("tx"), "l_linenumber", F.lit("token").alias("programId"), F.array(account("l_partkey"), account("l_suppkey"), F.lit("x")).alias("accounts"), hexb58(F.concat(kind, turned)).alias("data"))
    found = decode_instructions(raw, "token", TOKEN_PROGRAM)
    return found.select("tx", "l_linenumber", "transfer.source", "transfer.destination", F.col("transfer.amount").cast("string").alias("amount"))


@query(f"""SELECT DISTINCT t.tx, t.sender FROM {_TXS} t WHERE EXISTS (SELECT 1 FROM {_LOGS} l WHERE l.tx = t.tx AND l.address IN (SELECT p_partkey FROM part WHERE p_size = 7))""")
def q_related_by_registry(spark, sf_dir):
    """J-8 over J-1: transactions of logs of registered children."""
    known = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("child"))
    found = of_children(logs(spark, sf_dir), known, "address", "child", [])
    return related(found, transactions(spark, sf_dir), Relation("transaction", ("tx",))).select("tx", "sender").distinct()


@query("SELECT p_brand AS factory, count(*) AS n FROM part WHERE p_partkey // 10 <= 120 GROUP BY p_brand")
def q_registry_rollback(spark, sf_dir):
    """ST-6: the registry after a fork to block 120."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.col("p_brand").alias("factory"), whole("p_partkey", 10).alias("created"))
    return rolled_back(first_registrations(rows, "child", ["created"]), "created", 120).groupBy("factory").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS output, CASE p_size % 5 WHEN 0 THEN 'P2PKH' WHEN 1 THEN 'P2WPKH' WHEN 2 THEN 'OP_RETURN' WHEN 3 THEN 'P2TR' ELSE 'unknown' END AS kind,
CASE WHEN p_size % 5 <> 2 THEN NULL WHEN p_partkey % 2 = 0 THEN 'id' || p_partkey ELSE '0x00' || hex('id' || p_partkey).lower() END AS payload FROM part""")
def q_utxo_kinds(spark, sf_dir):
    """EX-7: kinds of outputs and what OP_RETURN outputs carry."""
    rows = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("pubkeyhash", "witness_v0_keyhash", "nulldata", "witness_v1_taproot", "odd"))), F.col("p_size") % 5 + 1)
    word = F.lower(F.hex(F.concat(F.lit("id"), F.col("p_partkey").cast("string"))))
    word = F.when(F.col("p_partkey") % 2 == 0, word).otherwise(F.concat(F.lit("00"), word))
    asm = F.when(F.col("p_size") % 5 == 2, F.concat(F.lit("OP_RETURN "), word)).otherwise("OP_DUP")
    return rows.select(F.col("p_partkey").alias("output"), script_kind(kind).alias("kind"), return_payload(asm).alias("payload"))


@query("SELECT o_orderkey AS tx, o_custkey / pow(10.0, o_orderkey % 9) AS amount, 1 + (o_custkey >= 128)::INT + (o_custkey >= 16384)::INT AS bytes, o_orderkey AS block FROM orders")
def q_amounts(spark, sf_dir):
    """FN-4, FN-20, FN-21: scaled amounts, varint sizes, numbers with separators."""
    rows = table(spark, sf_dir, "orders")
    text = F.regexp_replace(F.format_number("o_orderkey", 0), ",", "_")
    return rows.select(F.col("o_orderkey").alias("tx"), scaled("o_custkey", F.col("o_orderkey") % 9).alias("amount"), varint_size("o_custkey").alias("bytes"), parsed_number(text).alias("block"))


@query("""SELECT user_id AS pipe, sum(event_id)::BIGINT AS bytes, min(event_id) AS requested_from, max_by(event_id * 2, event_id) AS head,
sum(CASE WHEN event_id % 7 NOT IN (0, 1) THEN 1 ELSE 0 END)::BIGINT AS success, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS rate_limited, sum(CASE WHEN event_id % 7 = 1 THEN 1 ELSE 0 END)::BIGINT AS failed FROM events GROUP BY user_id""")
def q_merge_batches(spark, sf_dir):
    """AG-6: metadata of many batches as one."""
    e = F.col("event_id")
    status = F.when(e % 7 == 0, 429).when(e % 7 == 1, 500).otherwise(204)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("pipe"), e.alias("batch"), e.alias("bytes"), e.alias("requested_from"), (e * 2).alias("head"), status.alias("status"), F.lit(1).cast("long").alias("requests"))
    return merge_batches(rows, "pipe")


@query("""WITH f AS (SELECT p_partkey * 10 AS first, p_partkey * 10 + 9 + p_size % 3 AS last FROM part WHERE p_partkey % 150 <> 149),
g AS (SELECT *, lag(last) OVER (ORDER BY first) AS before FROM f WHERE last >= 35)
SELECT first, last::BIGINT AS last FROM g WHERE first < coalesce((SELECT min(first) FROM g WHERE first > before + 1), 9223372036854775807)""")
def q_cache_chain(spark, sf_dir):
    """SC-16: cached folders that follow one another from block 35, up to the first gap."""
    rows = table(spark, sf_dir, "part").filter("p_partkey % 150 <> 149")
    first = F.col("p_partkey") * 10
    return cached_chain(spark, rows.select(first.alias("first"), (first + 9 + F.col("p_size") % 3).cast("long").alias("last")), 35)


@query("SELECT o_orderkey AS number FROM orders WHERE o_orderkey % 1000 = 500 AND o_orderkey > 0")
def q_parent_breaks(spark, sf_dir):
    """ST-11: blocks that do not follow the block before them."""
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(n.alias("number"), F.md5(n.cast("string")).alias("hash"), F.when(n % 1000 == 500, "other").otherwise(F.md5((n - 1).cast("string"))).alias("parentHash"))
    return check_ascending(rows).select("number")


@query("""SELECT concat_ws(':', user_id, event_type) AS ordering_key, max(event_id) AS seq, 'UPSERT' AS kind, upper(printf('%x', max(event_id))) AS change FROM events GROUP BY user_id, event_type""")
def q_cdc_messages(spark, sf_dir):
    """SK-28, CD-1: a message per key with its sequence in hex, read back from the payload."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), "value")
    found = messages(latest_per_key(rows, ["user_id", "event_type"], ["seq"]).withColumn("change_type", F.lit("UPSERT")), ["user_id", "event_type"])
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return found.select("ordering_key", "seq", field("_CHANGE_TYPE").alias("kind"), field("_CHANGE_SEQUENCE_NUMBER").alias("change"))


@query("SELECT count(*) FILTER (user_id % 40 = 0) AS n FROM events")
def q_message_limits(spark, sf_dir):
    """SK-27: messages over the limits, here by the size of their key."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 40 == 0, F.repeat(F.lit("k"), 1025)).otherwise("k").alias("ordering_key"), F.col("props").alias("payload"))
    return too_large(rows).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id % 97 AS grp, time_bucket(INTERVAL '1 hour', ts) AS s, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT grp, unnest(generate_series(min(s), max(s), INTERVAL '1 hour')) AS s FROM w GROUP BY grp)
SELECT concat_ws(':', grp, epoch(s)::BIGINT) AS id, 'UPSERT' AS change_type, coalesce(n, 0) AS n FROM g LEFT JOIN w USING (grp, s)""")
def q_neutral_windows(spark, sf_dir):
    """ST-14: empty windows as neutral rows instead of deletes."""
    rows = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 97)
    found = with_empty(tumbling(rows, "ts", "1 hour", ["grp"], F.count("*").alias("n")), ["grp"], 3600, ["n"])
    return window_messages(found, ["grp"], ["n"], neutral=True)


@query("""SELECT l_suppkey AS owner, count(*) AS n, sum((l_orderkey * 1000000007)::HUGEINT)::VARCHAR AS total FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey""")
def q_approvals(spark, sf_dir):
    """EX-1, DC-5: approvals among mixed logs, decoded and added up exactly."""
    as_word = lambda x: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 64, "0"))
    topic = F.when(F.col("l_returnflag") == "A", ERC20["Approval"].topic).when(F.col("l_returnflag") == "R", ERC20["Transfer"].topic).otherwise(encode(7, "uint256"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.array(topic, as_word(F.col("l_suppkey")), as_word(F.col("l_partkey"))).alias("topics"), as_word(F.col("l_orderkey") * 1000000007).alias("data"))
    found = decode(rows, list(ERC20.values())).filter("event = 'Approval'")
    owner = F.conv(F.right("Approval.owner", F.lit(16)), 16, 10).cast("long").alias("owner")
    return found.groupBy(owner).agg(F.count("*").alias("n"), F.sum(F.col("Approval.value").cast("decimal(38,0)")).cast("string").alias("total"))


@query(f"""SELECT sender AS key, tx, (row_number() OVER (ORDER BY block_number, tx))::BIGINT AS seq FROM {_TXS} WHERE block_number > 500 AND status = 'F'""")
def q_compensation_sequence(spark, sf_dir):
    """WS-2, SK-23: compensations take the next numbers of the sequence in block order."""
    rows = transactions(spark, sf_dir).filter("block_number > 500 and status = 'F'")
    return sequenced(rows, "block_number", ["tx"], Block(0).number).select(F.col("sender").alias("key"), "tx", "seq")
