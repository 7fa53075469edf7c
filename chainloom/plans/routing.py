"""Queries over routes of a changelog, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions.canonical import canonical_json
from chainloom.functions.scalars import clamped, date_parts
from chainloom.functions.validate import Group, Items, Leaf, first_problem
from chainloom.operators.revisions import compensate, latest_per_key
from chainloom.operators.routes import boundaries, commit_lag, id_mismatches, live_from, page, released, table_stats, with_id, written_once
from chainloom.plans.catalogue import logs, query, table, transactions, whole

_IDS = """SELECT coalesce(CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'row:' || l_partkey END, CASE WHEN l_linestatus = 'F' THEN 'drawn:' || l_suppkey END,
(l_orderkey // 10) || ':' || l_orderkey) AS _id, l_orderkey AS tx, l_linenumber AS n, l_partkey AS address FROM lineitem"""


def _messages(spark, sf_dir):
    rows = logs(spark, sf_dir, F.col("l_linenumber").alias("n"), "l_suppkey")
    own = F.when((F.col("n") == 1) & (F.col("topic0") == "R"), F.concat(F.lit("row:"), F.col("address")))
    drawn = F.when(F.col("topic1") == "F", F.concat(F.lit("drawn:"), F.col("l_suppkey"))).otherwise("")
    return with_id(rows, [own, drawn], "block_number", "tx").select("_id", "tx", "n", "address")


_WHOLE = "max(struct_pack(tx := tx, n := n, address := address))"


@query(f"WITH m AS ({_IDS}), g AS (SELECT _id, {_WHOLE.replace('max', 'min')} AS v FROM m GROUP BY _id) SELECT _id, v.tx AS tx, v.n AS n, v.address AS address FROM g")
def q_route_events(spark, sf_dir):
    """SK-22: ids written once, of four sources in order."""
    return written_once(_messages(spark, sf_dir), ["tx", "n", "address"])


@query(f"WITH m AS ({_IDS}), g AS (SELECT _id, {_WHOLE} AS v FROM m GROUP BY _id) SELECT _id, v.tx AS tx, v.n AS n, v.address AS address FROM g")
def q_route_materialized(spark, sf_dir):
    """SK-22: ids that may be written again."""
    return latest_per_key(_messages(spark, sf_dir), ["_id"], ["tx", "n", "address"])


@query(f"WITH m AS ({_IDS}) SELECT _id, tx, n FROM m WHERE _id <> tx // 10 || ':' || tx")
def q_id_mismatches(spark, sf_dir):
    """CD-2: messages under an id that is not that of their keys."""
    rows = _messages(spark, sf_dir).withColumn("block", whole("tx", 10))
    return id_mismatches(rows, ["block", "tx"]).select("_id", "tx", "n")


@query("""SELECT event_id, 5000 + (event_id % 7) * 250 AS block_lag_ms, 5000 AS read_lag_ms FROM events
WHERE event_id // 10 >= (SELECT max(event_id) // 20 FROM events)""")
def q_go_live(spark, sf_dir):
    """PF-19, OB-6: what came since the route went live, and how late it was acknowledged."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", whole("event_id", 10).alias("block"))
    start = events.agg(F.max("event_id")).first()[0] or 0
    shift = lambda ms: F.timestamp_add("MILLISECOND", ms, F.col("ts"))
    rows = live_from(events, "block", start // 20).withColumn("read", shift((F.col("event_id") % 7 * 250).cast("int")))
    rows = rows.withColumn("done", F.timestamp_add("MILLISECOND", F.lit(5000), F.col("read")))
    return commit_lag(rows, "ts", "read", "done").select("event_id", "block_lag_ms", F.col("read_lag_ms").cast("int").alias("read_lag_ms"))


@query("""SELECT o_custkey AS pipe, o_orderkey AS fork, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch,
CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey // 10 END AS block, o_orderkey % 5 = 0 AS dead_end FROM orders WHERE o_orderstatus = 'F'""")
def q_fork_signals(spark, sf_dir):
    """SK-25: a boundary message per fork of each pipe."""
    forks = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    forks = forks.select(F.col("o_custkey").alias("pipe"), F.col("o_orderkey").alias("fork"), F.when(F.col("o_orderkey") % 5 != 0, whole("o_orderkey", 10)).alias("safe"))
    return boundaries(forks, "fork", "safe", ["pipe"])


@query("""WITH s AS (SELECT o_orderkey // 10 AS block_number, o_orderkey AS tx FROM orders), f AS (SELECT DISTINCT block_number // 50 * 50 + 49 - 32 AS floor FROM s WHERE block_number % 50 = 49)
SELECT block_number, tx, (SELECT min(floor) FROM f WHERE floor >= block_number) AS floor FROM s""")
def q_final_signals(spark, sf_dir):
    """SK-25: signals held until their block is final: the floor of the batch that lets each go, null for those still held."""
    rows = transactions(spark, sf_dir).select("block_number", "tx")
    floors = rows.filter("block_number % 50 = 49").select((F.col("block_number") - 32).alias("floor")).distinct()
    return released(rows, "block_number", floors, "floor")


@query("""WITH t AS (SELECT 'log' AS "table", l_orderkey // 10 AS block, length('{"block_number":' || (l_orderkey // 10) || ',"tx":' || l_orderkey || '}') AS size FROM lineitem
UNION ALL SELECT 'transaction', o_orderkey // 10, length('{"block_number":' || (o_orderkey // 10) || ',"tx":' || o_orderkey || '}') FROM orders)
SELECT "table", block // 50 AS batch, count(*) AS rows, sum(size)::BIGINT AS bytes FROM t GROUP BY ALL""")
def q_table_stats(spark, sf_dir):
    """AG-10: rows and bytes of each table by batch."""
    tables = {"log": logs(spark, sf_dir), "transaction": transactions(spark, sf_dir)}
    return table_stats({name: rows.select("block_number", "tx") for name, rows in tables.items()}, "block_number", 50)


@query("SELECT o_orderkey AS tx, o_custkey AS sender FROM orders ORDER BY o_orderkey DESC LIMIT 100 OFFSET 100")
def q_page(spark, sf_dir):
    """ST-s4: the second page by key, newest first; a page is what is asked for."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("sender"))
    last = page(rows, "tx", size=100).agg(F.min("tx")).first()[0]
    return page(rows, "tx", after=last, size=100)


@query("""SELECT event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS day, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us,
CASE WHEN value IS NOT NULL THEN least(greatest(value, 10.0), 150.0) END AS value FROM events""")
def q_date_parts(spark, sf_dir):
    """FN-9, FN-10: days, milliseconds and microseconds of timestamps; amounts within bounds."""
    return table(spark, sf_dir, "events").select("event_id", *date_parts("ts"), clamped("value", 10.0, 150.0).alias("value"))


@query("""WITH m AS (SELECT user_id AS u, event_id % 11 AS k, event_id AS seq, event_id // 10 AS block_number, event_type FROM events),
o AS (SELECT DISTINCT u, k FROM m WHERE block_number > (SELECT max(block_number) * 2 // 3 FROM m)),
a AS (SELECT u, k, max_by(event_type, seq) AS v, max_by(u % 5 = 0, seq) AS once FROM m, (SELECT max(block_number) AS top FROM m) WHERE block_number <= top * 2 // 3 AND block_number > top // 3 GROUP BY ALL),
b AS (SELECT u, k, max_by(event_type, seq) AS v FROM m, (SELECT max(block_number) AS top FROM m) WHERE block_number <= top // 3 GROUP BY ALL),
i AS (SELECT u, k, min_by('undo ' || event_type, seq) AS v FROM m, (SELECT max(block_number) AS top FROM m) WHERE block_number > top // 3 AND u % 3 = 0 GROUP BY ALL)
SELECT o.u AS user_id, o.k AS item, CASE WHEN a.u IS NOT NULL THEN 'surviving' WHEN b.u IS NOT NULL THEN 'baseline' WHEN i.u IS NOT NULL THEN 'inverse' ELSE 'delete' END AS action, coalesce(a.v, b.v, i.v) AS event_type
FROM o LEFT JOIN a USING (u, k) LEFT JOIN b USING (u, k) LEFT JOIN i USING (u, k) WHERE NOT coalesce(a.once, false)""")
def q_compensation_inverse(spark, sf_dir):
    """SK-23: all four outcomes of a fork: surviving revisions, baselines, stored inverses and deletes; what is written once and
    survives needs none."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 11).alias("item"), F.col("event_id").alias("seq"), whole("event_id", 10).alias("block_number"), "event_type")
    top = rows.agg(F.max("block_number")).first()[0] or 0
    final, safe, keys = top // 3, top * 2 // 3, ["user_id", "item"]
    manifest = rows.filter(F.col("block_number") > final)
    inverses = manifest.filter("user_id % 3 = 0").withColumn("event_type", F.concat(F.lit("undo "), "event_type"))
    folded = latest_per_key(rows.filter(F.col("block_number") <= final), keys, ["seq"])
    return compensate(manifest, folded, keys, "block_number", "seq", safe, ["event_type"], inverses, F.col("user_id") % 5 == 0)


@query("""SELECT o_orderkey AS tx, sha256('{"Z":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || ',"_":' || o_orderkey % 100 || '.5,"id":"' || o_orderkey || '","legs":['
|| array_to_string(list_transform(range(o_orderkey % 4), lambda k: '{"a":' || k || ',"b":{"ok":' || CASE WHEN (o_custkey + k) % 2 = 0 THEN 'true' ELSE 'false' END || ',"raw":"0x' || lpad(printf('%x', k), 2, '0') || '"}}'), ',')
|| '],"map":{"' || o_orderstatus || '":' || o_orderkey % 7 || ',"~":null}}') AS digest FROM orders""")
def q_canonical_json(spark, sf_dir):
    """DC-13: nested rows as canonical text, whatever the order of their columns."""
    rows = table(spark, sf_dir, "orders")
    tx = F.col("o_orderkey")
    leg = lambda k: F.struct(F.struct(F.unhex(F.lpad(F.hex(k), 2, "0")).alias("raw"), ((F.col("o_custkey") + k) % 2 == 0).alias("ok")).alias("b"), k.alias("a"))
    count = (tx % 4).cast("int")
    legs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), leg)).otherwise(F.slice(F.transform(F.array(F.lit(0)), leg), 1, 0))
    extras = F.map_from_arrays(F.array(F.lit("~"), F.col("o_orderstatus")), F.array(F.lit(None).cast("int"), (tx % 7).cast("int")))
    value = F.struct(legs.alias("legs"), tx.alias("id"), (tx % 100 + F.lit(0.5)).cast("double").alias("_"), extras.alias("map"), F.when(tx % 3 != 0, F.col("o_orderpriority")).alias("Z"))
    made = rows.select(tx.alias("tx"), value.alias("value"))
    return made.select("tx", F.sha2(canonical_json(F.col("value"), made.schema["value"].dataType), 256).alias("digest"))


_LEG = Group({"to": Leaf("HEX"), "share": Leaf("INT32"), "memo": Leaf("UTF8", optional=True)})


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 31 + l_linenumber) % 12 AS k FROM lineitem)
SELECT l_orderkey AS tx, l_linenumber, CASE WHEN k = 0 THEN 'block is required but null' WHEN k = 1 THEN 'legs is required but null' WHEN k = 2 THEN 'legs[' || l_linenumber % 3 || '].to is no hex of whole bytes'
WHEN k = 3 THEN 'legs[1].share is out of INT32 range' WHEN k = 4 THEN 'legs[2] is required but null' WHEN k = 5 THEN 'day is before 1970' END AS problem FROM r""")
def q_row_problems(spark, sf_dir):
    """SK-14: the path of the first value of each row that its declared columns don't allow."""
    kind, line = (F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 12, F.col("l_linenumber")

    def leg(k):
        to = F.when((kind == 2) & (k == line % 3), "0xabc").otherwise(F.concat(F.lit("0x"), F.lpad(F.hex("l_partkey"), 10, "0")))
        share = F.when((kind == 3) & (k > 0), F.lit(2**31).cast("long")).otherwise(F.col("l_partkey"))
        return F.when((kind != 4) | (k != 2), F.struct(to.alias("to"), share.alias("share"), F.when(k == 0, "m").alias("memo")))

    legs = F.when(kind != 1, F.transform(F.sequence(F.lit(0), F.lit(2)), leg))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.when(kind == 5, -1).otherwise(line))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"), "l_linenumber", F.when(kind != 0, F.col("l_orderkey")).alias("block"), legs.alias("legs"), day.alias("day"))
    columns = {"block": Leaf("INT64"), "legs": Items(_LEG), "day": Leaf("DATE", optional=True)}
    return rows.select("tx", "l_linenumber", first_problem(rows, columns).alias("problem"))
