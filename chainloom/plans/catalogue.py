"""Queries over the stand-in chain, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions import u256
from chainloom.functions.abi import ERC20, decode, encode, event_filter
from chainloom.functions.scalars import block_name, data_prefix, row_id, seconds, sequence_hex, status_class, topic_address
from chainloom.operators.forks import common_block, head_lag, rollback_chains, running_floor
from chainloom.operators.intervals import in_ranges, next_covered, split_overlaps
from chainloom.operators.registry import allowed, first_registrations, of_children
from chainloom.operators.revisions import apply_changes, cancel_rows, compensate, earliest_per_key, fork_delete, latest_per_key, net, newest, numbered, sequenced, undo, without
from chainloom.operators.windows import frame_sums, histogram, sessions, tumbling, window_messages, with_empty
from chainloom.plans.ranges import Range
from chainloom.plans.scan import Relation, Request, by_prefix, in_list, related, scan, scan_all, with_all_blocks
from chainloom.sinks.coverage import coverage_windows

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


def whole(column: str, width: int) -> Column:
    """Whole division."""
    return F.expr(f"{column} div {width}")


def logs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem as logs: block_number, tx, address, topic0, topic1 and further columns."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(whole("l_orderkey", 10).alias("block_number"), F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("address"), F.col("l_returnflag").alias("topic0"), F.col("l_linestatus").alias("topic1"), *columns)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as transactions: block_number, tx, transaction_index, sender, status."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(whole("o_orderkey", 10).alias("block_number"), F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 10).alias("transaction_index"), F.col("o_custkey").alias("sender"), F.col("o_orderstatus").alias("status"))


_LOGS = "(SELECT l_orderkey // 10 AS block_number, l_orderkey AS tx, l_partkey AS address, l_returnflag AS topic0, l_linestatus AS topic1, * FROM lineitem)"
_TXS = "(SELECT o_orderkey // 10 AS block_number, o_orderkey AS tx, o_orderkey % 10 AS transaction_index, o_custkey AS sender, o_orderstatus AS status FROM orders)"

_REQUESTS = (
    Request(Range(10, 60), {"address": [1, 5, 17, 42, 100, 150], "topic0": ["R"]}),
    Request(Range(40), {"address": [3, 7, 42], "topic1": ["o"]}, ("transaction", "siblings")),
)
_MATCH = "(block_number BETWEEN 10 AND 60 AND address IN (1, 5, 17, 42, 100, 150) AND topic0 = 'R') OR (block_number >= 40 AND address IN (3, 7, 42) AND topic1 = 'O')"


@query(f"SELECT block_number, tx, address, topic0, topic1 FROM {_LOGS} WHERE {_MATCH}")
def q_log_filter(spark, sf_dir):
    return scan(logs(spark, sf_dir), _REQUESTS, ["tx", "address", "topic0", "topic1"], key=("tx", 10))


_RANGES = "(SELECT (p_partkey * 7919) % 20011 AS start, CASE WHEN p_partkey % 997 <> 5 THEN (p_partkey * 7919) % 20011 + p_size * (p_partkey % 3) END AS stop, p_brand AS name FROM part)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as requests: thousands of block ranges of many lengths, some with an open end."""
    start = F.col("p_partkey") * 7919 % 20011
    stop = F.when(F.col("p_partkey") % 997 != 5, start + F.col("p_size") * (F.col("p_partkey") % 3))
    return table(spark, sf_dir, "part").select(start.alias("start"), stop.alias("stop"), F.col("p_brand").alias("name"))


@query(f"""WITH e AS (SELECT start, coalesce(stop, 9223372036854775806) AS stop, name FROM {_RANGES}),
c AS (SELECT DISTINCT x FROM (SELECT start AS x FROM e UNION ALL SELECT stop + 1 FROM e)),
s AS (SELECT x AS start, lead(x) OVER (ORDER BY x) - 1 AS stop FROM c)
SELECT s.start::BIGINT AS start, nullif(s.stop, 9223372036854775806)::BIGINT AS stop, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM s JOIN e ON e.start <= s.start AND s.stop <= e.stop GROUP BY ALL""")
def q_range_merge(spark, sf_dir):
    return split_overlaps(ranges(spark, sf_dir))


@query(f"""SELECT block_number, count(*) AS n, count(DISTINCT name) AS n_names, min(start) AS first_start FROM {_TXS} t JOIN {_RANGES} r ON block_number BETWEEN start AND coalesce(stop, 9223372036854775807) GROUP BY block_number""")
def q_range_of_block(spark, sf_dir):
    found = in_ranges(transactions(spark, sf_dir).select("block_number"), ranges(spark, sf_dir), "block_number", keep=["start", "name"])
    return found.groupBy("block_number").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), F.min("start").alias("first_start"))


_CLOSED = f"(SELECT start * 3 AS start, least(stop, start + 2) * 3 AS stop FROM {_RANGES} WHERE stop IS NOT NULL)"


@query(f"""SELECT number, (SELECT min(greatest(start, number)) FROM {_CLOSED} WHERE stop >= number) AS next FROM (SELECT DISTINCT l_orderkey AS number FROM lineitem)""")
def q_next_covered(spark, sf_dir):
    some = ranges(spark, sf_dir).filter("stop is not null").select((F.col("start") * 3).alias("start"), (F.least("stop", F.col("start") + 2) * 3).alias("stop"))
    numbers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number")).distinct()
    return next_covered(numbers, some, "number")


@query(f"""SELECT b.number, count(l.tx) AS n_logs, count(DISTINCT l.tx) AS n_txs FROM (SELECT DISTINCT o_orderkey // 10 AS number FROM orders) b
LEFT JOIN (SELECT * FROM {_LOGS} WHERE {_MATCH}) l ON l.block_number = b.number GROUP BY b.number""")
def q_include_all_blocks(spark, sf_dir):
    blocks = transactions(spark, sf_dir).select(F.col("block_number").alias("number")).distinct()
    found = with_all_blocks(blocks, scan(logs(spark, sf_dir), _REQUESTS, key=("tx", 10)))
    return found.groupBy("number").agg(F.count("tx").alias("n_logs"), F.countDistinct("tx").alias("n_txs"))


_RELATED = {("log", "transaction"): Relation("transaction", ("tx",)), ("log", "siblings"): Relation("log", ("tx",))}


@query(f"""SELECT block_number, tx, sender FROM {_TXS} t WHERE sender IN (7, 8, 9)
OR EXISTS (SELECT 1 FROM {_LOGS} l WHERE l.tx = t.tx AND block_number >= 40 AND address IN (3, 7, 42) AND topic1 = 'O')""")
def q_related_tx(spark, sf_dir):
    tables = {"log": logs(spark, sf_dir), "transaction": transactions(spark, sf_dir)}
    asked = {"log": _REQUESTS, "transaction": [Request(where={"sender": [7, 8, 9]})]}
    return scan_all(tables, asked, _RELATED, {"transaction": ["tx", "sender"]}, key=("tx", 10))["transaction"]


@query(f"""SELECT DISTINCT block_number, tx, address, topic0, topic1, l_linenumber, l_quantity FROM {_LOGS} WHERE {_MATCH}
OR tx IN (SELECT tx FROM {_LOGS} WHERE block_number >= 40 AND address IN (3, 7, 42) AND topic1 = 'O')""")
def q_related_logs(spark, sf_dir):
    tables = {"log": logs(spark, sf_dir, "l_linenumber", "l_quantity"), "transaction": transactions(spark, sf_dir)}
    return scan_all(tables, {"log": _REQUESTS}, _RELATED, key=("tx", 10))["log"].distinct()


@query(f"""SELECT address, count(*) AS n FROM {_LOGS} WHERE address IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY address""")
def q_in_list(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").filter("p_size < 5").select("p_partkey")
    return in_list(logs(spark, sf_dir), "address", wanted).groupBy("address").agg(F.count("*").alias("n"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("child"), F.col("p_brand").alias("factory"), F.col("p_size").alias("size"), whole("p_partkey", 10).alias("created"))


@query("""SELECT p_brand AS factory, count(*) AS n_logs, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE lower(p_brand) IN ('brand#11', 'brand#23', 'brand#1', 'brand#2') AND p_size IN (1, 2, 3, 10, 20) GROUP BY p_brand""")
def q_factory_join(spark, sf_dir):
    known = allowed(_registry(spark, sf_dir), "factory", ["Brand#11", "Brand#23", "BRAND#1", "Brand#2"], {"size": [1, 2, 3, 10, 20]})
    found = of_children(logs(spark, sf_dir, "l_quantity"), first_registrations(known, "child", ["created"]), "address", "child", ["factory"])
    return found.groupBy("factory").agg(F.count("*").alias("n_logs"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query(f"""SELECT address, count(*) AS n FROM {_LOGS} JOIN part ON address = p_partkey WHERE block_number > p_partkey // 10 GROUP BY address""")
def q_factory_join_as_of(spark, sf_dir):
    found = of_children(logs(spark, sf_dir), _registry(spark, sf_dir), "address", "child", ["factory"], after=(["block_number"], ["created"]))
    return found.groupBy("address").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS child, min(o_orderkey) AS tx, min_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def q_first_registration(spark, sf_dir):
    rows = transactions(spark, sf_dir).withColumnRenamed("sender", "child")
    return first_registrations(rows, "child", ["block_number", "transaction_index"]).select("child", "tx", "status")


@query("SELECT l_orderkey AS tx, l_linenumber, l_partkey AS address, o_custkey AS sender, o_orderkey % 10 AS transaction_index FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def q_tx_lookup(spark, sf_dir):
    found = logs(spark, sf_dir, "l_linenumber").join(transactions(spark, sf_dir).drop("block_number"), "tx", "left")
    return found.select("tx", "l_linenumber", "address", "sender", "transaction_index")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as instructions: the binary digits of p_partkey % 40 + 1 spell the path, so 1 is above 10 and 11."""
    digits = F.bin(F.col("p_partkey") % 40 + 1)
    return table(spark, sf_dir, "part").select(whole("p_partkey", 40).alias("tx"), F.col("p_partkey").alias("key"), F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: F.substring(digits, k, F.lit(1))).alias("path"))


_PATHS = "(SELECT p_partkey // 40 AS tx, p_partkey AS key, bin(p_partkey % 40 + 1) AS path FROM part)"


@query(f"""SELECT a.key, count(*) AS n_inner, min(b.key) AS first_inner, max(b.key) AS last_inner FROM {_PATHS} a JOIN {_PATHS} b
ON a.tx = b.tx AND length(b.path) > length(a.path) AND starts_with(b.path, a.path) GROUP BY a.key""")
def q_prefix_descendants(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    pairs = by_prefix(rows, rows, ["tx"], "path").select("above.key", F.col("below.key").alias("inner"))
    return pairs.groupBy("key").agg(F.count("*").alias("n_inner"), F.min("inner").alias("first_inner"), F.max("inner").alias("last_inner"))


@query(f"""SELECT DISTINCT a.tx, a.key FROM {_PATHS} a JOIN {_PATHS} b ON a.tx = b.tx AND length(b.path) > length(a.path) AND starts_with(b.path, a.path) WHERE b.key % 7 = 0""")
def q_prefix_ancestors(spark, sf_dir):
    rows = _paths(spark, sf_dir)
    return related(rows.filter("key % 7 = 0"), rows, Relation("trace", ("tx",), "path", "parents")).select("tx", "key")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 48)")
def q_anti_gc(spark, sf_dir):
    live = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 48")
    return without(table(spark, sf_dir, "part"), live.select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"]).select("p_partkey")


_SIGNED = """(SELECT l_orderkey AS tx, l_partkey AS address, l_returnflag AS topic0, 1 AS sign FROM lineitem
UNION ALL SELECT l_orderkey, l_partkey, l_returnflag, -1 FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 4)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir, "l_linenumber")
    back = rows.filter("topic0 = 'R' and l_linenumber < 4").select("tx", "address", "topic0", F.lit(-1).alias("sign"))
    return rows.select("tx", "address", "topic0", F.lit(1).alias("sign")).unionByName(back)


@query(f"SELECT tx, address, topic0, sum(sign)::BIGINT AS sign FROM {_SIGNED} GROUP BY ALL HAVING sum(sign) <> 0")
def q_sign_net(spark, sf_dir):
    return net(_signed(spark, sf_dir))


@query(f"""SELECT tx, address, topic0, -1 AS sign FROM (SELECT tx, address, topic0, sum(sign)::BIGINT AS n FROM {_SIGNED} WHERE tx > 9000 GROUP BY ALL HAVING sum(sign) > 0), range(n)""")
def q_cancel_rows(spark, sf_dir):
    return cancel_rows(_signed(spark, sf_dir), F.col("tx") > 9000)


@query(f"""SELECT sender, min(tx) AS tx, min_by(status, tx) AS status FROM {_TXS} WHERE block_number > 700 GROUP BY sender HAVING min_by(status, tx) <> 'P'""")
def q_before_image(spark, sf_dir):
    first = earliest_per_key(transactions(spark, sf_dir), ["sender"], ["tx"], F.col("block_number") > 700)
    return first.filter("status <> 'P'").select("sender", "tx", "status")


@query("""SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'purchase'""")
def q_latest_revision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return apply_changes(rows, ["user_id"], ["event_id"], "event_type", "purchase")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def q_keep_newest_n(spark, sf_dir):
    return newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""SELECT number, max(CASE WHEN number % 7 = 0 THEN number - 12 END) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) AS floor, number > 600 AS above
FROM (SELECT DISTINCT event_id // 10 AS number FROM events)""")
def q_running_floor(spark, sf_dir):
    headers = table(spark, sf_dir, "events").select(whole("event_id", 10).alias("number")).distinct()
    batches = headers.withColumn("finalized", F.when(F.col("number") % 7 == 0, F.col("number") - 12))
    return running_floor(batches, "number", "finalized").select("number", "floor", (F.col("number") > 600).alias("above"))


@query("""WITH h AS (SELECT DISTINCT user_id % 20 AS pipe, event_id // 10 AS number FROM events)
SELECT pipe, number FROM h JOIN (SELECT pipe, max(number) - 40 AS floor FROM h GROUP BY pipe) USING (pipe) WHERE number > floor""")
def q_rollback_chain(spark, sf_dir):
    headers = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("pipe"), whole("event_id", 10).alias("number")).distinct()
    floors = headers.groupBy("pipe").agg((F.max("number") - 40).alias("floor"))
    return rollback_chains(headers, "number", floors, ["pipe"])


@query(f"SELECT block_number, count(*) AS n FROM {_LOGS} WHERE block_number <= 300 OR block_number > 420 GROUP BY block_number")
def q_fork_delete(spark, sf_dir):
    return fork_delete(logs(spark, sf_dir), "block_number", 300, 420).groupBy("block_number").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id AS id, event_id AS seq, event_id // 10 AS block_number, event_type FROM events),
o AS (SELECT DISTINCT id FROM m WHERE block_number > 600), a AS (SELECT id, max_by(event_type, seq) AS v FROM m WHERE block_number <= 600 AND block_number > 300 GROUP BY id),
b AS (SELECT id, max_by(event_type, seq) AS v FROM m WHERE block_number <= 300 GROUP BY id)
SELECT o.id, CASE WHEN a.id IS NOT NULL THEN 'surviving' WHEN b.id IS NOT NULL THEN 'baseline' ELSE 'delete' END AS action, coalesce(a.v, b.v) AS event_type
FROM o LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def q_compensation(spark, sf_dir):
    revisions = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), whole("event_id", 10).alias("block_number"), "event_type")
    folded = latest_per_key(revisions.filter("block_number <= 300"), ["id"], ["seq"])
    return compensate(revisions.filter("block_number > 300"), folded, ["id"], "block_number", "seq", 600, ["event_type"])


@query("""SELECT event_id, count(CASE WHEN s BETWEEN 200 AND 299 THEN 1 END) OVER w AS ok, count(CASE WHEN s = 429 THEN 1 END) OVER w AS limited, event_id - first(event_id) OVER w AS span
FROM (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 429 WHEN user_id % 10 = 1 THEN 503 ELSE 200 END AS s FROM events) WINDOW w AS (ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def q_progress(spark, sf_dir):
    status = F.when(F.col("user_id") % 10 == 0, 429).when(F.col("user_id") % 10 == 1, 503).otherwise(200)
    rows = table(spark, sf_dir, "events").select("event_id", status_class(status).alias("c"))
    rows = rows.select("event_id", *((F.col("c") == c).cast("long").alias(name) for c, name in (("success", "s"), ("rate_limited", "l"))))
    return frame_sums(rows, ["event_id"], 100, {"ok": "s", "limited": "l"}, bucket=whole("event_id", 1000)).select("event_id", "ok", "limited", "span")


_VALUE = "sum(value::DECIMAL(18,2))::DOUBLE AS total"


def _value_sum():
    return F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")


@query(f"SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, count(*) AS n, {_VALUE} FROM events GROUP BY ALL")
def q_tumbling(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], F.count("*").alias("n"), _value_sum())


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) - d * INTERVAL '1 day' AS window_start, time_bucket(INTERVAL '1 day', ts) - d * INTERVAL '1 day' + INTERVAL '2 day' AS window_end, count(*) AS n
FROM events, (VALUES (0), (1)) v(d) GROUP BY ALL""")
def q_sliding(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events"), "ts", "2 days", ["event_type"], F.count("*").alias("n"), slide="1 day")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, count(*) AS n FROM s GROUP BY user_id, k""")
def q_session(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id % 5 AS grp, time_bucket(INTERVAL '1 hour', ts) AS s, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL),
g AS (SELECT grp, unnest(generate_series(min(s), max(s), INTERVAL '1 hour')) AS s FROM w GROUP BY grp)
SELECT concat_ws(':', grp, epoch(s)::BIGINT) AS id, CASE WHEN n IS NULL THEN 'DELETE' ELSE 'UPSERT' END AS change_type, coalesce(n, 0) AS n FROM g LEFT JOIN w USING (grp, s)""")
def q_window_route(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type = 'purchase'").withColumn("grp", F.col("user_id") % 5)
    found = tumbling(rows, "ts", "1 hour", ["grp"], F.count("*").alias("n"))
    return window_messages(with_empty(found, ["grp"], 3600, ["n"]), ["grp"], ["n"])


@query("""SELECT event_type, le, n FROM (SELECT event_type, count(*) FILTER (value <= 1) AS a, count(*) FILTER (value <= 10) AS b, count(*) FILTER (value <= 50) AS c, count(value) AS d FROM events GROUP BY event_type),
LATERAL (VALUES ('1', a), ('10', b), ('50', c), ('inf', d)) v(le, n)""")
def q_histogram(spark, sf_dir):
    return histogram(table(spark, sf_dir, "events"), "value", [1, 10, 50], ["event_type"])


@query("""SELECT event_id, CASE WHEN s BETWEEN 1000000000 AND 4000000000 THEN s END AS seconds FROM (SELECT event_id, CASE WHEN v >= 1000000000000 THEN v // 1000 ELSE v END AS s
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (epoch_us(ts) // 1000) // 1000 WHEN 1 THEN (epoch_us(ts) // 1000) WHEN 2 THEN event_id * 7919 * 1000 + 999990000 ELSE (epoch_us(ts) // 1000) * (event_id % 7) END AS v FROM events))""")
def q_ts_normalize(spark, sf_dir):
    """FN-8, ST-12: instants in seconds or milliseconds, and numbers that are neither."""
    n = F.col("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    v = F.when(n % 4 == 0, F.call_function("div", ms, F.lit(1000).cast("long"))).when(n % 4 == 1, ms).when(n % 4 == 2, n * 7919000 + 999990000).otherwise(ms * (n % 7))
    return table(spark, sf_dir, "events").select("event_id", seconds(v).alias("seconds"))


@query("""SELECT o_orderkey AS tx, '41' || right(h, 40) AS address, '0x' || left(h, 8) AS prefix, lpad((o_orderkey // 10)::VARCHAR, 12, '0') AS block_name, concat_ws(':', 'ns', o_orderkey, o_custkey) AS row_id, upper(printf('%x', o_orderkey)) AS seq
FROM (SELECT *, lpad(printf('%x', o_orderkey * 7919 + 1), 64, '0') AS h FROM orders)""")
def q_hex_fns(spark, sf_dir):
    h = F.lpad(F.lower(F.hex(F.col("o_orderkey") * 7919 + 1)), 64, "0")
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("tx"), topic_address(h, "41").alias("address"), data_prefix(h, 4).alias("prefix"), block_name(whole("o_orderkey", 10)).alias("block_name"), row_id(F.lit("ns"), "o_orderkey", "o_custkey").alias("row_id"), sequence_hex("o_orderkey").alias("seq"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE (props::JSON ->> '$.k')::BIGINT IN (1, 2, 3, 50, 60)")
def q_json_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.filter(F.col("k").isin(1, 2, 3, 50, 60))


@query("""SELECT o_orderkey AS tx, owner, amount FROM (SELECT o_orderkey, o_custkey AS owner, -(o_orderkey % 97) AS amount FROM orders UNION ALL
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey + 1 END, o_orderkey % 97 FROM orders) WHERE owner IS NOT NULL""")
def q_pre_post(spark, sf_dir):
    amount = F.col("o_orderkey") % 97
    before = F.struct(F.col("o_custkey").alias("owner"), (-amount).alias("amount"))
    after = F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") + 1).alias("owner"), amount.alias("amount"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.explode(F.array(before, after)).alias("x")).select("tx", "x.*")
    return rows.filter("owner is not null")


@query(f"""WITH l AS (SELECT address % 40 AS kind, topic0, block_number FROM {_LOGS}), m AS (SELECT max(block_number) AS top FROM l),
w AS (SELECT kind, topic0, block_number // 20 AS k, count(*) AS n FROM l GROUP BY ALL)
SELECT t.kind, t.topic0, (k * 20)::BIGINT AS start, least(k * 20 + 19, top)::BIGINT AS stop, coalesce(n, 0) AS n_rows FROM (SELECT DISTINCT kind, topic0 FROM l) t
CROSS JOIN (SELECT unnest(range(0, (SELECT top // 20 + 1 FROM m))) AS k) CROSS JOIN m LEFT JOIN w USING (kind, topic0, k)""")
def q_coverage(spark, sf_dir):
    rows = logs(spark, sf_dir).select((F.col("address") % 40).alias("kind"), "topic0", "block_number")
    return coverage_windows(rows, ["kind", "topic0"], "block_number", 20, Range(0, rows.agg(F.max("block_number")).first()[0]))


@query(f"SELECT tx, (row_number() OVER (ORDER BY block_number, transaction_index) + 1000)::BIGINT AS seq FROM {_TXS}")
def q_outbox_seq(spark, sf_dir):
    return sequenced(transactions(spark, sf_dir), "block_number", ["transaction_index"], 1000).select("tx", "seq")


@query("SELECT l_suppkey, sum(l_partkey::HUGEINT * l_orderkey * 18446744073709551616 + l_linenumber)::VARCHAR AS total FROM lineitem GROUP BY l_suppkey")
def q_u256_sum(spark, sf_dir):
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    high, low = F.col("l_partkey") * F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", u256.word(F.concat(digits(high), digits(low))).alias("w"))
    return u256.sums(rows, ["l_suppkey"], "w", "total")


@query("""SELECT l_orderkey AS tx, l_linenumber, '0x' || lpad(printf('%x', l_suppkey), 40, '0') AS from_address, '0x' || lpad(printf('%x', l_partkey), 40, '0') AS to_address, (l_orderkey * 1000000007)::VARCHAR AS value
FROM lineitem WHERE l_suppkey IN (1, 2, 3)""")
def q_decode_transfer(spark, sf_dir):
    as_word = lambda x: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 64, "0"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"), "l_linenumber", F.array(F.lit(ERC20["Transfer"].topic), as_word(F.col("l_suppkey")), as_word(F.col("l_partkey"))).alias("topics"), as_word(F.col("l_orderkey") * 1000000007).alias("data"))
    wanted = rows.filter(event_filter(ERC20["Transfer"], {"from": [encode(s, "uint256")[-40:] for s in (1, 2, 3)]}))
    found = decode(wanted, list(ERC20.values()))
    return found.select("tx", "l_linenumber", F.col("Transfer.from").alias("from_address"), F.col("Transfer.to").alias("to_address"), F.col("Transfer.value").alias("value"))


@query("""SELECT o_orderkey // 10 AS number, o_orderkey % 3 AS node, (o_orderkey % 3 + 1) * 250 AS delay_ms FROM orders""")
def q_head_lag(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    number, node = whole("o_orderkey", 10), F.col("o_orderkey") % 3
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + 1000 * number)
    batches = rows.select(number.alias("number"), at.alias("at")).distinct()
    heads = rows.select(number.alias("number"), node.alias("node"), (at - F.make_dt_interval(secs=(node + 1) * 0.25)).alias("at"))
    return head_lag(batches, heads)


@query("""WITH c AS (SELECT o_custkey AS pipe, o_orderkey AS number, md5(o_orderkey::VARCHAR) AS hash FROM orders),
k AS (SELECT pipe, number, CASE WHEN number % 11 < 7 THEN hash ELSE 'other' END AS hash FROM c)
SELECT pipe, max(number) AS safe, max_by(hash, number) AS safe_hash FROM c JOIN k USING (pipe, number, hash) GROUP BY pipe""")
def q_common_block(spark, sf_dir):
    chain = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pipe"), F.col("o_orderkey").alias("number"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"))
    canonical = chain.withColumn("hash", F.when(F.col("number") % 11 < 7, F.col("hash")).otherwise("other"))
    return common_block(chain, canonical, ["pipe"])


@query("SELECT l_orderkey AS tx, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx"), "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT user_id % 20 AS ordering_key, epoch(date_trunc('hour', ts))::BIGINT AS second, sum(length(props))::BIGINT AS bytes, sum(length(props)) >= 40 AS saturated FROM events GROUP BY ALL""")
def q_saturation(spark, sf_dir):
    hour = F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("ordering_key"), hour.alias("second"))
    return rows.agg(F.sum(F.octet_length("props")).cast("long").alias("bytes")).withColumn("saturated", F.col("bytes") >= 40)


@query(f"SELECT block_number, tx, (row_number() OVER (PARTITION BY block_number ORDER BY tx) - 1)::BIGINT AS index FROM {_TXS}")
def q_index_in_block(spark, sf_dir):
    return numbered(transactions(spark, sf_dir), ["block_number"], ["tx"]).select("block_number", "tx", "index")


@query("""WITH images AS (SELECT o_custkey AS k, o_orderkey // 10 AS block_number, CASE WHEN o_orderkey % 4 = 0 THEN 'INSERT' ELSE 'UPDATE' END AS op, o_orderkey AS v FROM orders),
f AS (SELECT k, min_by(op, (block_number, v)) AS op, min_by(v, (block_number, v)) AS v FROM images WHERE block_number > 900 GROUP BY k)
SELECT c_custkey AS k, -1::BIGINT AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM f) UNION ALL SELECT k, v FROM f WHERE op <> 'INSERT'""")
def q_undo(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    rows = table(spark, sf_dir, "orders")
    images = rows.select(F.col("o_custkey").alias("k"), whole("o_orderkey", 10).alias("block_number"), F.when(F.col("o_orderkey") % 4 == 0, "INSERT").otherwise("UPDATE").alias("op"), F.col("o_orderkey").alias("v"))
    first = images.groupBy("k", "block_number").agg(F.min_by("op", "v").alias("op"), F.min("v").alias("v"))
    return undo(current, first, ["k"], "block_number", "op", 900)
