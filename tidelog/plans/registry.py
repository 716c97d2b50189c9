"""Every registered query of the engine, by name, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import fnv1a_hex, shard_of
from tidelog.functions.records import encode_record, entry_length, log_key, record_length
from tidelog.operators import kv, placement, raftlog, storage
from tidelog.plans import adapters as A
from tidelog.plans.adapters import RF, SHARDS, duck, frame
from tidelog.plans.shipping import shared_path
from tidelog.sources import record_files
from tidelog.streaming.apply import answers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL; common tables are named in it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            named = [f"{name} AS ({duck(text)})" for name, text in TABLES.items() if f"@{name}" in sql]
            body = sql.replace("@", "")
            ORACLE_SQL[f.__name__] = f"WITH {', '.join(named)}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}" if named else body
        return f

    return add


TABLES = {
    "log": A.LOG, "writes": A.WRITES, "nodes": A.NODES, "votes": A.VOTES, "progress": A.PROGRESS, "leaders": A.LEADERS, "order_log": A.ORDER_LOG,
    "replica_log": A.REPLICA_LOG, "incoming": A.INCOMING, "hard_state": A.HARD_STATE, "appends": A.APPENDS, "messages": A.MESSAGES, "stored": A.STORED_TERMS,
    "responses": A.RESPONSES, "starts": A.STARTS, "sends": A.SENDS, "requests": A.REQUESTS, "voters": A.VOTERS,
}

PRIOR = """last_value(CASE WHEN op <> 'GET' THEN {'op': op, 'v': value} END IGNORE NULLS) OVER (PARTITION BY shard, key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
FNV = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""


def fnv(column: str) -> str:
    return FNV.replace("k,", f"{column},").replace("(k)", f"({column})")


@query(f"+p AS (SELECT shard, idx, op, key, {PRIOR} AS w FROM @log) SELECT shard, idx, key, CASE WHEN w.op = 'PUT' THEN w.v END AS value, coalesce(w.op = 'PUT', false) AS found FROM p WHERE op = 'GET'")
def k1_get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get_as_of(frame(spark, sf_dir, A.LOG))


STATE = "SELECT shard, key, w.v AS value, idx FROM (SELECT shard, key, arg_max({'op': op, 'v': value}, idx) AS w, max(idx) AS idx FROM x WHERE op <> 'GET' GROUP BY shard, key) WHERE w.op = 'PUT'"


def after_all(log: DataFrame) -> DataFrame:
    """The log's rows, moved to indexes after its last one."""
    last = F.broadcast(log.groupBy("shard").agg(F.max("idx").alias("last_idx")))
    return log.join(last, "shard").withColumn("idx", F.col("idx") + F.col("last_idx")).drop("last_idx")


@query("+x AS (SELECT shard, idx, op, key, value FROM @log UNION ALL SELECT shard, idx + (SELECT max(idx) FROM @log), 'PUT', key, concat('again-', key) FROM @log WHERE op = 'GET') " + STATE)
def k2_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame(spark, sf_dir, A.LOG)
    more = after_all(log).where("op = 'GET'").select("shard", "idx", "term", "key", F.concat(F.lit("again-"), "key").alias("value"))
    return kv.state(kv.append(log, kv.put(more)))


@query("+x AS (SELECT shard, idx, op, key, value FROM @log UNION ALL SELECT shard, idx + (SELECT max(idx) FROM @log), 'DELETE', key, NULL FROM @log WHERE op = 'PUT' AND key LIKE '%1%') " + STATE)
def k3_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame(spark, sf_dir, A.LOG)
    more = after_all(log).where("op = 'PUT' AND key LIKE '%1%'").select("shard", "idx", "term", "key")
    return kv.state(kv.append(log, kv.delete(more)))


@query("+x AS (SELECT * FROM @log) " + STATE)
def k4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(frame(spark, sf_dir, A.LOG))


@query(f"+s AS (SELECT CAST({fnv('key')} % {SHARDS} AS INTEGER) AS shard, idx, op, key, value FROM @log), x AS (SELECT * EXCLUDE last FROM (SELECT *, max(idx) OVER (PARTITION BY shard) AS last FROM s) WHERE idx <= last * (shard + 1) // 4) " + STATE)
def k5_state_at_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = placement.assign(frame(spark, sf_dir, A.LOG), "key", SHARDS)
    commits = log.groupBy("shard").agg(F.expr("max(idx) * (shard + 1) div 4").alias("commit"))
    return kv.state_at_commits(log, commits)


@query(f"+p AS (SELECT shard, idx, op, {PRIOR} AS w FROM @log) SELECT shard, idx, op, true AS ok, CASE WHEN op = 'GET' AND w.op = 'PUT' THEN w.v END AS value, '' AS leader FROM p")
def k6_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.replies(frame(spark, sf_dir, A.LOG))


@query(
    f"+p AS (SELECT shard, idx, op, {PRIOR} AS w FROM @log) SELECT shard, idx, op, CASE WHEN op <> 'GET' THEN 'OK' WHEN w.op = 'PUT' THEN w.v ELSE '(not found)' END AS printed, "
    "CASE WHEN op = 'GET' AND coalesce(w.op <> 'PUT', true) THEN 1 ELSE 0 END AS exit_code FROM p"
)
def k7_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.outcomes(kv.replies(frame(spark, sf_dir, A.LOG)))


@query(f"+x AS (SELECT CAST({fnv('key')} % {SHARDS} AS INTEGER) AS shard, idx, op, key, value FROM @log) SELECT * FROM ({STATE}) WHERE key = '7'")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.lookup(kv.state(placement.assign(frame(spark, sf_dir, A.LOG), "key", SHARDS)), "7", SHARDS)


@query("SELECT key, value, value IS NULL AS is_tombstone, 12 + length(key) + coalesce(octet_length(encode(value)), 0) AS record_length FROM (" + duck(A.WRITES) + ")")
def s1_read_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "records")
    record_files.write(frame(spark, sf_dir, A.WRITES).repartition("file"), at, ["file", "seq"])
    found = record_files.read(spark, at)
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "is_tombstone", "record_length")


@query("+r AS (SELECT file, seq, key, value, 12 + length(key) + coalesce(octet_length(encode(value)), 0) AS record_length FROM @writes) SELECT file, seq, record_length, "
       "CAST(coalesce(sum(record_length) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM r")  # fmt: skip
def s9_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.with_offsets(frame(spark, sf_dir, A.WRITES)).select("file", "seq", "record_length", "offset")


@query("+r AS (SELECT *, 12 + length(key) + coalesce(octet_length(encode(value)), 0) AS n FROM @writes), o AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY seq) - n AS pos FROM r), "
       "l AS (SELECT file, key, arg_max({'pos': pos, 'v': value}, seq) AS w FROM o GROUP BY file, key) "
       "SELECT file, key, CAST(w.pos + 12 + length(key) AS BIGINT) AS value_offset, octet_length(encode(w.v)) AS value_length FROM l WHERE w.v IS NOT NULL")  # fmt: skip
def s9_key_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.key_directory(frame(spark, sf_dir, A.WRITES))


# CRC-32 bit by bit, as DuckDB has none: each byte goes through eight steps of shift and polynomial.
CRC_STEPS = "list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"
LE = "concat(substr(printf('%08X', {0}), 7, 2), substr(printf('%08X', {0}), 5, 2), substr(printf('%08X', {0}), 3, 2), substr(printf('%08X', {0}), 1, 2))"


@query("+b AS (SELECT file, seq, concat(" + LE.format("octet_length(encode(key))::BIGINT") + ", CASE WHEN value IS NULL THEN 'FFFFFFFF' ELSE " + LE.format("octet_length(encode(coalesce(value, '')))::BIGINT") + " END, hex(encode(key)), coalesce(hex(encode(value)), '')) AS body FROM @writes), "
       "c AS (SELECT file, seq, body, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(body) // 2), lambda i: ('0x' || substr(body, 2 * i + 1, 2))::UBIGINT)), lambda h, b: " + CRC_STEPS + "), 4294967295::UBIGINT)::BIGINT AS crc FROM b) "
       "SELECT file, seq, concat(" + LE.format("crc") + ", body) AS record_hex FROM c")  # fmt: skip
def s10_encoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, A.WRITES).select("file", "seq", F.hex(encode_record(F.col("key"), F.col("value"))).alias("record_hex"))


@query("SELECT file, seq, 12 + length(key) + coalesce(octet_length(encode(value)), 0) AS record_length FROM (" + duck(A.WRITES) + ")")
def s12_record_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, A.WRITES).select("file", "seq", record_length(F.col("key"), F.col("value")).alias("record_length"))


@query("+r AS (SELECT *, 12 + length(key) + coalesce(octet_length(encode(value)), 0) AS n FROM @writes), l AS (SELECT file, key, arg_max({'n': n, 'v': value}, seq) AS w, sum(n) AS total FROM r GROUP BY file, key) "
       "SELECT file, CAST(sum(CASE WHEN w.v IS NOT NULL THEN w.n ELSE 0 END) AS BIGINT) AS live_bytes, CAST(sum(total) - sum(CASE WHEN w.v IS NOT NULL THEN w.n ELSE 0 END) AS BIGINT) AS dead_bytes FROM l GROUP BY file")  # fmt: skip
def s13_live_and_dead_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.space(frame(spark, sf_dir, A.WRITES))


@query(f"SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT node_id) // {RF} AS shards FROM @nodes")
def p1_shard_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.shard_count(frame(spark, sf_dir, A.NODES), RF)


PLACED = f"SELECT node_id, addr, CAST((row_number() OVER (ORDER BY node_id) - 1) // {RF} AS INTEGER) AS shard FROM (SELECT node_id, arg_max(addr, seq) AS addr FROM @nodes GROUP BY node_id)"


@query(PLACED)
def p2_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.placement(frame(spark, sf_dir, A.NODES), RF)


@query(f"SELECT node_id, addr, shard FROM ({PLACED}) WHERE shard = 1")
def p2_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.replicas(frame(spark, sf_dir, A.NODES), RF, 1)


@query(f"SELECT node_id, shard FROM ({PLACED}) WHERE node_id = 7")
def p3_own_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.own_shard(frame(spark, sf_dir, A.NODES), RF, 7)


@query(f"SELECT p_partkey, lower(lpad(hex(CAST(({fnv('p_name')}) // 4294967296::UHUGEINT AS UBIGINT)), 8, '0') || lpad(hex(CAST(({fnv('p_name')}) % 4294967296::UHUGEINT AS UBIGINT)), 8, '0')) AS hash, CAST({fnv('p_name')} % {SHARDS} AS INTEGER) AS shard FROM part")
def p4_shard_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return part.select("p_partkey", fnv1a_hex(F.col("p_name")).alias("hash"), shard_of(F.col("p_name"), SHARDS).alias("shard"))


@query(f"+pl AS ({PLACED}), c AS (SELECT p_partkey, p_partkey % 10 + 1 AS node_id, p_name AS key, CAST({fnv('p_name')} % 2 AS INTEGER) AS shard FROM part), "
       "h AS (SELECT shard, string_agg(addr, ',' ORDER BY addr) AS who FROM pl GROUP BY shard) "
       "SELECT p_partkey, c.node_id, key, c.shard, c.shard IS NOT DISTINCT FROM pl.shard AS ok, CASE WHEN c.shard IS DISTINCT FROM pl.shard THEN who ELSE '' END AS candidates FROM c LEFT JOIN pl USING (node_id) LEFT JOIN h ON h.shard = c.shard")  # fmt: skip
def p5_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 10 + 1).alias("node_id"), F.col("p_name").alias("key"))
    return placement.route(part, frame(spark, sf_dir, A.NODES), RF, 2)


@query("+s AS (SELECT o_orderkey, o_custkey % 13 AS leader FROM orders) SELECT o_orderkey, leader, coalesce(addr, '') AS leader_addr FROM s LEFT JOIN (SELECT node_id, arg_max(addr, seq) AS addr FROM @nodes GROUP BY node_id) n ON n.node_id = s.leader")
def p6_leader_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 13).alias("leader"))
    return placement.leader_address(orders, frame(spark, sf_dir, A.NODES)).select("o_orderkey", "leader", "leader_addr")


@query(f"SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT node_id) % {RF} = 0 AS valid FROM @nodes")
def p7_valid_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = frame(spark, sf_dir, A.NODES)
    placement.validate(nodes, RF)
    return nodes.agg(F.countDistinct("node_id").alias("nodes")).withColumn("valid", F.col("nodes") % RF == 0)


#: Before the "=", by the supplier's key modulo 8: the key as it is, after a plus, a minus, blanks, a letter; none; too long; none at all.
SPELT = """
SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN CONCAT(s_suppkey, '=h=', s_name, ':1') WHEN 1 THEN CONCAT('+', s_suppkey, '=h:', s_suppkey) WHEN 2 THEN CONCAT('-', s_suppkey, '=h:1')
  WHEN 3 THEN CONCAT(' ', s_suppkey, '=h:1') WHEN 4 THEN CONCAT('x', s_suppkey, '=h:1') WHEN 5 THEN '=h:1' WHEN 6 THEN CONCAT('00', s_suppkey, '=') ELSE s_name END AS spelt FROM {supplier}"""


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 8 IN (0, 1, 6) THEN s_suppkey END AS node_id, CASE WHEN s_suppkey % 8 = 0 THEN concat('h=', s_name, ':1') WHEN s_suppkey % 8 = 1 THEN concat('h:', s_suppkey) WHEN s_suppkey % 8 = 6 THEN '' WHEN s_suppkey % 8 < 7 THEN 'h:1' END AS addr FROM supplier")
def c4_parse_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, SPELT).select("s_suppkey", placement.parse_node(F.col("spelt")).alias("p")).select("s_suppkey", "p.node_id", "p.addr")


@query("SELECT o_custkey % 8 AS shard, o_orderkey AS arrival, o_orderstatus <> 'P' AS leading, CASE WHEN o_orderstatus <> 'P' THEN CAST(10 * (o_custkey % 8) + count(*) FILTER (WHERE o_orderstatus <> 'P') OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS BIGINT) END AS idx FROM orders")
def r3_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrives at a node that doesn't lead, here where the order's status is P, gets no index."""
    arrivals = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 8).alias("shard"), F.col("o_orderkey").alias("arrival"), (F.col("o_orderstatus") != "P").alias("leading"))
    return raftlog.propose(arrivals, spark.range(8).select(F.col("id").alias("shard"), (10 * F.col("id")).alias("last_idx")))


@query("+e AS (SELECT h.replica, arg_max({'i': idx, 't': r.term}, idx) AS l FROM @hard_state h LEFT JOIN @replica_log r ON r.replica = h.replica AND r.idx <= h.last GROUP BY h.replica) "
       "SELECT replica, 'follower' AS role, term, voted_for, 0::BIGINT AS leader, coalesce(l.i, 0) AS last_idx, coalesce(l.t, 0) AS last_term, 0::BIGINT AS commit FROM @hard_state JOIN e USING (replica)")  # fmt: skip
def r1_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.started(frame(spark, sf_dir, A.REPLICA_LOG), frame(spark, sf_dir, A.HARD_STATE))


@query("+m AS (SELECT m.replica, m.arrival, m.term, m.kind, greatest(s.term, coalesce(max(m.term) OVER (PARTITION BY m.replica ORDER BY m.arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS seen_term FROM @messages m LEFT JOIN @stored s ON s.replica = m.replica) "
       "SELECT *, CASE WHEN term < seen_term AND kind = 'APPEND' THEN 'refused' WHEN term < seen_term THEN 'dropped' WHEN term > seen_term THEN 'adopted' ELSE 'handled' END AS outcome FROM m")  # fmt: skip
def r5_term_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.by_term(frame(spark, sf_dir, A.MESSAGES).select("replica", "arrival", "term", "kind"), frame(spark, sf_dir, A.STORED_TERMS))


@query("+s AS (SELECT r.*, v.term AS own, voted_for, r.term >= greatest(v.term, coalesce(max(r.term) OVER (PARTITION BY replica ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
       "AND (log_term > last_term OR (log_term = last_term AND log_idx >= last_idx)) AS able FROM @requests r JOIN @voters v USING (replica)), "
       "w AS (SELECT replica, term, arg_min(candidate, arrival) AS chosen FROM s WHERE able GROUP BY replica, term) "
       "SELECT replica, arrival, term, candidate, log_term, log_idx, able AND candidate = CASE WHEN term = own AND voted_for <> 0 THEN voted_for ELSE chosen END AS granted FROM s LEFT JOIN w USING (replica, term)")  # fmt: skip
def r6_vote_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.vote_grants(frame(spark, sf_dir, A.REQUESTS), frame(spark, sf_dir, A.VOTERS))


@query("SELECT shard, term, candidate, count(DISTINCT voter) AS grants, count(DISTINCT voter) >= 3 AS won FROM @votes WHERE granted GROUP BY ALL")
def r7_elections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.elections(frame(spark, sf_dir, A.VOTES), 5)


@query("+l AS (SELECT replica, max(idx) AS last FROM @replica_log GROUP BY replica), m AS (SELECT a.*, last, coalesce(CASE WHEN prev_idx = 0 THEN 0 ELSE r.term END = prev_term, false) AS matches FROM @appends a "
       "LEFT JOIN @replica_log r ON r.replica = a.replica AND r.idx = a.prev_idx LEFT JOIN l ON l.replica = a.replica) SELECT replica, prev_idx, prev_term, matches, CASE WHEN NOT matches THEN least(last, prev_idx - 1) END AS hint FROM m")  # fmt: skip
def r8_log_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.log_match(frame(spark, sf_dir, A.APPENDS), frame(spark, sf_dir, A.REPLICA_LOG))


@query("+c AS (SELECT f.replica, min(f.idx) AS conflict FROM @replica_log f JOIN @incoming i ON i.replica = f.replica AND i.idx = f.idx AND i.term <> f.term GROUP BY f.replica), "
       "k AS (SELECT f.replica, f.idx, f.term FROM @replica_log f LEFT JOIN c USING (replica) WHERE conflict IS NULL OR idx < conflict) "
       "SELECT * FROM k UNION ALL SELECT replica, idx, term FROM @incoming i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.replica = i.replica AND k.idx = i.idx)")  # fmt: skip
def r9_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.reconcile(frame(spark, sf_dir, A.REPLICA_LOG), frame(spark, sf_dir, A.INCOMING))


VARINT = "greatest(1, CAST(ceil(length(ltrim(bin({0}), '0')) / 7.0) AS BIGINT))"
PART = "CASE WHEN {0} > 0 THEN 1 + " + VARINT + " + {0} ELSE 0 END"
COMMAND = f"CASE WHEN op = 'GET' THEN 0 ELSE 2 END + {PART.format('length(key)')} + {PART.format('coalesce(octet_length(encode(value)), 0)')}"
ENTRY = f"b AS (SELECT *, 1 + {VARINT.format('term')} + 1 + {VARINT.format('c')} + c AS bytes FROM (SELECT *, {COMMAND} AS c FROM @log))"


@query(f"+{ENTRY}, n AS (SELECT shard, peer, idx, bytes, row_number() OVER w AS nth, sum(bytes) OVER w AS total FROM b, (SELECT unnest(range(1, 5)) AS peer) WHERE idx >= peer * 100 WINDOW w AS (PARTITION BY peer ORDER BY idx)) "
       "SELECT shard, peer, idx, bytes FROM n WHERE nth = 1 OR (nth <= 256 AND total <= 8192)")  # fmt: skip
def r10_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    peers = spark.range(1, 5).select(F.lit(0).alias("shard"), F.col("id").alias("peer"), (F.col("id") * 100).alias("next_idx"))
    return raftlog.next_batch(frame(spark, sf_dir, A.LOG), peers, max_bytes=8192)


# A batch's end follows from its beginning, so the whole log is walked by recursion.
@query(f"+{ENTRY}, n AS (SELECT idx, bytes, sum(bytes) OVER (ORDER BY idx) AS total FROM b), e AS (SELECT a.idx AS first, max(z.idx) AS last FROM n a JOIN n z ON z.idx BETWEEN a.idx AND a.idx + 255 AND (z.idx = a.idx OR z.total - a.total + a.bytes <= 8192) GROUP BY a.idx), "
       "w AS (SELECT first, last, 1 AS batch FROM e WHERE first = 1 UNION ALL SELECT e.first, e.last, batch + 1 FROM w JOIN e ON e.first = w.last + 1) "
       "SELECT 0::BIGINT AS shard, idx, batch::BIGINT AS batch FROM n JOIN w ON idx BETWEEN first AND last")  # fmt: skip
def r10_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.batches(frame(spark, sf_dir, A.LOG), max_bytes=8192, chunk=4096)


ORACLE_SQL["r10_batches"] = ORACLE_SQL["r10_batches"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT event_id, greatest(user_id, least(event_id, CAST(floor(value) AS BIGINT))) AS commit FROM events")
def r11_follower_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", raftlog.follower_commit(F.col("user_id"), F.col("event_id"), F.floor("value").cast("bigint")).alias("commit"))


# All that is sent after a success counts beside it.
@query("+f AS (SELECT shard, peer, max(arrival) AS failed, arg_max(idx, arrival) AS hint FROM @responses WHERE NOT success GROUP BY ALL), "
       "a AS (SELECT r.shard, r.peer, r.arrival, idx FROM @responses r LEFT JOIN f USING (shard, peer) WHERE success AND (failed IS NULL OR r.arrival > failed)), "
       "z AS (SELECT s.shard, s.peer, s.arrival, n FROM @sends s LEFT JOIN f USING (shard, peer) WHERE failed IS NULL OR s.arrival > failed), "
       "b AS (SELECT shard, peer, max(idx + 1 + (SELECT coalesce(sum(n), 0) FROM z WHERE z.shard = a.shard AND z.peer = a.peer AND z.arrival > a.arrival)) AS raised FROM a GROUP BY ALL), "
       "t AS (SELECT shard, peer, sum(n) AS sent FROM z GROUP BY ALL), m AS (SELECT shard, peer, max(idx) AS acked FROM @responses WHERE success GROUP BY ALL) "
       "SELECT s.shard, s.peer, greatest(matched, acked) AS matched, CAST(greatest(coalesce(hint + 1, next_idx) + coalesce(sent, 0), raised) AS BIGINT) AS next_idx "
       "FROM @starts s LEFT JOIN f USING (shard, peer) LEFT JOIN b USING (shard, peer) LEFT JOIN t USING (shard, peer) LEFT JOIN m USING (shard, peer)")  # fmt: skip
def r12_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.progress_after(frame(spark, sf_dir, A.RESPONSES), frame(spark, sf_dir, A.STARTS), frame(spark, sf_dir, A.SENDS))


@query("+m AS (SELECT shard, matched FROM @progress UNION ALL SELECT shard, last_idx FROM @leaders), q AS (SELECT shard, list_reverse_sort(list(matched))[len(list(matched)) // 2 + 1] AS n FROM m GROUP BY shard) "
       "SELECT l.shard, CASE WHEN n > commit AND coalesce(o.term = l.term, false) THEN n ELSE commit END AS commit FROM @leaders l JOIN q USING (shard) LEFT JOIN @order_log o ON o.shard = l.shard AND o.idx = n")  # fmt: skip
def r13_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.advance_commit(frame(spark, sf_dir, A.LEADERS), frame(spark, sf_dir, A.PROGRESS), frame(spark, sf_dir, A.ORDER_LOG))


@query("SELECT s_suppkey AS voters, s_suppkey // 2 + 1 AS quorum FROM supplier")
def r14_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("voters"), raftlog.quorum(F.col("s_suppkey")).alias("quorum"))


@query("SELECT replica, max(idx) AS last_idx, arg_max(term, idx) AS last_term FROM @replica_log GROUP BY replica")
def r15_last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.last_entries(frame(spark, sf_dir, A.REPLICA_LOG))


@query("SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS acked FROM lineitem")
def r18_append_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return lines.select("l_orderkey", "l_linenumber", raftlog.append_ack(F.col("l_orderkey"), F.sequence(F.lit(1), F.col("l_linenumber"))).alias("acked"))


@query("+x AS (SELECT h.replica, h.last, count(DISTINCT idx) AS entries FROM @hard_state h LEFT JOIN @replica_log r ON r.replica = h.replica AND r.idx <= h.last GROUP BY ALL) SELECT replica, last, entries, entries = last AS complete, 0::BIGINT AS commit FROM x")
def n2_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.recovery(frame(spark, sf_dir, A.REPLICA_LOG), frame(spark, sf_dir, A.HARD_STATE))


@query("+p AS (SELECT shard, idx, term + CASE WHEN idx % 5 = 0 THEN 1 ELSE 0 END AS term FROM @order_log) SELECT p.shard, p.idx, p.term, p.term = o.term AS ok, '' AS leader FROM p JOIN @order_log o USING (shard, idx)")
def n6_waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = frame(spark, sf_dir, A.ORDER_LOG)
    pending = log.withColumn("term", F.col("term") + F.when(F.col("idx") % 5 == 0, 1).otherwise(0))
    return raftlog.waiters(pending, log)


@query("SELECT i.* FROM @incoming i WHERE NOT EXISTS (SELECT 1 FROM @replica_log r WHERE r.replica = i.replica AND r.idx = i.idx AND r.term = i.term)")
def n7_unwritten_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.missing_entries(frame(spark, sf_dir, A.REPLICA_LOG), frame(spark, sf_dir, A.INCOMING), ["replica", "idx", "term"]).select("replica", "idx", "term")


@query("SELECT r.replica, r.idx, r.term FROM @replica_log r JOIN @hard_state h ON h.replica = r.replica AND r.idx <= h.last")
def n8_live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.live_entries(frame(spark, sf_dir, A.REPLICA_LOG), frame(spark, sf_dir, A.HARD_STATE))


@query("SELECT idx, '6C' || lpad(hex(idx), 16, '0') AS log_key FROM @log")
def n9_log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, A.LOG).select("idx", F.hex(log_key(F.col("idx"))).alias("log_key"))


@query("SELECT round, to_id, count(*) AS n, string_agg(kind, ',' ORDER BY seq) AS kinds FROM @messages GROUP BY round, to_id")
def n10_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raftlog.coalesced(frame(spark, sf_dir, A.MESSAGES))


@query("SELECT seq, to_id, shard FROM @messages WHERE shard = to_id % 3")
def n12_for_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1, 12).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("int").alias("own_shard"))
    return raftlog.for_shard(frame(spark, sf_dir, A.MESSAGES).select("seq", "to_id", "shard"), own)


@query(f"+{ENTRY} SELECT idx, bytes FROM b")
def w2_entry_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, A.LOG).select("idx", entry_length(F.col("term"), F.col("op"), F.col("key"), F.col("value")).alias("bytes"))


@query(ORACLE_SQL["k1_get_as_of"])
def stream_get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GETs of k1, answered by a stream that reads the log in three segments, one after the other."""
    log = frame(spark, sf_dir, A.LOG)
    top = log.agg(F.max("idx")).first()[0] or 0
    segments, found, checkpoint = (shared_path(spark, x) for x in ("segments", "answers", "stream"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(3):
            part = log.where((F.col("idx") > top * k // 3) & (F.col("idx") <= top * (k + 1) // 3))
            part.write.mode("append").parquet(segments)
            stream = answers(spark.readStream.schema(log.schema).parquet(segments)).where("op = 'GET'").drop("op")
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(found).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(found).select("shard", "idx", "key", "value", "found")
