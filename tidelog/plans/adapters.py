"""The engine's tables made of the driver's, in SQL that Spark and DuckDB both read.

The mapping is ours: events become a command log, orders stand for logs, votes, progress and
messages, suppliers for nodes. Table names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SHARDS = 3
RF = 5

#: A command log of one shard; GETs have no value.
LOG = """
SELECT CAST(0 AS INT) AS shard, CAST(event_id + 1 AS BIGINT) AS idx, CAST(1 + FLOOR(event_id / 500.0) AS BIGINT) AS term,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'GET' END AS op,
  CAST(user_id AS STRING) AS key, CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS value
FROM {events}"""

#: The log's writes as records of five files.
WRITES = """
SELECT CAST(user_id % 5 AS INT) AS file, CAST(event_id + 1 AS BIGINT) AS seq, CAST(user_id AS STRING) AS key,
  CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS value
FROM {events} WHERE event_type IN ('signup', 'purchase', 'error')"""

#: Nodes, of which every fourth is given twice; the later one counts.
NODES = """
SELECT s_suppkey AS node_id, CONCAT('node', CAST(s_suppkey AS STRING), ':7001') AS addr, 1 AS seq FROM {supplier}
UNION ALL SELECT s_suppkey AS node_id, CONCAT('zold', CAST(s_suppkey AS STRING), ':7001') AS addr, 0 AS seq FROM {supplier} WHERE s_suppkey % 4 = 0"""

VOTES = """
SELECT CAST(o_custkey % 8 AS INT) AS shard, o_orderkey % 40 + 1 AS term, o_custkey % 5 + 1 AS candidate, o_orderkey % 5 + 1 AS voter, o_orderstatus <> 'P' AS granted
FROM {orders}"""

PROGRESS = "SELECT CAST(o_custkey % 50 AS INT) AS shard, o_orderkey % 4 + 2 AS peer, MAX(o_orderkey) AS matched FROM {orders} GROUP BY 1, 2"
LEADERS = """
SELECT CAST(o_custkey % 50 AS INT) AS shard, CAST(1 + FLOOR(MAX(o_orderkey) / 1000.0) AS BIGINT) AS term, MIN(o_orderkey) AS commit, MAX(o_orderkey) AS last_idx
FROM {orders} GROUP BY 1"""
ORDER_LOG = "SELECT CAST(o_custkey % 50 AS INT) AS shard, o_orderkey AS idx, CAST(1 + FLOOR(o_orderkey / 1000.0) AS BIGINT) AS term FROM {orders}"

#: Replicas' dense logs.
REPLICA_LOG = """
SELECT replica, idx, CAST(1 + FLOOR(idx / 10.0) AS BIGINT) AS term FROM (
  SELECT o_custkey % 20 AS replica, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS BIGINT) AS idx FROM {orders}) x"""
#: What a leader sends to them: even replicas get the middle of what they have, odd ones other terms from some index on, and more.
INCOMING = f"""
SELECT replica, idx, term + CASE WHEN replica % 2 = 1 AND idx > FLOOR(n / 2.0) + replica THEN 1 ELSE 0 END AS term
FROM (SELECT replica, idx, term, COUNT(*) OVER (PARTITION BY replica) AS n FROM ({REPLICA_LOG}) y) z WHERE idx > FLOOR(n / 4.0) AND (replica % 2 = 1 OR idx < FLOOR(n / 1.5))
UNION ALL SELECT replica, n + idx AS idx, term + n AS term FROM (SELECT replica, idx, term, COUNT(*) OVER (PARTITION BY replica) AS n FROM ({REPLICA_LOG}) y) z WHERE replica % 2 = 1 AND idx <= 5"""
HARD_STATE = f"SELECT replica, MAX(term) AS term, CAST(0 AS BIGINT) AS voted_for, MAX(idx) - replica % 3 + CASE WHEN replica = 7 THEN 5 ELSE 0 END AS last FROM ({REPLICA_LOG}) y GROUP BY replica"
APPENDS = f"SELECT replica, idx - 1 AS prev_idx, CASE WHEN idx = 1 THEN 0 WHEN idx % 7 = 0 THEN term + 1 ELSE CAST(1 + FLOOR((idx - 1) / 10.0) AS BIGINT) END AS prev_term FROM ({REPLICA_LOG}) y"

#: Messages by replica and arrival.
MESSAGES = """
SELECT user_id % 7 AS replica, event_id AS arrival, CAST(FLOOR(event_id / 60.0) AS BIGINT) + CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS term,
  CASE WHEN event_type = 'view' THEN 'APPEND' WHEN event_type = 'click' THEN 'APPEND_RESP' WHEN event_type = 'error' THEN 'VOTE' ELSE 'VOTE_RESP' END AS kind,
  CAST(FLOOR(event_id / 40.0) AS BIGINT) AS round, event_id AS seq, user_id % 10 + 1 AS to_id, CAST(event_id % 3 AS INT) AS shard
FROM {events}"""
STORED_TERMS = "SELECT DISTINCT user_id % 7 AS replica, CAST(3 AS BIGINT) AS term FROM {events}"
RESPONSES = """
SELECT CAST(o_custkey % 8 AS INT) AS shard, o_orderkey % 4 + 2 AS peer, o_orderkey AS arrival, o_orderstatus <> 'P' AS success, o_custkey AS idx
FROM {orders} WHERE NOT (o_custkey % 8 = 3 AND o_orderkey % 4 = 1)"""
STARTS = "SELECT DISTINCT CAST(o_custkey % 8 AS INT) AS shard, o_orderkey % 4 + 2 AS peer, CAST(5 AS BIGINT) AS matched, CAST(6 AS BIGINT) AS next_idx FROM {orders}"
#: What a leader sends: so many entries at a time, between the responses.
SENDS = """
SELECT CAST(o_custkey % 8 AS INT) AS shard, o_orderkey % 4 + 2 AS peer, o_orderkey + 0.5 AS arrival, o_custkey % 7 AS n FROM {orders} WHERE o_orderkey % 3 = 0"""
#: Vote requests by replica and arrival; terms go up slowly, and some are stale.
REQUESTS = """
SELECT o_custkey % 20 AS replica, o_orderkey AS arrival, CAST(FLOOR(o_orderkey / 200.0) AS BIGINT) + o_orderkey % 3 AS term, o_orderkey % 5 + 1 AS candidate,
  o_orderkey % 9 AS log_term, o_orderkey % 13 AS log_idx
FROM {orders}"""
VOTERS = """
SELECT DISTINCT o_custkey % 20 AS replica, CAST(2 AS BIGINT) AS term, o_custkey % 20 % 8 AS last_term, o_custkey % 20 % 11 AS last_idx, o_custkey % 20 % 4 AS voted_for FROM {orders}"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """An adapter's rows, its tables read from ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def duck(sql: str) -> str:
    """The same for DuckDB, whose tables have plain names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
