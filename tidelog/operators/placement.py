"""Placement of shards on nodes, and routing.

Nodes are (node_id, addr), a small fixed table. Where an id stands in several rows the last one
counts, by the column ``seq`` if there is one, else by the address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import shard_of

#: A placement is known to the driver; beyond so many nodes it is joined rather than broadcast.
BROADCAST_NODES = 100_000


def validate(nodes: DataFrame, rf: int) -> int:
    """The number of nodes; raises unless ``rf`` is positive and divides it."""
    n = nodes.select("node_id").distinct().count()
    if rf < 1 or n == 0 or n % rf:
        raise ValueError(f"{n} nodes can't be dealt into groups of {rf}")
    return n


def shard_count(nodes: DataFrame, rf: int) -> DataFrame:
    """(nodes, shards)."""
    return nodes.agg(F.countDistinct("node_id").alias("nodes")).select("nodes", F.expr(f"nodes div {int(rf)}").cast("bigint").alias("shards"))


def last_of_each(nodes: DataFrame) -> DataFrame:
    """(node_id, addr), one row for each id."""
    return nodes.groupBy("node_id").agg(F.max_by("addr", F.struct("seq", "addr") if "seq" in nodes.columns else F.col("addr")).alias("addr"))


def placement(nodes: DataFrame, rf: int) -> DataFrame:
    """(node_id, addr, shard): runs of ``rf`` different ids in ascending order share a shard.

    The window has one partition, which a node list never makes large.
    """
    rank = F.row_number().over(Window.orderBy("node_id")) - 1
    return last_of_each(nodes).select("node_id", "addr", F.floor(rank / F.lit(rf)).cast("int").alias("shard"))


def replicas(nodes: DataFrame, rf: int, shard: int) -> DataFrame:
    return placement(nodes, rf).where(F.col("shard") == shard)


def own_shard(nodes: DataFrame, rf: int, node_id: int) -> DataFrame:
    return placement(nodes, rf).where(F.col("node_id") == node_id).select("node_id", "shard")


def assign(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """The rows with the shard of their key."""
    return rows.withColumn("shard", shard_of(F.col(key), shards))


def route(commands: DataFrame, nodes: DataFrame, rf: int, shards: int) -> DataFrame:
    """Commands (node_id asked, key) with the key's shard, whether it is served here, and who may serve it."""
    placed = placement(nodes, rf)
    small = F.broadcast if validate(nodes, rf) <= BROADCAST_NODES else (lambda df: df)
    homes = placed.groupBy("shard").agg(F.array_join(F.sort_array(F.collect_set("addr")), ",").alias("candidates"))
    asked = assign(commands, "key", shards).join(small(placed.select("node_id", F.col("shard").alias("own"))), "node_id", "left")
    wrong = ~F.col("shard").eqNullSafe(F.col("own"))
    return asked.join(small(homes), "shard", "left").select(*commands.columns, "shard", (~wrong).alias("ok"), F.when(wrong, F.col("candidates")).otherwise("").alias("candidates"))


def leader_address(status: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where a follower sends clients: (…, leader_addr), empty if the leader is unknown."""
    named = last_of_each(nodes).select(F.col("node_id").alias("leader"), F.col("addr").alias("leader_addr"))
    return status.join(named, "leader", "left").withColumn("leader_addr", F.coalesce("leader_addr", F.lit("")))


def parse_node(text: Column) -> Column:
    """struct<node_id, addr> of "id=host:port": split at the first "="; an id that isn't digits, after a plus at most, is null, as is one of 2 ** 63 or more."""
    at = F.instr(text, "=")
    has = at > 0
    number = F.substring(text, F.lit(1), at - 1)
    return F.struct(
        F.when(has & number.rlike(r"^\+?[0-9]+\z"), number.try_cast("bigint")).alias("node_id"),
        F.when(has, F.substring(text, at + 1, F.length(text))).alias("addr"),
    )
