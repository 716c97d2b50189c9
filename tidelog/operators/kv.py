"""Key-value semantics of a command log.

A log has the columns shard, idx, term, op (GET, PUT, DELETE, or null for a no-op), key, value;
idx orders the commands of a shard. Duplicate commands are meaningful and never removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import shard_of_literal


def append(log: DataFrame, commands: DataFrame) -> DataFrame:
    """The log with further commands, which carry their own idx."""
    return log.unionByName(commands.select(log.columns))


def put(commands: DataFrame) -> DataFrame:
    """Log rows for (shard, idx, term, key, value): upserts, the last position wins."""
    return commands.select("shard", "idx", "term", F.lit("PUT").alias("op"), "key", "value")


def delete(commands: DataFrame) -> DataFrame:
    """Log rows for (shard, idx, term, key): removals, which also succeed on absent keys."""
    return commands.select("shard", "idx", "term", F.lit("DELETE").alias("op"), "key", F.lit(None).cast("string").alias("value"))


def _before(log: DataFrame) -> DataFrame:
    """The log with ``prior``, the last write on the same key before each row.

    The commands of one key are one window: Spark sorts them in one task, on the JVM, spilling to
    disk. A key with very many commands makes that task long, not wrong.
    """
    earlier = Window.partitionBy("shard", "key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("op").isin("PUT", "DELETE"), F.struct("op", "value"))
    return log.withColumn("prior", F.last(write, ignorenulls=True).over(earlier))


def get_as_of(log: DataFrame) -> DataFrame:
    """(shard, idx, key, value, found) for each GET: what it reads at its own position."""
    seen = _before(log).where(F.col("op") == "GET")
    found = F.coalesce(F.col("prior.op") == "PUT", F.lit(False))
    return seen.select("shard", "idx", "key", F.when(found, F.col("prior.value")).alias("value"), found.alias("found"))


def state(log: DataFrame, commit: int | None = None) -> DataFrame:
    """(shard, key, value, idx) of all live keys after the entries up to ``commit``, or after all.

    The last write decides before deleted keys are left out, or they would come back.
    """
    applied = log if commit is None else log.where(F.col("idx") <= commit)
    writes = applied.where(F.col("op").isin("PUT", "DELETE"))
    last = writes.groupBy("shard", "key").agg(F.max_by(F.struct("op", "value"), "idx").alias("w"), F.max("idx").alias("idx"))
    return last.where("w.op = 'PUT'").select("shard", "key", "w.value", "idx")


def state_at_commits(log: DataFrame, commits: DataFrame) -> DataFrame:
    """The state of each shard at its own commit index, from (shard, commit)."""
    return state(log.join(commits, "shard").where(F.col("idx") <= F.col("commit")).drop("commit"))


def replies(log: DataFrame) -> DataFrame:
    """(shard, idx, op, ok, value, leader) for each command; no-ops have none."""
    seen = _before(log).where(F.col("op").isNotNull())
    hit = (F.col("op") == "GET") & (F.col("prior.op") == "PUT")
    return seen.select("shard", "idx", "op", F.lit(True).alias("ok"), F.when(hit, F.col("prior.value")).alias("value"), F.lit("").alias("leader"))


def outcomes(answers: DataFrame) -> DataFrame:
    """What a client prints and exits with: an empty value is found, an absent one is not."""
    missing = (F.col("op") == "GET") & F.col("value").isNull()
    printed = F.when(~F.col("ok"), "unreachable").when(missing, "(not found)").when(F.col("op") == "GET", F.col("value")).otherwise("OK")
    code = F.when(~F.col("ok"), 2).when(missing, 1).otherwise(0)
    return answers.select("shard", "idx", "op", printed.alias("printed"), code.cast("int").alias("exit_code"))


def lookup(live: DataFrame, key: str, shards: int) -> DataFrame:
    """One key's row of a state; the shard literal lets a table partitioned by shard skip the others."""
    return live.where((F.col("shard") == shard_of_literal(key.encode(), shards)) & (F.col("key") == key))


def found(value: Column) -> Column:
    return value.isNotNull()
