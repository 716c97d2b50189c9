"""Audit analytics of replication: elections, log matching, commits, batches, recovery.

All operators take and return plain tables. A log here is (shard or replica, idx, term, ...).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.functions.records import entry_length
from tidelog.plans.shipping import map_batches, shared_path

# What one append message may hold.
MAX_ENTRIES, MAX_BYTES = 256, 1 << 20
#: Entries that one task puts into batches at a time.
CHUNK = 1 << 16


def quorum(voters: Column) -> Column:
    """The smallest majority."""
    return F.floor(voters / F.lit(2)).cast("bigint") + 1


def propose(arrivals: DataFrame, last: DataFrame) -> DataFrame:
    """Arrivals (shard, arrival, leading, …) with the next dense indexes after each shard's (shard, last_idx).

    Only what arrives while its node leads gets an index. A shard's arrivals are one window, as
    its log is one sequence; Spark sorts them in one task, spilling to disk.
    """
    nth = F.sum(F.col("leading").cast("bigint")).over(Window.partitionBy("shard").orderBy("arrival"))
    numbered = arrivals.withColumn("nth", nth).join(last, "shard", "left")
    idx = F.when(F.col("leading"), F.coalesce("last_idx", F.lit(0)) + F.col("nth"))
    return numbered.select(*arrivals.columns, idx.cast("bigint").alias("idx"))


def by_term(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages (replica, arrival, term, kind) with seen_term, the replica's term on arrival, and what becomes of them.

    Older terms are dropped, but an old APPEND is refused, with the current term in the answer.
    A replica's own campaigns are to be among the messages, as they raise its term too. What a
    replica is sent is one window, sorted by Spark in one task, spilling to disk.
    """
    earlier = Window.partitionBy("replica").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    known = messages.join(stored.withColumnRenamed("term", "stored_term"), "replica", "left")
    seen = F.greatest(F.coalesce("stored_term", F.lit(0)), F.coalesce(F.max("term").over(earlier), F.lit(0))).cast("bigint")
    known = known.withColumn("seen_term", seen)
    old = F.col("term") < F.col("seen_term")
    outcome = F.when(old & (F.col("kind") == "APPEND"), "refused").when(old, "dropped").when(F.col("term") > F.col("seen_term"), "adopted").otherwise("handled")
    return known.select(*messages.columns, "seen_term", outcome.alias("outcome"))


def vote_grants(requests: DataFrame, replicas: DataFrame) -> DataFrame:
    """Requests (replica, arrival, term, candidate, log_term, log_idx) with granted, for replicas (replica, term, last_term, last_idx, voted_for).

    A request of an older term than the replica has seen is dropped; a newer term frees its vote.
    The candidate's log must be as new as the voter's, and a vote once given binds the voter for
    the rest of the term: the stored one in the stored term, else that of the first request
    granted. Requests of one replica are one window.
    """
    known = requests.join(replicas.withColumnRenamed("term", "stored_term"), "replica")
    earlier = Window.partitionBy("replica").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.col("stored_term"), F.coalesce(F.max("term").over(earlier), F.lit(0)))
    known = known.withColumn("live", F.col("term") >= seen)
    fresh = F.struct("log_term", "log_idx") >= F.struct(F.col("last_term").alias("log_term"), F.col("last_idx").alias("log_idx"))
    known = known.withColumn("able", F.col("live") & fresh)
    stored = F.when((F.col("term") == F.col("stored_term")) & (F.col("voted_for") != 0), F.col("voted_for"))
    first = F.min(F.when(F.col("able"), F.struct("arrival", "candidate"))).over(Window.partitionBy("replica", "term"))
    granted = F.col("able") & (F.col("candidate") == F.coalesce(stored, first["candidate"]))
    return known.withColumn("granted", granted).select(*requests.columns, "granted")


def elections(votes: DataFrame, voters: int) -> DataFrame:
    """(shard, term, candidate, grants, won): different granting voters of each candidacy against the quorum."""
    grants = votes.where("granted").groupBy("shard", "term", "candidate").agg(F.countDistinct("voter").alias("grants"))
    return grants.withColumn("won", F.col("grants") >= voters // 2 + 1)


def log_match(appends: DataFrame, log: DataFrame) -> DataFrame:
    """Appends (replica, prev_idx, prev_term) with matches and, where not, hint: the index to go back to.

    Index 0 is the beginning of every log, with term 0.
    """
    last = log.groupBy("replica").agg(F.max("idx").alias("last_idx"))
    own = log.select("replica", F.col("idx").alias("prev_idx"), F.col("term").alias("own_term"))
    seen = appends.join(own, ["replica", "prev_idx"], "left").join(last, "replica", "left")
    own_term = F.when(F.col("prev_idx") == 0, F.lit(0)).otherwise(F.col("own_term"))
    good = F.coalesce(own_term == F.col("prev_term"), F.lit(False))
    hint = F.least(F.coalesce("last_idx", F.lit(0)), F.col("prev_idx") - 1)
    return seen.select(*appends.columns, good.alias("matches"), F.when(~good, hint).cast("bigint").alias("hint"))


def reconcile(follower: DataFrame, incoming: DataFrame) -> DataFrame:
    """The followers' logs (replica, idx, term) after the incoming entries that match up to their beginning.

    The first entry of another term replaces the log from there on; without one nothing is cut,
    so a longer log keeps its tail.
    """
    theirs = incoming.withColumnRenamed("term", "new_term")
    differing = follower.join(theirs, ["replica", "idx"]).where(F.col("term") != F.col("new_term"))
    conflict = differing.groupBy("replica").agg(F.min("idx").alias("conflict"))
    kept = follower.join(conflict, "replica", "left").where(F.col("conflict").isNull() | (F.col("idx") < F.col("conflict"))).drop("conflict")
    added = incoming.join(kept.select("replica", "idx"), ["replica", "idx"], "left_anti")
    return kept.select("replica", "idx", "term").unionByName(added.select("replica", "idx", "term"))


def sized(entries: DataFrame) -> DataFrame:
    """Entries (…, term, op, key, value) with bytes, their length as messages."""
    return entries.withColumn("bytes", entry_length(F.col("term"), F.col("op"), F.col("key"), F.col("value")))


def next_batch(entries: DataFrame, progress: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(shard, peer, idx, bytes): what each peer (shard, peer, next_idx) is sent next, one entry at least.

    A log's indexes are dense, so no peer is joined with more than ``max_entries`` rows.
    """
    ahead = sized(entries).join(progress, "shard").where((F.col("idx") >= F.col("next_idx")) & (F.col("idx") < F.col("next_idx") + max_entries))
    order = Window.partitionBy("shard", "peer").orderBy("idx")
    ahead = ahead.withColumns({"nth": F.row_number().over(order), "so_far": F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ahead.where((F.col("nth") == 1) | ((F.col("nth") <= max_entries) & (F.col("so_far") <= max_bytes))).select("shard", "peer", "idx", "bytes")


def batches(entries: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(shard, idx, batch): whole logs, of dense indexes, dealt greedily into successive append messages, from 1.

    Where a batch begins depends on all before it, but only through where the last one ended. So
    a log is dealt out in chunks of ``chunk`` entries, each with the first entries of the next
    one. A task tells for each place where a batch may first begin in its chunk how many begin
    there in all, and at which place of the next chunk the next one does. These steps are followed
    from each log's beginning by doubling their length; then every chunk is numbered by itself.
    """
    spark = entries.sparkSession
    rows = sized(entries).select(F.col("shard").cast("bigint").alias("shard"), F.col("idx").cast("bigint").alias("idx"), "bytes")
    firsts = rows.groupBy("shard").agg(F.min("idx").alias("first"))
    place = F.col("idx") - F.col("first")
    rows = rows.join(firsts, "shard").select("shard", F.expr(f"(idx - first) div {chunk}").alias("chunk"), (place % chunk).alias("place"), "idx", "bytes")
    rows = _written(spark, rows, "entries")
    more = rows.where((F.col("chunk") > 0) & (F.col("place") < max_entries)).select("shard", F.col("chunk") - 1, F.col("place") + chunk, "idx", "bytes")
    dealt = rows.union(more).select("shard", "chunk", "place", "bytes").repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "place")
    steps = _written(spark, map_batches(dealt, _steps(max_entries, max_bytes, chunk), STEPS), "steps")
    begun = rows.where("chunk = 0 AND place = 0").select("shard", "chunk", "place", F.lit(0).cast("bigint").alias("batches"))
    begun, chunks, length = _written(spark, begun, "begun"), (rows.agg(F.max("chunk")).first()[0] or 0) + 1, 1
    while length < chunks:
        onward = begun.join(steps, ["shard", "chunk", "place"]).select("shard", (F.col("chunk") + length).alias("chunk"), F.col("next").alias("place"), (F.col("batches") + F.col("n")).alias("batches"))
        begun = _written(spark, begun.union(onward), "begun")
        further = steps.select("shard", (F.col("chunk") - length).alias("chunk"), F.col("place").alias("next"), F.col("next").alias("beyond"), F.col("n").alias("more"))
        joined = steps.join(further, ["shard", "chunk", "next"]).select("shard", "chunk", "place", F.col("beyond").alias("next"), (F.col("n") + F.col("more")).alias("n"))
        steps, length = _written(spark, joined, "steps"), 2 * length
    known = rows.join(begun.withColumnRenamed("place", "begins"), ["shard", "chunk"]).select("shard", "chunk", "place", "idx", "bytes", "begins", "batches")
    known = known.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "place")
    return map_batches(known, _numbered(max_entries, max_bytes), NUMBERED)


STEPS = StructType([StructField(c, LongType()) for c in ("shard", "chunk", "place", "next", "n")])
NUMBERED = StructType([StructField(c, LongType()) for c in ("shard", "idx", "batch")])


def _written(spark: SparkSession, rows: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again, so that no later round works them out anew."""
    at = shared_path(spark, what)
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def _steps(max_entries: int, max_bytes: int, chunk: int):
    """Rows STEPS of entries (shard, chunk, place, bytes) in order: from each place a batch may first begin at, on to the next chunk."""

    def of(shard: int, number: int, size: np.ndarray) -> pa.RecordBatch:
        own = min(len(size), chunk)
        total = np.concatenate(([0], np.cumsum(size)))
        reach = np.searchsorted(total, total[:own] + max_bytes, "right") - 1
        nexts = np.minimum(np.maximum(reach, np.arange(own) + 1), np.arange(own) + max_entries).tolist()
        out, n = [0] * own, [1] * own
        for i in range(own - 1, -1, -1):
            k = nexts[i]
            out[i], n[i] = (out[k], n[k] + 1) if k < own else (k - chunk, 1)
        places = min(own, max_entries)
        columns = [[shard] * places, [number] * places, range(places), out[:places], n[:places]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=STEPS.names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for part in parts:
            shard, number, size = (part.column(i).to_numpy() for i in (0, 1, 3))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (number[1:] != number[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(size)], strict=True):
                if a == b:
                    continue
                name = int(shard[a]), int(number[a])
                if held and name != current:
                    yield of(*current, np.concatenate(held))
                    held = []
                current = name
                held.append(size[a:b])
        if held:
            yield of(*current, np.concatenate(held))

    return run


def _numbered(max_entries: int, max_bytes: int):
    """Rows NUMBERED of entries (shard, chunk, place, idx, bytes, begins, batches) in order; ``begins`` is where the first new batch of a chunk does."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count, size = 0, 0, 0
        for part in parts:
            out = []
            for place, length, begins, before in zip(*(part.column(i).to_pylist() for i in (2, 4, 5, 6)), strict=True):
                if place < begins:
                    out.append(before)
                    continue
                if place == begins:
                    number, count, size = before + 1, 0, 0
                elif count == max_entries or size + length > max_bytes:
                    number, count, size = number + 1, 0, 0
                count, size = count + 1, size + length
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(out, pa.int64())], names=NUMBERED.names)

    return run


def follower_commit(commit: Column, leader_commit: Column, last_new: Column) -> Column:
    """A follower's commit after an append: the leader's, but not past what it was sent, and never less than before."""
    return F.greatest(commit, F.least(leader_commit, last_new))


def append_ack(prev_idx: Column, entries: Column) -> Column:
    """The index that a successful append acknowledges."""
    return prev_idx + F.size(entries)


def progress_after(responses: DataFrame, start: DataFrame, sends: DataFrame | None = None) -> DataFrame:
    """(shard, peer, matched, next_idx) after responses (shard, peer, arrival, success, idx) and sends (shard, peer, arrival, n).

    idx is what a success acknowledges, or a failure's hint; n is how many entries were sent.
    Arrivals order both kinds. A failure sets next_idx back to the hint + 1, a send moves it on by
    n, a success raises it to idx + 1. So only the last failure and what follows it count, and a
    success is worth idx + 1 and all that is sent after it.
    """
    keys, zero = ["shard", "peer"], F.lit(0).cast("bigint")
    events = responses.select(*keys, F.col("arrival").cast("double").alias("arrival"), "success", "idx", zero.alias("n"))
    if sends is not None:
        sent = sends.select(*keys, F.col("arrival").cast("double").alias("arrival"), F.lit(None).cast("boolean").alias("success"), zero.alias("idx"), "n")
        events = events.unionByName(sent)
    failed = responses.where(~F.col("success")).groupBy(keys).agg(F.max(F.col("arrival").cast("double")).alias("failed_at"), F.max_by("idx", "arrival").alias("hint"))
    known = events.join(failed.select(*keys, "failed_at"), keys, "left")
    since = F.col("failed_at").isNull() | (F.col("arrival") > F.col("failed_at"))
    known = known.withColumn("n", F.when(since, F.col("n")).otherwise(0))
    known = known.withColumn("so_far", F.sum("n").over(Window.partitionBy(*keys).orderBy("arrival")))
    acked = known.groupBy(keys).agg(
        F.max(F.when(F.col("success"), F.col("idx"))).alias("acked"), F.max(F.when(F.col("success") & since, F.col("idx") + 1 - F.col("so_far"))).alias("raised"), F.sum("n").alias("sent")
    )
    every = start.join(failed, keys, "left").join(acked, keys, "left")
    following = F.greatest(F.coalesce(F.col("hint") + 1, F.col("next_idx")), F.col("raised")) + F.coalesce("sent", F.lit(0))
    return every.select(*keys, F.greatest("matched", "acked").cast("bigint").alias("matched"), following.cast("bigint").alias("next_idx"))


def advance_commit(leaders: DataFrame, progress: DataFrame, log: DataFrame) -> DataFrame:
    """(shard, commit): leaders' (shard, term, commit, last_idx) commit after (shard, peer, matched).

    The quorum-th highest of all replicas' indexes commits, if it is new and its entry is of the
    leader's own term.
    """
    marks = progress.select("shard", "matched").unionByName(leaders.select("shard", F.col("last_idx").alias("matched")))
    agreed = marks.groupBy("shard").agg(F.sort_array(F.collect_list("matched"), asc=False).alias("m"))
    agreed = agreed.select("shard", F.get("m", quorum(F.size("m")).cast("int") - 1).alias("idx"))
    known = leaders.join(agreed, "shard").join(log.select("shard", "idx", F.col("term").alias("entry_term")), ["shard", "idx"], "left")
    good = (F.col("idx") > F.col("commit")) & F.coalesce(F.col("entry_term") == F.col("term"), F.lit(False))
    return known.select("shard", F.when(good, F.col("idx")).otherwise(F.col("commit")).cast("bigint").alias("commit"))


def last_entries(log: DataFrame) -> DataFrame:
    """(replica, last_idx, last_term)."""
    last = log.groupBy("replica").agg(F.max_by(F.struct("idx", "term"), "idx").alias("l"))
    return last.select("replica", F.col("l.idx").alias("last_idx"), F.col("l.term").alias("last_term"))


def started(log: DataFrame, hard_state: DataFrame) -> DataFrame:
    """The status of replicas (replica, term, voted_for, last) when they start: followers of nobody that know their log, and no commit even after a restart."""
    last = last_entries(live_entries(log, hard_state))
    known = hard_state.select("replica", "term", "voted_for").join(last, "replica", "left")
    number = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return known.select("replica", F.lit("follower").alias("role"), "term", "voted_for", F.lit(0).cast("bigint").alias("leader"), number("last_idx").alias("last_idx"), number("last_term").alias("last_term"), F.lit(0).cast("bigint").alias("commit"))


def live_entries(log: DataFrame, hard_state: DataFrame) -> DataFrame:
    """The entries up to each replica's stored last index; what stands after it is dead."""
    return log.join(hard_state.select("replica", "last"), "replica").where(F.col("idx") <= F.col("last")).select(log.columns)


def recovery(log: DataFrame, hard_state: DataFrame) -> DataFrame:
    """(replica, last, entries, complete, commit): whether all of 1 to last is there; commit restarts at 0."""
    found = live_entries(log, hard_state).groupBy("replica").agg(F.countDistinct("idx").alias("entries"))
    known = hard_state.select("replica", "last").join(found, "replica", "left")
    entries = F.coalesce("entries", F.lit(0))
    return known.select("replica", "last", entries.cast("bigint").alias("entries"), (entries == F.col("last")).alias("complete"), F.lit(0).cast("bigint").alias("commit"))


def waiters(pending: DataFrame, log: DataFrame) -> DataFrame:
    """Waiting clients (shard, idx, term) with ok: whether the entry applied there is the one they proposed."""
    applied = log.select("shard", "idx", F.col("term").alias("entry_term"))
    return pending.join(applied, ["shard", "idx"]).select("shard", "idx", "term", (F.col("term") == F.col("entry_term")).alias("ok"), F.lit("").alias("leader"))


def coalesced(messages: DataFrame) -> DataFrame:
    """(round, to_id, n, kinds): each round's messages to a peer in one batch, in their order.

    A batch is what one peer is sent in one round trip, so the arrays are as bounded as its queue.
    """
    grouped = messages.groupBy("round", "to_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind"))).alias("m"))
    return grouped.select("round", "to_id", F.size("m").cast("bigint").alias("n"), F.array_join(F.transform("m", lambda x: x["kind"]), ",").alias("kinds"))


def for_shard(messages: DataFrame, own: DataFrame) -> DataFrame:
    """The messages whose shard is that of the node (node_id, own_shard) they are for."""
    return messages.join(own, messages["to_id"] == own["node_id"]).where(F.col("shard") == F.col("own_shard")).select(messages.columns)
