"""Golden cases of placement and replication analytics."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import placement, raftlog


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def nodes(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}:1") for i in ids], "node_id bigint, addr string")


def test_six_nodes_in_threes(spark):
    six = nodes(spark, 4, 2, 6, 1, 3, 5)
    assert rows(placement.shard_count(six, 3)) == [(6, 2)]
    assert [r["shard"] for r in placement.placement(six, 3).orderBy("node_id").collect()] == [0, 0, 0, 1, 1, 1]
    assert rows(placement.own_shard(six, 3, 5)) == [(5, 1)]
    with pytest.raises(ValueError, match="groups of 4"):
        placement.validate(six, 4)


def test_of_repeated_node_ids_the_last_counts(spark):
    twice = spark.createDataFrame([(1, "old:1", 0), (1, "n1:1", 1), (2, "n2:1", 0), (3, "n3:1", 0), (4, "n4:1", 0), (4, "a4:1", 1)], "node_id bigint, addr string, seq int")
    assert rows(placement.placement(twice, 2), "node_id") == [(1, "n1:1", 0), (2, "n2:1", 0), (3, "n3:1", 1), (4, "a4:1", 1)]
    assert placement.validate(twice, 2) == 4 and placement.leader_address(spark.range(4, 5).toDF("leader"), twice).first()["leader_addr"] == "a4:1"
    assert placement.placement(nodes(spark, 1, 1, 2, 3, 4), 2).agg(F.max("shard")).first()[0] == 1


def test_routing_names_the_right_shards_nodes(spark):
    asked = spark.createDataFrame([(1, "foobar"), (4, "foobar"), (9, "foobar")], "node_id bigint, key string")
    got = {r["node_id"]: r for r in placement.route(asked, nodes(spark, 1, 2, 3, 4), 2, 2).collect()}
    right = got[1]["shard"]
    assert got[1]["ok"] == (right == 0) and got[4]["ok"] == (right == 1) and not got[9]["ok"]
    assert all(r["candidates"] == ("" if r["ok"] else ["n1:1,n2:1", "n3:1,n4:1"][right]) for r in got.values())


def test_addresses_are_parsed(spark):
    odd = spark.createDataFrame([(t,) for t in (" 5=h", "-5=h", "5 =h", "+=h", "=h", "5\n=h", "٥=h", "99999999999999999999=h")], "t string")
    assert [r[0] for r in odd.select(placement.parse_node(F.col("t"))["node_id"]).collect()] == [None] * 8
    assert spark.createDataFrame([("+007=h",)], "t string").select(placement.parse_node(F.col("t"))["node_id"]).first()[0] == 7
    df = spark.createDataFrame([("3=h:1",), ("x=h:1",), ("4",), ("5=a=b",), (None,)], "t string").select(placement.parse_node(F.col("t")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [(3, "h:1"), (None, "h:1"), (None, None), (5, "a=b"), (None, None)]


def test_reconcile_overwrites_from_the_first_conflict_and_keeps_matching_tails(spark):
    schema = "replica bigint, idx bigint, term bigint"
    old = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 1, 1)], schema)
    new = spark.createDataFrame([(1, 2, 2), (2, 1, 1), (2, 2, 1), (3, 2, 1)], schema)
    assert rows(raftlog.reconcile(old, new), "replica", "idx") == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 1, 1), (3, 2, 1)]


def commit(spark, term, own, last, matched, entries):
    leaders = spark.createDataFrame([(0, term, own, last)], "shard int, term bigint, commit bigint, last_idx bigint")
    progress = spark.createDataFrame([(0, i, m) for i, m in enumerate(matched)], "shard int, peer bigint, matched bigint")
    log = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(entries)], "shard int, idx bigint, term bigint")
    return raftlog.advance_commit(leaders, progress, log).first()["commit"]


def test_commit_needs_a_quorum_and_the_leaders_own_term(spark):
    assert commit(spark, 2, 0, 3, [], [2, 2, 2]) == 3  # a group of one
    assert commit(spark, 2, 1, 3, [0, 0], [2, 2, 2]) == 1  # cut off
    assert commit(spark, 2, 1, 3, [2, 0], [1, 2, 2]) == 2
    assert commit(spark, 3, 1, 2, [2, 2], [1, 2]) == 1  # an older term's entry


def test_batches_are_capped_but_hold_one_entry(spark):
    def entries(*kib):
        return spark.createDataFrame([(0, i + 1, 1, "PUT", "k", "v" * (k << 10)) for i, k in enumerate(kib)], "shard int, idx bigint, term bigint, op string, key string, value string")

    peer = spark.createDataFrame([(0, 1, 1)], "shard int, peer bigint, next_idx bigint")
    assert raftlog.next_batch(entries(2048, 1), peer).count() == 1
    assert raftlog.next_batch(entries(*[300] * 10), peer).count() == 3
    assert raftlog.next_batch(entries(*[0] * 300), peer).count() == 256
    assert [r["batch"] for r in raftlog.batches(entries(2048, 300, 300, 300, 300, 1)).orderBy("idx").collect()] == [1, 2, 2, 2, 3, 3]


def test_batches_of_whole_logs_are_those_of_a_plain_walk(spark):
    rng = random.Random(2)
    lengths = {shard: [rng.choice((1, 5, 40, 90, 300)) for _ in range(n)] for shard, n in ((0, 1500), (1, 64), (2, 1), (3, 700))}
    log = spark.createDataFrame([(s, 11 + i, 1, "PUT", "k", "v" * n) for s, own in lengths.items() for i, n in enumerate(own)], "shard int, idx bigint, term bigint, op string, key string, value string")
    sizes = {(r["shard"], r["idx"]): r["bytes"] for r in raftlog.sized(log).collect()}
    want = {}
    for s, own in lengths.items():
        batch, count, size = 0, 99, 0
        for i in range(11, 11 + len(own)):
            if count == 9 or size + sizes[s, i] > 400 or not batch:
                batch, count, size = batch + 1, 0, 0
            count, size = count + 1, size + sizes[s, i]
            want[s, i] = batch
    for chunk in (16, 64, 1 << 16):
        got = raftlog.batches(log.repartition(7), max_entries=9, max_bytes=400, chunk=chunk)
        assert {(r["shard"], r["idx"]): r["batch"] for r in got.collect()} == want
    assert raftlog.batches(log.limit(0)).count() == 0


def test_only_what_a_leader_is_offered_gets_an_index(spark):
    arrivals = spark.createDataFrame([(0, 5, True), (0, 6, False), (0, 7, True), (1, 1, False)], "shard bigint, arrival bigint, leading boolean")
    last = spark.createDataFrame([(0, 10)], "shard bigint, last_idx bigint")
    assert rows(raftlog.propose(arrivals, last), "shard", "arrival") == [(0, 5, True, 11), (0, 6, False, None), (0, 7, True, 12), (1, 1, False, None)]


def test_a_vote_binds_for_its_term(spark):
    rng = random.Random(6)
    own = {r: (rng.randrange(3), rng.randrange(3), rng.randrange(3), rng.randrange(4)) for r in range(6)}
    asked, term = [], 0
    for arrival in range(400):
        term += rng.random() < 0.05
        asked.append((rng.randrange(6), arrival, max(0, term + rng.choice((-1, 0, 0, 0, 1))), rng.randrange(1, 4), rng.randrange(4), rng.randrange(4)))
    want, now = [], {r: [t, v] for r, (t, _, _, v) in own.items()}
    for replica, arrival, t, candidate, log_term, log_idx in asked:
        state = now[replica]
        if t > state[0]:
            state[:] = [t, 0]
        granted = t == state[0] and (log_term, log_idx) >= own[replica][1:3] and state[1] in (0, candidate)
        if granted:
            state[1] = candidate
        want.append((arrival, granted))
    requests = spark.createDataFrame(asked, "replica bigint, arrival bigint, term bigint, candidate bigint, log_term bigint, log_idx bigint")
    voters = spark.createDataFrame([(r, *x) for r, x in own.items()], "replica bigint, term bigint, last_term bigint, last_idx bigint, voted_for bigint")
    got = raftlog.vote_grants(requests, voters).select("arrival", "granted")
    assert rows(got, "arrival") == want and {g for _, g in want} == {True, False}


def test_progress_is_that_of_a_plain_walk(spark):
    rng = random.Random(9)
    start = {(0, p): (rng.randrange(5), rng.randrange(1, 20)) for p in range(2, 12)}
    events = [(0, rng.randrange(2, 12), a, rng.choice(("ack", "ack", "sent", "sent", "sent", "failed") if a < 300 else ("ack", "sent")), rng.randrange(1, 30)) for a in range(400)]
    matched, following = ({k: v[i] for k, v in start.items()} for i in (0, 1))
    for shard, peer, _, kind, n in events:
        k = shard, peer
        if kind == "ack":
            matched[k], following[k] = max(matched[k], n), max(following[k], n + 1)
        else:
            following[k] = n + 1 if kind == "failed" else following[k] + n
    responses = spark.createDataFrame([(s, p, a, kind == "ack", n) for s, p, a, kind, n in events if kind != "sent"], "shard int, peer bigint, arrival bigint, success boolean, idx bigint")
    sends = spark.createDataFrame([(s, p, a, n) for s, p, a, kind, n in events if kind == "sent"], "shard int, peer bigint, arrival bigint, n bigint")
    begun = spark.createDataFrame([(*k, *v) for k, v in start.items()], "shard int, peer bigint, matched bigint, next_idx bigint")
    got = rows(raftlog.progress_after(responses, begun, sends), "peer")
    assert got == [(0, p, matched[0, p], following[0, p]) for p in range(2, 12)]


def test_replicas_start_as_followers_without_a_commit(spark):
    log = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2)], "replica bigint, idx bigint, term bigint")
    hard = spark.createDataFrame([(1, 4, 9, 2), (2, 3, 0, 0)], "replica bigint, term bigint, voted_for bigint, last bigint")
    assert rows(raftlog.started(log, hard), "replica") == [(1, "follower", 4, 9, 0, 2, 2, 0), (2, "follower", 3, 0, 0, 0, 0, 0)]


def test_failures_reset_progress_and_later_successes_raise_it(spark):
    responses = spark.createDataFrame([(0, 2, 1, True, 9), (0, 2, 2, False, 3), (0, 2, 3, True, 5), (0, 3, 1, False, 1)], "shard int, peer bigint, arrival bigint, success boolean, idx bigint")
    start = spark.createDataFrame([(0, 2, 0, 1), (0, 3, 0, 7), (0, 4, 2, 8)], "shard int, peer bigint, matched bigint, next_idx bigint")
    assert rows(raftlog.progress_after(responses, start), "peer") == [(0, 2, 9, 6), (0, 3, 0, 2), (0, 4, 2, 8)]


def test_votes_terms_and_matching(spark):
    votes = spark.createDataFrame([(0, 1, 1, v, g) for v, g in ((1, True), (1, True), (2, True), (3, False))], "shard int, term bigint, candidate bigint, voter bigint, granted boolean")
    assert rows(raftlog.elections(votes, 3)) == [(0, 1, 1, 2, True)]
    assert rows(raftlog.elections(votes, 5)) == [(0, 1, 1, 2, False)]
    log = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "replica bigint, idx bigint, term bigint")
    appends = spark.createDataFrame([(1, 0, 0), (1, 2, 2), (1, 2, 1), (1, 9, 2)], "replica bigint, prev_idx bigint, prev_term bigint")
    assert rows(raftlog.log_match(appends, log), "prev_idx", "prev_term") == [(1, 0, 0, True, None), (1, 2, 1, False, 1), (1, 2, 2, True, None), (1, 9, 2, False, 2)]
    hard = spark.createDataFrame([(1, 1), (2, 1)], "replica bigint, last bigint")
    assert rows(raftlog.live_entries(log, hard)) == [(1, 1, 1)]
    assert rows(raftlog.recovery(log, hard), "replica") == [(1, 1, 1, True, 0), (2, 1, 0, False, 0)]


def test_an_overwritten_waiter_is_told_so(spark):
    pending = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1)], "shard int, idx bigint, term bigint")
    log = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "shard int, idx bigint, term bigint")
    assert rows(raftlog.waiters(pending, log), "idx") == [(0, 1, 1, True, ""), (0, 2, 1, False, "")]
