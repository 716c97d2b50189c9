"""Golden cases of the key-value semantics."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import kv

LOG = "shard int, idx bigint, term bigint, op string, key string, value string"


def log(spark, *commands):
    return spark.createDataFrame([(0, i + 1, 1, *c) for i, c in enumerate(commands)], LOG)


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


def put(k, v):
    return ("PUT", k, v)


def test_overwrite_and_empty_value(spark):
    assert as_dict(kv.state(log(spark, put("a", "1"), put("a", "2"), put("b", "")))) == {"a": "2", "b": ""}


def test_delete_removes_and_absent_keys_may_be_deleted(spark):
    rows = log(spark, put("a", "1"), put("b", ""), ("DELETE", "a", None), ("DELETE", "missing", None), ("GET", "a", None), ("GET", "b", None), ("GET", "missing", None))
    assert as_dict(kv.state(rows)) == {"b": ""}
    assert [(r["key"], r["value"], r["found"]) for r in kv.get_as_of(rows).orderBy("idx").collect()] == [("a", None, False), ("b", "", True), ("missing", None, False)]


def test_a_get_reads_strictly_before_itself(spark):
    rows = log(spark, ("GET", "a", None), put("a", "1"), ("GET", "a", None), put("a", "2"), ("DELETE", "a", None), ("GET", "a", None), put("a", "3"))
    assert [r["value"] for r in kv.get_as_of(rows).orderBy("idx").collect()] == [None, "1", None]


def test_a_retry_after_another_write_counts(spark):
    assert as_dict(kv.state(log(spark, put("a", "1"), put("a", "2"), put("a", "1")))) == {"a": "1"}


def test_replay_is_idempotent_and_state_is_a_prefix_function(spark):
    rows = log(spark, put("a", "1"), ("DELETE", "a", None), put("a", "2"), (None, None, None))
    twice = rows.unionByName(rows.withColumn("idx", F.col("idx") + 10))
    assert as_dict(kv.state(rows)) == as_dict(kv.state(twice)) == {"a": "2"}
    assert [as_dict(kv.state(rows, c)) for c in (0, 1, 2, 3, 4)] == [{}, {"a": "1"}, {}, {"a": "2"}, {"a": "2"}]


def test_replies_and_outcomes(spark):
    rows = log(spark, put("a", ""), ("GET", "a", None), ("GET", "b", None), ("DELETE", "b", None), (None, None, None))
    replies = kv.replies(rows)
    assert [(r["op"], r["ok"], r["value"]) for r in replies.orderBy("idx").collect()] == [("PUT", True, None), ("GET", True, ""), ("GET", True, None), ("DELETE", True, None)]
    assert [(r["printed"], r["exit_code"]) for r in kv.outcomes(replies).orderBy("idx").collect()] == [("OK", 0), ("", 0), ("(not found)", 1), ("OK", 0)]


def test_shards_have_their_own_order_and_empty_logs_work(spark):
    rows = spark.createDataFrame([(0, 1, 1, "PUT", "a", "x"), (1, 1, 1, "PUT", "a", "y"), (1, 2, 1, "DELETE", "a", None)], LOG)
    assert [(r["shard"], r["value"]) for r in kv.state(rows).collect()] == [(0, "x")]
    assert kv.state(rows.limit(0)).count() == kv.get_as_of(rows.limit(0)).count() == kv.replies(rows.limit(0)).count() == 0


def test_the_window_shuffles_once(spark):
    plan = kv.get_as_of(log(spark, put("a", "1")).repartition(3, "idx"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(shard") == 1
    assert "Python" not in plan


def test_a_stream_refuses_a_smaller_index(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tidelog.streaming.apply import answers

    rows = log(spark, put("a", "1"), ("GET", "a", None))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    segments = str(tmp_path / "log")

    def run(part):
        part.write.mode("append").parquet(segments)
        stream = answers(spark.readStream.schema(rows.schema).parquet(segments))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    run(rows.where("idx = 2"))
    with pytest.raises(StreamingQueryException, match="came after"):
        run(rows.where("idx = 1"))
