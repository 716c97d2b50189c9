"""Incremental apply: a command log as a stream, the last write of each key as keyed state.

Within a micro-batch a key's commands are put in the order of idx; across batches the source has
to deliver them so. Each key remembers the last idx it saw, also of reads and also after a
delete, and a smaller or repeated one fails the query rather than answer wrongly.

Keys are dealt out to ``buckets`` groups a shard, which is how many tasks a shard's commands can
go to. A group's commands of one micro-batch are answered together, as columns; its keys' last
writes are a map in the state store, of which only those are read that the commands name. So the
micro-batch's size, which the source's options bound, bounds what a task holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidelog.plans.shipping import ship

BUCKETS = 64
KEY = StructType([StructField("key", StringType())])
LAST = StructType([StructField("idx", LongType()), StructField("present", BooleanType()), StructField("value", StringType())])
ANSWERS = StructType([
    StructField("shard", IntegerType()), StructField("idx", LongType()), StructField("op", StringType()), StructField("key", StringType()),
    StructField("value", StringType()), StructField("found", BooleanType()),
])


class Apply(StatefulProcessor):
    """Answers the commands of one group of keys."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", KEY, LAST)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values(["key", "idx"])
        names, idx, op, values = (part[c].to_numpy() for c in ("key", "idx", "op", "value"))
        op, values, place = op.astype(object), values.astype(object), np.arange(len(part))
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        of = np.searchsorted(first, place, side="right") - 1
        known = [self.last.getValue((n,)) or (0, False, None) for n in names[first]]
        before = np.concatenate(([0], idx[:-1]))
        before[first] = [k[0] for k in known]
        late = np.flatnonzero(idx <= before)
        if len(late):
            i = late[0]
            raise ValueError(f"shard {key[0]}, key {names[i]!r}: index {idx[i]} came after {before[i]} or stands twice")
        # For each command its key's last write up to it and before it; below the key's first command it is the state's.
        reads = op == "GET"
        upto = np.maximum(np.maximum.accumulate(np.where(reads, -1, place)), -1)
        prior = np.concatenate(([-1], upto[:-1]))
        put, held = np.concatenate((op == "PUT", [k[1] for k in known])).astype(bool), np.concatenate((values, np.array([k[2] for k in known], object)))
        source = lambda at: np.where(at >= first[of], at, len(part) + of)
        prior, upto = source(prior), source(upto)
        found = reads & put[prior]
        yield pd.DataFrame({"shard": key[0], "idx": idx, "op": op, "key": names, "value": np.where(found, held[prior], None), "found": found})
        last = np.append(first[1:], len(part)) - 1
        for n, i, at in zip(names[last], idx[last].tolist(), upto[last].tolist(), strict=True):
            self.last.updateValue((n,), (i, bool(put[at]), held[at] if put[at] else None))

    def close(self) -> None:
        pass


def answers(log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The answers (shard, idx, op, key, value, found) to a stream of commands; needs the RocksDB state store."""
    ship(log.sparkSession)
    # Spark also makes the processor in a process beside the driver, which has no shipped files.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    commands = log.where("op IS NOT NULL").select("shard", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "idx", "op", "value")
    return commands.groupBy("shard", "bucket").transformWithStateInPandas(Apply(), ANSWERS, "Append", "None")
