"""What the operators of this subpackage share: tables, cuts of lineage, columns made batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidelog.plans.shipping import map_batches, shared_path

PART_BYTES = 4_000_000
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again: its lineage ends here."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def _files(df: DataFrame):
    """The file system and path of a table made by ``cut``."""
    jvm, path = df.sparkSession._jvm, df._tidelog_path
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), at


def small(df: DataFrame) -> DataFrame:
    """``df``, a table made by ``cut``, to be broadcast if it has few rows and bytes; else it is joined by a shuffle."""
    system, at = _files(df)
    few = system.getContentSummary(at).getLength() <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` from which nothing is read any more."""
    for df in tables:
        system, at = _files(df)
        system.delete(at, True)


def named(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_parts(batches: Iterator[pa.RecordBatch], limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes, so that what a part becomes stays small too."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def add_columns(
    df: DataFrame,
    fields: list[StructField],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields``, which ``make`` derives from each Arrow batch.

    ``make`` gets a batch of all columns of ``df`` and returns one array for each field. Rows stay
    where they are; nothing is shuffled.
    """
    kept = df.columns if keep is None else keep
    places = [df.columns.index(c) for c in kept]
    schema = StructType([*(df.schema[i] for i in places), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map_parts(batches):
            arrays = [*(batch.column(i) for i in places), *make(batch)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(df, run, schema)


def row_lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """An array of lists, the i-th with the next counts[i] of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)
