"""Running this package's functions over Arrow batches, wherever the executors are."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, wherever the driver has it from."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelog_shipped", False):
        return
    top = Path(__file__).parents[1]
    zipped = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog_package.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(zipped))
    sc._tidelog_shipped = True


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow, with this package on the executors; ``run`` goes by the places of columns, whose names may be any."""
    ship(df.sparkSession)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, ``spark.checkpoint.dir``.

    Only where that is unset on a local master, as in tests, a temporary folder of this machine
    takes its place; on a cluster each executor would write to its own disk, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} see")
        at = sc._tidelog_shared = getattr(sc, "_tidelog_shared", None) or tempfile.mkdtemp(prefix="tidelog-")
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
