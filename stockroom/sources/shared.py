"""Intermediate tables in the folder that the cluster shares, and broadcasts of a checked size.

A table written here cuts lineage and survives the loss of executors. The folder is the session's
``spark.checkpoint.dir``. Only where that is unset, as in local tests, a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="stockroom-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that a Python worker gets at once; a single longer row still goes whole.
BATCH_BYTES = 16 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this holds, Python workers get at most ``rows`` rows and about ``BATCH_BYTES`` at once, whatever their texts' lengths."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in limits}
    for key, limit in limits.items():
        old = int(before[key].rstrip("bB"))
        spark.conf.set(key, str(min(limit, old) if old > 0 else limit))
    try:
        yield
    finally:
        for key, old in before.items():
            spark.conf.set(key, old)


@contextmanager
def spread_out(spark: SparkSession) -> Iterator[None]:
    """While this holds, Spark keeps small shuffle partitions apart: for rows that cost far more work than their bytes say."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """While this holds, many folders are listed by a task for each core, not one for each folder: for folders of a file or two, where a task costs more than its list."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, to a task for each core or shuffle partition: for few bytes in few files that cost much work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def stored(df: DataFrame, name: str, *, batch_rows: int | None = None, dear: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again. ``dear``: its rows cost much work (``spread_out``)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark, batch_rows) if batch_rows else nullcontext(), spread_out(spark) if dear else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a rule list or header table that may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS, *, or_none: bool = False, counted: DataFrame | None = None) -> DataFrame | None:
    """``df`` to be broadcast if it has at most ``rows`` rows; else as it is, and Spark joins by shuffling (``or_none``: else None).

    ``counted``: a table of as many rows that is cheaper to count.
    """
    if (df if counted is None else counted).limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return None if or_none else df
