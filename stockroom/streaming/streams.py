"""Catalogues as they arrive, and the result cache kept from a stream of results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockroom.operators.cache import RESULT
from stockroom.operators.rules import classify
from stockroom.sources.catalogue import catalogue_of, headed_rows
from stockroom.sources.shared import listed_by_cores
from stockroom.streaming import log_cache
from stockroom.streaming.log_cache import CACHE_SCHEMA, read_cache

__all__ = ["CACHE_SCHEMA", "cache_stream", "catalogue_stream", "classify_stream", "read_cache", "run_catalogue_streams"]

#: Sheets to a task: what one person edits is parsed in less time than a task and its file take.
SHEETS_PER_TASK = 8


def classify_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Classifies catalogue rows that land as Parquet under ``source`` and appends them to ``sink``; no state."""
    rows = spark.readStream.schema(schema).parquet(source)
    return classify(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def catalogue_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, *, files_per_batch: int = 100, rules: list | None = None, overrides: list | None = None, lane: str | None = None) -> StreamingQuery:
    """Classifies CSV sheets as they land under ``source``, each with its own banner and header row.

    A file comes whole in one batch and brings its own header. Rows go to ``sink``/rows (source_path,
    source_file, row_idx, the routing columns, link, sheet, block, reason), files without a header row to ``sink``/set_aside (source_path,
    source_file, reason). Each batch has a folder of its own that a repeated batch replaces: nothing is lost or doubled.
    ``lane``: a name that tells the folders of several streams into one sink apart (``run_catalogue_streams``).

    A batch is two jobs without a shuffle, the second of which reads what the first has parsed and kept: its cost beside its rows is
    what a trigger and two writes cost. ``SHEETS_PER_TASK`` sheets share a task and its file.
    """
    sheets = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(source)
    named = sheets.select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"))
    given = headed_rows(named.coalesce(math.ceil(files_per_batch / SHEETS_PER_TASK)))
    routed = classify(catalogue_of(given.withColumnRenamed("reason", "_aside"), "source_path", "source_file", "_aside"), rules, overrides)
    within = "" if lane is None else f"lane={lane}/"

    def route(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.where("_aside IS NULL").drop("_aside").write.mode("overwrite").parquet(f"{sink}/rows/{within}batch={number}")
            batch.where("_aside IS NOT NULL").select("source_path", "source_file", F.col("_aside").alias("reason")).write.mode("overwrite").parquet(f"{sink}/set_aside/{within}batch={number}")
        finally:
            batch.unpersist()

    return routed.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_catalogue_streams(spark: SparkSession, sources: dict[str, str], sink: str, checkpoint: str, **how) -> list[StreamingQuery]:
    """Runs ``catalogue_stream`` over each of ``sources``, all at once into one sink, until all is taken in; they are folders, or patterns of folders, that share no file.

    A small batch mostly waits: for its logs, its plan and its writes. Streams side by side wait at the same time, each for batches of ``files_per_batch``.
    ``sources`` have names, which name their checkpoints and folders: a name keeps its files from run to run. If a stream fails, the others are
    stopped; their checkpoints say where they go on.
    """
    started = []
    with listed_by_cores(spark):  # when a stream is made, and again when it begins
        try:
            for lane, source in sources.items():
                started.append(catalogue_stream(spark, source, sink, f"{checkpoint}/{lane}", lane=lane, **how))
            for stream in started:
                stream.awaitTermination()
        finally:
            for stream in started:
                stream.stop()
    return started


def cache_stream(results: DataFrame, path: str, checkpoint: str, *, compact: bool = True) -> StreamingQuery:
    """Keeps a cache under ``path`` from streamed results (cache columns and ord), the last of each URL winning.

    A batch adds a run of its own rows (``log_cache.append``), whatever the size of the cache. A batch that is stopped before its commit
    leaves the cache as it was; one that is run again, or a new checkpoint over a live cache, changes nothing. Several streams
    may keep one cache. ``compact``: whether a batch also merges runs of like size, and removes those replaced long ago.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        log_cache.append(batch, path)
        if compact and log_cache.compact(spark, path):
            log_cache.vacuum(spark, path)

    return results.select("url_key", *RESULT, "fetched_at", F.col("ord")).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
