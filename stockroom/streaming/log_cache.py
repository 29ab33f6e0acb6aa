"""A result cache kept as a log of small sorted runs, merged when read and compacted by size.

Under the cache's folder lie ``rows/<name>/level=<n>`` (Parquet, sorted by url_key; 0 for a batch, more for merged runs) and ``log/<name>.json``, one entry for each commit: the run
that it adds, its number of rows, its sequence number, and the runs that it stands for. A run counts once its entry is there and
is whole, and until another entry stands for it. Entries have names of their own and are created only where there is none, so
writers never wait for each other and none can undo another's: two batches at once are two entries, and two compactions of the same
runs hold the same rows twice, which reading merges.

A row keeps the sequence number of the batch that brought it. Of a URL's rows the latest fetched_at wins, then the highest
sequence number, then ord, then the row's own values; any merge of any runs therefore ends in the same cache. Sequence numbers are one
more than the highest that a writer saw.

A batch writes its own rows and one entry. When ``FANOUT`` runs of like size have gathered they are merged into one: a row is written
again once a size class, so the bytes of a batch grow with the logarithm of the cache at most. What a compaction replaced stays
for readers until ``KEEP_SECONDS`` have passed; ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stockroom.operators.cache import RESULT
from stockroom.sources.shared import small

CACHE_SCHEMA = "url_key string, height string, width string, depth string, confidence string, source_url string, raw_text string, reason string, fetched_at timestamp"
RUN_SCHEMA = CACHE_SCHEMA + ", seq long, ord long"
#: Runs of a size class that are merged; rows of the smallest class; seconds that replaced runs stay.
FANOUT, LEAST_ROWS, KEEP_SECONDS = 8, 1000, 3600.0


@dataclass(frozen=True)
class Run:
    """What the log says of a run."""

    name: str
    path: str
    rows: int
    seq: int
    time: float
    replaces: tuple[str, ...] = ()


def tier_of(rows: int) -> int:
    """Size class: each holds ``FANOUT`` times the rows of the one before."""
    return 0 if rows < LEAST_ROWS else 1 + int(math.log(rows / LEAST_ROWS, FANOUT))


class _Folder:
    """Files of a folder on any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.at = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def create(self, name: str, text: str) -> None:
        """A new file; an error where there is one of this name."""
        out = self.fs.create(self.at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


#: Entries read before, by the path of their log: they never change.
_KNOWN: dict[str, dict[str, Run]] = {}


def entries(spark: SparkSession, path: str) -> dict[str, Run]:
    """All entries of a cache's log. One that is still being written isn't there yet."""
    log, known = _Folder(spark, f"{path}/log"), _KNOWN.get(path, {})
    found = {}
    for file in log.names():
        if file in known:
            found[file] = known[file]
            continue
        try:
            told = json.loads(log.read(file))
        except ValueError:
            continue
        except Py4JJavaError as error:  # removed since it was listed
            if "FileNotFoundException" not in str(error):
                raise
            continue
        found[file] = Run(**(told | {"replaces": tuple(told["replaces"])}))
    _KNOWN[path] = found
    return {run.name: run for run in found.values()}


def live(spark: SparkSession, path: str) -> list[Run]:
    """The runs that count, oldest first."""
    all_of = entries(spark, path)
    gone = {name for run in all_of.values() for name in run.replaces}
    return sorted((run for run in all_of.values() if run.name not in gone), key=lambda run: (run.seq, run.name))


def _rows(spark: SparkSession, path: str, runs: list[Run]) -> DataFrame:
    """All rows of some runs, in one scan."""
    held = [f"{path}/rows/{run.path}" for run in runs if run.rows]
    return spark.read.schema(RUN_SCHEMA).parquet(*held) if held else spark.createDataFrame([], RUN_SCHEMA)


def merged(rows: DataFrame) -> DataFrame:
    """One row for each URL: the last."""
    order = F.struct("fetched_at", "seq", "ord", *RESULT)
    last = rows.groupBy("url_key").agg(F.max(order).alias("r"))
    return last.select("url_key", *(F.col(f"r.{c}") for c in (*RESULT, "fetched_at", "seq", "ord")))


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The cache as of its last commits; empty if there is none. ``keys``: the url_key that are asked for, if not all.

    Keys that are few enough to broadcast leave the other rows at the scan: what is shuffled follows the keys, not the cache.
    """
    rows = _rows(spark, path, live(spark, path))
    if keys is not None:
        rows = rows.join(small(keys.select("url_key").distinct()), "url_key", "left_semi")
    return merged(rows).select(*(c.split()[0] for c in CACHE_SCHEMA.split(", ")))


def _write(spark: SparkSession, path: str, rows: DataFrame, seq: int, level: int, replaces: tuple[str, ...] = ()) -> Run:
    """Writes rows that ``merged`` returned as a run, in as many files as Spark gives them partitions, and commits it."""
    name, counted = uuid.uuid4().hex, Observation()
    at = f"{name}/level={level}"
    rows.observe(counted, F.count(F.lit(1)).alias("n")).sortWithinPartitions("url_key").write.parquet(f"{path}/rows/{at}")
    run = Run(name, at, counted.get["n"], seq, time.time(), replaces)
    _Folder(spark, f"{path}/log").create(f"{name}.json", json.dumps(run.__dict__))
    return run


def append(batch: DataFrame, path: str) -> Run:
    """Adds results (cache columns and ord) to a cache as one run; of a URL's rows the last. The same batch again changes nothing."""
    spark = batch.sparkSession
    seq = 1 + max((run.seq for run in entries(spark, path).values()), default=0)
    columns = [c.split()[0] for c in CACHE_SCHEMA.split(", ")]
    rows = merged(batch.select(*columns, F.lit(seq).cast("long").alias("seq"), F.col("ord").cast("long").alias("ord")))
    return _write(spark, path, rows, seq, 0)


def compact(spark: SparkSession, path: str, fanout: int = FANOUT) -> list[Run]:
    """Merges runs of a size class as long as one has ``fanout`` of them; the new runs."""
    made = []
    while True:
        tiers: dict[int, list[Run]] = {}
        for run in live(spark, path):
            tiers.setdefault(tier_of(run.rows), []).append(run)
        tier, full = next(((t, runs) for t, runs in sorted(tiers.items()) if len(runs) >= fanout), (0, []))
        if not full:
            return made
        made.append(_write(spark, path, merged(_rows(spark, path, full)), max(run.seq for run in full), tier + 1, tuple(run.name for run in full)))


def vacuum(spark: SparkSession, path: str, keep_seconds: float = KEEP_SECONDS) -> list[str]:
    """Removes runs that others have stood for since ``keep_seconds``; their names. Their entries go first, so none is without a run.

    A run whose writer was lost before its entry stays: nothing tells it from one that is being written.
    """
    all_of, now = entries(spark, path), time.time()
    gone = [name for run in all_of.values() if now - run.time >= keep_seconds for name in run.replaces if name in all_of]
    log, runs = _Folder(spark, f"{path}/log"), _Folder(spark, f"{path}/rows")
    for name in gone:
        log.remove(f"{name}.json")
        runs.remove(name)
    return gone
