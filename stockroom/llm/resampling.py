"""Importance resampling towards a target: hashed features scored from arrays, then a parallel sort by regular sampling.

Features are runs of words, each hashed into a bucket; a document keeps its distinct buckets and their counts, so that a
row is bounded however long the text is. A bucket's gain says how much likelier it is in the target than in the corpus;
a document's weight is the mean of its features' gains, read from one array of them. Buckets are counted inside
the tasks, in one array each, before anything is shuffled.

A document's score is its weight with Gumbel noise, so the highest scores are a draw without replacement. They are ranked by
regular sampling: the rows are dealt to runs, each sorted by itself; each run gives as many regularly spaced rows as there
are runs, and the splitters are regularly spaced among those; counts of each run between the splitters, added up, say how
many rows lie before each segment. Only the segments that hold drawn ranks are exchanged, merged, and numbered from there.
No segment has more than about twice the mean. A row's place in its run breaks ties, so copies of one row can't fill a segment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored

BUCKETS = 10_000
#: ASCII letters in lower case, what isn't in a word as a space.
_WORDS = bytes(c | 0x20 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: At most so many runs: the task that picks the splitters has this number squared.
MOST_RUNS = 512


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and code points beyond ASCII, of a UTF-8 text."""
    return text.translate(_WORDS).split()


def bucket_counts(words: list[bytes], runs: tuple[int, int], buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n_features, distinct buckets, their counts) of the runs of ``runs[0]`` to ``runs[1]`` words."""
    grams = [words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(runs[0], runs[1] + 1)]
    hashed = np.concatenate([np.fromiter(map(zlib.crc32, g), np.uint32, len(g)) for g in grams]) % np.uint32(buckets)
    seen, counts = np.unique(hashed, return_counts=True)
    return len(hashed), seen.astype(np.int32), counts.astype(np.int64)


def features(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = (), runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """``keep``, n_words, n_features and the distinct buckets with their counts, for each row; a null text has none.

    ``keep`` must not name one of these.
    """
    given = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_body"))
    own = {"n_words": pa.int64(), "n_features": pa.int64(), "buckets": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}
    if set(keep) & {*own, "_body"}:
        raise ValueError(f"columns may not be called {', '.join(own)} or _body")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(len(keep)).to_pylist():
                words = words_of(body)
                rows.append((len(words), *bucket_counts(words, runs, buckets)))
            columns = [list(c) for c in zip(*rows)] or [[]] * len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, kind) for c, kind in zip(columns, own.values()))], names=[*keep, *own])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)]]
    return given.mapInArrow(hashed, ", ".join([*kinds, "n_words long, n_features long, buckets array<int>, counts array<long>"]))


def totals(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows; the driver gets one number a bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets)
        for batch in batches:
            own += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at].astype(np.int64))], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in hashed.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log of each bucket's smoothed share in the target over that in the corpus, floored."""
    n, in_corpus, in_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (in_corpus + n) / ((s + 1.0) * (in_target + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(hashed: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, n_features and weight: the floored mean gain of a row's features, 0 where it has none."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts, n = batch.column("buckets"), batch.column("counts").flatten().to_numpy(), batch.column("n_features").to_numpy()
            ends = np.concatenate([[0], np.cumsum(gain[buckets.flatten().to_numpy()] * counts)])
            sizes = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
            sums = ends[sizes[1:]] - ends[sizes[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 2)), pa.array(sums // np.maximum(n, 1), pa.int64())], names=[*keep, "n_words", "n_features", "weight"])

    rows = hashed.select(*keep, "n_words", "n_features", "buckets", "counts")
    return rows.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep) + 2]) + ", weight long")


def noise(id: Column, seed: int = 2024) -> Column:
    """Thousandfold Gumbel noise from the id and seed alone, floored; a null id draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _segment(key: Column, splitters: Column, n: int) -> Column:
    """How many of the sorted splitters are at or before the key, by halving: a column of an array stays one expression."""
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    at = lambda low, step: F.when(F.get(splitters, low + step - 1) <= key, low + step).otherwise(low)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), at) if steps else F.lit(0)


def sorted_runs(rows: DataFrame, runs: int) -> DataFrame:
    """The rows dealt to ``runs`` runs by their number ``row``, each run sorted by itself, with run and at; stored."""
    dealt = rows.repartition(runs, "row").sortWithinPartitions(F.desc("score"), "id", "row").withColumn("_p", F.monotonically_increasing_id())
    return stored(dealt.select(*rows.columns, F.shiftright("_p", 33).cast("int").alias("run"), F.col("_p").bitwiseAND((1 << 33) - 1).alias("at")), "sorted-runs")


def _key() -> Column:
    """Less for rows that come earlier: falling score, rising id, and then the row's number."""
    return F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"), F.col("row").alias("r"))


def _regular(place: Column, of: Column, n: int) -> Column:
    """Whether a place (from 0) is the first of one of ``n`` equal stretches of ``of`` rows."""
    return (place == 0) | (F.floor(place * n / of) != F.floor((place - 1) * n / of))


def splitters_of(local: DataFrame, runs: int) -> Column:
    """At most ``runs`` - 1 sorted keys, as an array, between which segments lie: from regular samples of sorted runs."""
    sizes = local.groupBy("run").agg(F.count("*").alias("n"))
    samples = local.join(F.broadcast(sizes), "run").where(_regular(F.col("at"), F.col("n"), runs)).select(_key().alias("k"))
    numbered = samples.select("k", (F.row_number().over(W.orderBy("k")) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("m"))
    kind = numbered.schema["k"].dataType
    keys = sorted((r.i, r.k) for r in numbered.where((F.col("i") > 0) & _regular(F.col("i"), F.col("m"), runs)).collect())
    return F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, kind.fields))) for _, k in keys)).cast(f"array<{kind.simpleString()}>")


def ranked(rows: DataFrame, draw: int, *, runs: int | None = None) -> DataFrame:
    """``rows`` with rank: 1 to ``draw`` by falling score and rising id, null for the rest.

    ``rows``: id, score, row (a number of each row's own, which tells equal rows apart) and any others but run, at and segment.
    A null id comes first among equal scores. ``runs``: the session's number of shuffle partitions by default, ``MOST_RUNS`` at most.
    """
    runs = max(1, min(runs or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RUNS))
    local = sorted_runs(rows, runs)
    placed = local.withColumn("segment", _segment(_key(), splitters_of(local, runs), runs))
    counts = {r.segment: r["count"] for r in placed.groupBy("segment").count().collect()}
    before, starts = 0, []
    for segment in range(max(counts, default=-1) + 1):  # segments in which a drawn rank lies
        if before >= draw:
            break
        starts.append(before)
        before += counts.get(segment, 0)
    held = F.col("segment") < len(starts)
    none = F.lit(None).cast("long")
    if not starts:
        return rows.withColumn("rank", none)
    at = F.row_number().over(W.partitionBy("segment").orderBy(F.desc("score"), "id", "row"))
    merged = placed.where(held).withColumn("rank", (F.get(F.array(*(F.lit(n).cast("long") for n in starts)), F.col("segment")) + at).cast("long"))
    drawn = merged.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.select(*rows.columns, "rank").unionByName(placed.where(~held).select(*rows.columns, none.alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, text: str = "text", id: str = "doc_id", words: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10, runs: int | None = None) -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of ``docs``; rank is null where a row isn't drawn.

    Of N rows with ``least_words`` words or more, ``percent`` percent of N (floored) are drawn, those of the highest scores. Features
    are runs of ``words[0]`` to ``words[1]`` words. A null text has no words, no features and weight 0. Rows that repeat are rows of
    their own: each may be drawn. Without rows there is no result; without texts in ``target`` all its buckets are alike. Other
    columns are not read.
    """
    hashed = stored(features(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), keep=("id",), runs=words, buckets=buckets), "features", batch_rows=2000)
    gain = gains(totals(hashed, buckets), totals(features(target.select(F.col(text).alias("text")), runs=words, buckets=buckets), buckets))
    score = (F.col("weight") + noise(F.col("id"), seed)).cast("long")
    scored = stored(weighted(hashed, gain, keep=("id",)).withColumns({"score": score, "row": F.monotonically_increasing_id()}), "scored", batch_rows=2000)
    able = F.col("n_words") >= least_words
    out = ranked(scored.where(able), percent * scored.where(able).count() // 100, runs=runs).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
