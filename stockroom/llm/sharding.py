"""Shards of near equal size from atomic groups, by the smallest capacity that suffices.

Rows with equal texts form a group that no cut may split. Groups lie in the order of their atoms: an atom
is a bucket of the text's hash, so equal texts share one, and their number is fixed however large the
input is. Only the atoms' sums reach the driver. An atom of at least the mean share takes a shard for
itself. Over the others, a binary search finds the smallest capacity with which a greedy pass from left
to right needs no more shards than are left, and the cuts of that pass are taken. Slots are counted in
lanes, so that no shard is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cuts (index of the first atom of each next shard) of a greedy pass, or None if ``shards`` are too few."""
    cuts, start = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + capacity, "right"))
        if at == len(ends):
            return cuts
        if at == start:
            return None
        cuts.append(at)
        start = at
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity of ``shards`` contiguous parts of ``sizes``, and the greedy cuts at it."""
    if not len(sizes):
        return 0, []
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(ends, middle, shards) is not None else (middle + 1, high)
    return low, greedy(ends, low, shards)


def plan(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each atom: atoms of at least the mean share alone, the rest by ``minimax_cuts``."""
    shard, left, rest = np.zeros(len(sizes), np.int64), shards, np.arange(len(sizes))
    while left > 1 and len(rest):
        large = rest[sizes[rest] * left >= sizes[rest].sum()]
        large = large[np.argsort(-sizes[large], kind="stable")][: left - 1]
        if not len(large) or len(large) == len(rest):
            break
        shard[large] = shards - left + np.arange(len(large))
        left, rest = left - len(large), np.setdiff1d(rest, large)
    _, cuts = minimax_cuts(sizes[rest], left)
    shard[rest] = shards - left + np.searchsorted(cuts, np.arange(len(rest)), "right")
    return shard


def shard_documents(docs: DataFrame, *, shards: int = 40, overhead: int = 16, atoms: int = 1 << 17, lane_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) for each row of ``docs``.

    Size: UTF-8 bytes of the text plus ``overhead``; a null text has size ``overhead`` and the checksum of
    the empty text, and is in one group with it. Repeated rows each get a slot. An empty table gives no rows.
    ``atoms`` bounds what the driver holds (16 bytes each); it is far more than the shards, so that cuts
    fall within a small part of a shard's size.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shard-rows",
    )
    sums = rows.groupBy("atom").agg(F.sum("size").alias("size")).orderBy("atom").toPandas()
    of = sums.assign(shard=plan(sums["size"].to_numpy(np.int64), shards))
    # neighbours in one shard make a run: few runs, so the map from atoms to shards is a small table
    of["run"] = (of["shard"] != of["shard"].shift()).cumsum()
    runs = of.groupby("run").agg(first=("atom", "min"), shard=("shard", "first")) if len(of) else of.assign(first=0)
    shard = F.array(*(F.lit(int(s)) for s in runs["shard"])) if len(runs) else F.array(F.lit(0))
    firsts = F.array(*(F.lit(int(a)) for a in runs["first"])) if len(runs) else F.array(F.lit(0))
    placed = rows.withColumn("shard", F.get(shard, F.size(F.filter(firsts, lambda a: a <= F.col("atom"))) - 1))

    lanes = max(16, -(-rows.count() // (shards * lane_rows)))
    placed = placed.withColumn("lane", F.pmod("place", F.lit(lanes)))
    counts = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = counts.select("shard", "lane", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = placed.withColumn("at", F.row_number().over(W.partitionBy("shard", "lane").orderBy("place")))
    return within.join(stored(before, "shard-lanes"), ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
