"""Token counts through a cache of digests.

A text's count depends on its normalised content and on the tokenizer's version alone. The cache is a
Parquet folder, one partition for each tokenizer version, with a row for each content digest. A call
takes away the digests that the cache holds, fetches one text for each digest that is left, encodes
those, appends them, and joins the stored counts back by digest. Texts are shuffled only where there are
more misses than may be broadcast, as digests: a warm cache moves digests alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stockroom.llm.encoding import encoder
from stockroom.llm.scratch import batches_of, stored

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file and of how it is applied."""
    with open(path, "rb") as file:
        return hashlib.sha256(b"no special tokens added\0" + file.read()).hexdigest()[:32]


def read_cache(spark, cache_path: str) -> DataFrame:
    """The stored counts; empty where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 512,
    broadcast_misses: int = 100_000,
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for each row of ``docs``.

    ``normalise`` may map texts that the tokenizer can't tell apart to one; it must not change counts.
    Null counts as the empty text (0 bytes, 0 tokens). Repeated rows each return a row. Other columns of
    ``docs`` are not read. ``keep`` columns may hold nulls, and may not be called n_bytes, n_tokens, over_limit or content. If
    a call is stopped before its append ends, nothing is appended and the next call encodes it again. Two calls at once
    may both append a digest: it is stored twice, and counts once.
    """
    if set(keep) & {"n_bytes", "n_tokens", "over_limit", "content"}:
        raise ValueError("keep names a column of the result")
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    content = normalise(F.coalesce(F.col(text), F.lit("")))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = encoder(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame({"content": batch["content"], "n_tokens": [len(x) // 4 for x in tokenizer.ids(batch["body"].tolist())]})

    missing = stored(docs.select(digest.alias("content")).distinct().join(known, "content", "left_anti"), "token-misses")
    n = missing.count()
    bodies = docs.select(digest.alias("content"), content.alias("body"))
    first = F.first("body").alias("body")
    if n <= broadcast_misses:  # 32 bytes each: texts that the cache knows stay where they are
        misses = bodies.join(F.broadcast(missing), "content", "left_semi").groupBy("content").agg(first)
    else:  # copies meet on the map side; the digests are joined in the grouping's own partitions
        misses = bodies.groupBy("content").agg(first).join(missing.hint("merge"), "content", "left_semi")
    if n:
        with batches_of(spark, 500):
            misses.mapInPandas(encode, "content binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.partitionBy("tokenizer").mode("append").parquet(cache_path)

    # a digest has one count, so distinct rows are distinct digests; not grouped by the join's own key, so that Spark can split the join where many rows share a text
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens").distinct()
    rows = docs.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), digest.alias("content"))
    return rows.join(counts, "content").select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
