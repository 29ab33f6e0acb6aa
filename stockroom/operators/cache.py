"""The cache of results by URL: lookup, what to fetch, replay to rows, and upsert.

Rows to enrich have sheet, row_idx, brand, sku, link and ord (processing order). The cache has url_key,
confidence, height, width, depth, source_url, raw_text, reason and fetched_at, one row for each url_key. Rows
without a link are taken out before any of these joins: the empty key would be the hottest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V
from stockroom.functions.clean import stripped, url_key
from stockroom.sources.shared import small, stored

RESULT = ["height", "width", "depth", "confidence", "source_url", "raw_text", "reason"]


def with_key(rows: DataFrame) -> DataFrame:
    """Rows with their url_key, in one partitioning that all later steps by url_key reuse."""
    return rows.withColumn("url_key", url_key(F.col("link")))


def held_for(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache's rows for the links of ``rows``, stored, where the links are few enough to broadcast; else the cache itself.

    So what is shuffled follows the links, not the cache; one kept by ``store_cache`` isn't shuffled even where they are many.
    """
    keys = with_key(rows.where(has_link(F.col("link")))).select("url_key").distinct()
    known = small(stored(keys, "asked-keys"), or_none=True)
    return cache if known is None else stored(cache.join(known, "url_key", "left_semi"), "cache-asked")


def store_cache(cache: DataFrame, table: str, buckets: int = 200) -> DataFrame:
    """The cache as a table in buckets of url_key, sorted inside them; a join by url_key leaves it where it is.

    The other side is dealt to the same number of buckets. An existing table of the name is replaced.
    """
    cache.repartition(buckets, "url_key").write.mode("overwrite").bucketBy(buckets, "url_key").sortBy("url_key").format("parquet").saveAsTable(table)
    return cache.sparkSession.table(table)


def upsert_bucketed(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``upsert_cache`` as a full outer join: only the new rows are shuffled where the cache is in buckets of url_key."""
    columns = [*RESULT, "fetched_at"]
    last = new.groupBy("url_key").agg(F.max_by(F.struct(*columns), F.struct("fetched_at", "ord")).alias("_new"))
    old = cache.select("url_key", F.struct(*columns).alias("_old"))
    newer = F.col("_old").isNull() | (F.struct("_new.fetched_at") >= F.struct("_old.fetched_at"))
    both = old.join(last, "url_key", "full").withColumn("r", F.when(F.col("_new").isNotNull() & newer, F.col("_new")).otherwise(F.col("_old")))
    return both.select("url_key", "r.*")


def lookup_cache(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with url_key and cached: the result stored for it, or null. Empty dimensions read as null."""
    dims = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("height", "width", "depth")]
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("source_url", "raw_text", "reason")]
    stored = cache.select("url_key", F.struct(*dims, "confidence", *texts).alias("cached"))
    return with_key(rows).join(stored, "url_key", "left")


def should_fetch(confidence: Column, force: bool) -> Column:
    """Whether a URL is fetched, from the confidence cached for it (null: not cached)."""
    return F.when(confidence.isNull(), F.lit(True)).when(confidence == V.RESOLVED, F.lit(False)).otherwise(F.lit(force))


def fetch_worklist(rows: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """(url_key, ord, brand, link) to fetch. Without force one for each url_key, from its first row."""
    keyed = with_key(rows.where(has_link(F.col("link")))).select("url_key", "ord", "brand", "link")
    if force:
        return keyed.join(cache.where(F.col("confidence") == V.RESOLVED).select("url_key"), "url_key", "left_anti")
    first = keyed.groupBy("url_key").agg(F.min(F.struct("ord", "brand", "link")).alias("f")).select("url_key", "f.*")
    return first.join(cache.select("url_key"), "url_key", "left_anti")


def one_result(own: DataFrame) -> DataFrame:
    """One row for each (url_key, ord) of results, whatever a parser returned: the least, so that all readers agree."""
    return own.groupBy("url_key", "ord").agg(F.min("result").alias("result"))


def has_link(link: Column) -> Column:
    """Whether a row has a link; null and blank are none."""
    return stripped(link) != ""


def replay_results(rows: DataFrame, own: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Rows with a link and the result that each gets; ``own``: (url_key, ord, result struct) of ``fetch_worklist``.

    Each such row comes out once, even if ``own`` has several results for a key: the first row's, and of one row's the least.
    Without force all rows of a key take the cached result, or else the first row's. With force a row takes
    the cached result if that is resolved, or else that of the first earlier row that was resolved, or its own.
    """
    looked = lookup_cache(rows.where(has_link(F.col("link"))), cache)
    if not force:
        first = own.groupBy("url_key").agg(F.min(F.struct("ord", "result"))["result"].alias("_own"))
        return looked.join(first, "url_key", "left").withColumn("result", F.coalesce("cached", "_own")).drop("_own", "cached")
    own = one_result(own)
    # the first row of a key that is resolved: an aggregate, then a join, so that no key is in one window
    good = own.where(F.col("result.confidence") == V.RESOLVED).groupBy("url_key").agg(F.min(F.struct("ord", "result")).alias("g"))
    both = looked.join(own.select("url_key", "ord", F.col("result").alias("_own")), ["url_key", "ord"], "left").join(good, "url_key", "left")
    earlier = F.when(F.col("g.ord") < F.col("ord"), F.col("g.result"))
    kept = F.when(F.col("cached.confidence") == V.RESOLVED, F.col("cached"))
    return both.withColumn("result", F.coalesce(kept, earlier, F.col("_own"))).drop("_own", "cached", "g")


def new_cache_rows(own: DataFrame, fetched_at: Column) -> DataFrame:
    """Cache rows for fetched results (url_key, ord, result)."""
    return own.select("url_key", "ord", *(F.col(f"result.{c}").alias(c) for c in RESULT), fetched_at.alias("fetched_at"))


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows (as the cache, and ord): for each url_key the latest, then the highest ord."""
    columns = ["url_key", *RESULT, "fetched_at"]
    both = cache.select(*columns, F.lit(-1).cast("long").alias("ord")).unionByName(new.select(*columns, "ord"))
    # rows are sorted by what they are grouped by: a hash tells keys apart at once, where addresses of one shop begin alike
    last = both.groupBy(F.xxhash64("url_key").alias("_hash"), "url_key").agg(F.max_by(F.struct(*columns[1:]), F.struct("fetched_at", "ord")).alias("r"))
    return last.select("url_key", "r.*")


def first_resolved_before(rows: DataFrame) -> DataFrame:
    """rows (url_key, ord, confidence) with prior: ord of the first resolved row of the key before each.

    The first resolved row of a key is an aggregate, joined back: no key's rows are sorted in one task.
    """
    first = rows.where(F.col("confidence") == V.RESOLVED).groupBy("url_key").agg(F.min("ord").alias("_first"))
    return rows.join(first, "url_key", "left").withColumn("prior", F.when(F.col("_first") < F.col("ord"), F.col("_first"))).drop("_first")
