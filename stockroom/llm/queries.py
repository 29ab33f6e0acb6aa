"""Registered queries over the corpus tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import fill_middle, languages, mixing, packing, quality_model, quality_rules, range_join, resampling, secret_scan, sharding, simhash, token_counts, url_lists
from stockroom.llm.scratch import new_path

TOKENIZER = "byte_bpe_50k.json"
#: Share of all tokens that mixing draws.
MIX_BUDGET = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a cache that starts empty."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), new_path(spark, "token-cache"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents and the verdict of the rule cascade."""
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*quality_rules.QUERY_COLUMNS)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts stay together."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with how often mixing expects them in a draw of half the tokens, and how often they are drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mixed(docs, budget=MIX_BUDGET).select("doc_id", "tokens", "topic", F.round("probability", 6).alias("probability"), "copies", "sampled")


def op6_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings that have a cosine of 0.9 or more."""
    return range_join.range_links(table(spark, sf_dir, "embeddings"))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all pages; the text model is fitted on documents."""
    return languages.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), suffixes=url_lists.PAGE_SUFFIXES)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model of the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents whose fingerprints of 3-word shingles differ in 3 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the list entries active when they were fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.filter_urls(url_lists.captures(pages), url_lists.derived_lists(pages))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle texts, and the texts restored from these, as digests."""
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.digest_columns(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_range_join": op6_range_join,
    "op7_languages": op7_languages,
    "op8_quality_model": op8_quality_model,
    "op9_simhash": op9_simhash,
    "op10_url_lists": op10_url_lists,
    "op11_fill_middle": op11_fill_middle,
    "op12_secrets": op12_secrets,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op5_mixing": mixing.oracle_sql(budget=MIX_BUDGET),
    "op10_url_lists": url_lists.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
}
