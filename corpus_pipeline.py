"""The corpus pipeline: five stages over documents, each an operator of stockroom.llm.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import mixing, packing, quality_model, quality_rules, simhash
from stockroom.llm.queries import table, tokenizer_path
from stockroom.llm.scratch import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a document must have: a short one can be clean.
MIN_WORDS = 1
#: Share of the tokens that mixing draws.
MIX_BUDGET = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, doesn't reject."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.scores(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; any text of ``MIN_WORDS`` words or more is long enough."""
    return quality_rules.passed(docs.select(*COLUMNS), min_words=MIN_WORDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a row with the smallest doc_id, or any if none has one."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn as often as raking gives them out of a budget of half the tokens.

    A document of a cell that should have more tokens than it holds is repeated.
    """
    drawn = mixing.mixed(docs, budget=MIX_BUDGET)
    return drawn.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, fingerprints and packing can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each stage's rows are written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
