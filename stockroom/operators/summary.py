"""Counts over classified catalogues and over results. All are partial aggregates on few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V


def sheets(spark) -> DataFrame:
    """(sheet_ord, sheet) of the six sheets."""
    return spark.createDataFrame(list(enumerate(V.SHEETS, 1)), "sheet_ord int, sheet string")


def rows_per_file(catalogue: DataFrame) -> DataFrame:
    """(source_file, total_rows)."""
    return catalogue.groupBy("source_file").agg(F.count("*").alias("total_rows"))


def mapped_by_sheet(classified: DataFrame) -> DataFrame:
    """(sheet_ord, sheet, n) for all six sheets, with zeros."""
    counted = classified.where("sheet IS NOT NULL").groupBy("sheet").agg(F.count("*").alias("n"))
    return sheets(classified.sparkSession).join(counted, "sheet", "left").select("sheet_ord", "sheet", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mapped_by_sheet_nonzero(classified: DataFrame) -> DataFrame:
    """``mapped_by_sheet`` without empty sheets."""
    return mapped_by_sheet(classified).where("n > 0")


def unmapped_by_reason(classified: DataFrame) -> DataFrame:
    """(reason, n). Reasons hold free text, so their number can grow with the input."""
    return classified.where("sheet IS NULL").groupBy("reason").agg(F.count("*").alias("n"))


def run_summary(classified: DataFrame) -> DataFrame:
    """One row: source rows, mapped, unmapped and missing dimensions; mapped + unmapped = source."""
    n = F.count_if(F.col("sheet").isNotNull())
    return classified.agg(F.count("*").alias("source_rows"), n.alias("total_mapped"), F.count_if(F.col("sheet").isNull()).alias("total_unmapped"), n.alias("missing_dimensions"))


def summarise_blank_rows(rows: DataFrame) -> DataFrame:
    """(sheet, brand, n): in all (both null), by sheet (brand null) and by brand (sheet null)."""
    level = F.grouping_id().alias("level")
    return rows.groupingSets([["sheet"], ["brand"], []], "sheet", "brand").agg(level, F.count("*").alias("n")).select("sheet", "brand", F.col("level").cast("long"), "n")


def results_by_confidence(results: DataFrame) -> DataFrame:
    """One row: resolved, needs_review, not_found."""
    of = lambda c, name: F.count_if(F.col("confidence") == c).alias(name)
    return results.agg(of(V.RESOLVED, "resolved"), of(V.NEEDS_REVIEW, "needs_review"), of(V.NOT_FOUND, "not_found"))


def confidence_by_brand(results: DataFrame) -> DataFrame:
    """(brand, resolved, needs_review, not_found), by brand."""
    of = lambda c, name: F.count_if(F.col("confidence") == c).alias(name)
    return results.groupBy("brand").agg(of(V.RESOLVED, "resolved"), of(V.NEEDS_REVIEW, "needs_review"), of(V.NOT_FOUND, "not_found")).orderBy("brand")


def review_list(results: DataFrame) -> DataFrame:
    """Rows for a person: all that need review, then all not found, each in processing order (ord)."""
    rank = F.when(F.col("confidence") == V.NEEDS_REVIEW, 1).when(F.col("confidence") == V.NOT_FOUND, 2)
    columns = ["brand", "sku", "sheet", "confidence", "source_url", "reason", "raw_text"]
    listed = results.withColumn("review_rank", rank).where("review_rank IS NOT NULL").orderBy("review_rank", "ord")
    return listed.select("review_rank", "ord", *(F.col(c).alias(n) for c, n in zip(columns, V.REVIEW_HEADERS)))
