"""Catalogue files in, tables out.

A landing has one row for each sheet row: source_file, row_idx (from 1) and cells. Rows 1 to 3 are a
banner, row 4 holds the headers, and data follow. Spark reads text, JSON and Parquet; other formats land
as one of these.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions.clean import clean_cell, stripped
from stockroom.operators.layout import order_output
from stockroom.operators.rules import FIELDS
from stockroom.sources.shared import small

HEADER_ROW = 4


#: Formats whose reader joins the columns of files of several schemas by name, in one scan.
MERGED = {"parquet": {"mergeSchema": True}, "orc": {"mergeSchema": True}, "json": {}}


def _first_lines(spark: SparkSession, paths: list[str], **options) -> list[tuple[str, list[str]]]:
    """(header line, paths) of text files, those with the same first line together; read by one job."""
    text = {k: v for k, v in options.items() if k in ("encoding", "lineSep", "pathGlobFilter", "recursiveFileLookup")}
    lines = spark.read.options(**text).text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    # the path comes as an URL
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "i").alias("head")).select("head", path)
    return [(r.head, sorted(r.paths)) for r in first.groupBy("head").agg(F.collect_list("path").alias("paths")).orderBy("head").collect()]


def _scans(spark: SparkSession, paths: list[str], fmt: str, options: dict) -> list[DataFrame]:
    """The files by schema: as few scans as there are schemas, or one where the reader joins columns by name itself."""
    read = lambda some, more: spark.read.format(fmt).options(**options, **more).load(some)
    if fmt in MERGED:
        try:
            return [read(paths, MERGED[fmt])]
        except Exception as error:
            if "CONFLICTING" in str(error).upper():  # folders of different partitions
                return [read([path], {}) for path in paths]
            if "MERGE" not in str(error).upper():
                raise
        # a column of several types: files of one schema together, and each group becomes text by itself
        by: dict[str, list[str]] = {}
        for path in paths:
            by.setdefault(read([path], {}).schema.json(), []).append(path)
        return [read(some, {}) for some in by.values()]
    if fmt == "csv" and str(options.get("header", "")).lower() == "true":
        return [read(some, {}) for _, some in _first_lines(spark, paths, **options)] or [read(paths, {})]
    return [read([path], {}) for path in paths]


def read_catalogues(spark: SparkSession, paths: list[str], fmt: str = "parquet", na_values: bool | None = None, **options) -> DataFrame:
    """Files with named columns as one table of clean strings, with source_file and source_path.

    Columns that a file lacks are empty. Give row_seq in the files where order matters: Spark keeps none. Files of one schema are one
    scan, however many there are. Text formats read words for missing values as empty, unless ``na_values`` says otherwise.
    """
    options = {"header": True, **options} if fmt == "csv" else options
    na_values = fmt == "csv" if na_values is None else na_values
    if not paths:
        raise ValueError("no paths")
    apart, out = ("row_seq", "source_file", "source_path"), None
    for df in _scans(spark, paths, fmt, options):
        df = df.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))
        df = df.withColumns({c: clean_cell(F.col(f"`{c}`"), kind, na_values) for c, kind in df.dtypes if c not in apart})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    cells = [c for c in out.columns if c not in apart]
    return drop_blank_rows(out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in cells}), cells)


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have something in any of ``columns``."""
    if not columns:
        return df.limit(0)
    return df.where(F.exists(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns)), lambda x: x != ""))


def promote_header(grid: DataFrame, header_row: int = HEADER_ROW, by: str = "source_file") -> DataFrame:
    """(``by``, row_idx, header, cells): data rows of a landing with their file's clean header; blank rows go.

    ``by`` tells files apart: give the path where names repeat. A file with several header rows has the least of them. The
    headers are broadcast after the files are counted, so a large file is not one task.
    """
    clean = lambda cells: F.transform(cells, lambda c: clean_cell(c))
    heads = grid.where(F.col("row_idx") == header_row).groupBy(by).agg(F.min(clean("cells")).alias("header"))
    rows = grid.where(F.col("row_idx") > header_row).select(by, "row_idx", clean("cells").alias("cells"))
    return rows.where(F.exists("cells", lambda c: c != "")).join(small(heads), by)


def cell(name: str):
    """The cell under a header of ``promote_header``'s rows; of repeated headers the first; none is empty."""
    at = F.array_position("header", F.lit(name)).cast("int")
    return F.coalesce(F.when(at > 0, F.get("cells", at - 1)), F.lit(""))


def product_url():
    """The cell under the first header that ends with "product url" in any case; none is empty."""
    titles = F.transform("header", lambda h: F.endswith(F.lower(stripped(h)), F.lit("product url")))
    at = F.array_position(titles, F.lit(True)).cast("int")
    return F.coalesce(F.when(at > 0, F.get("cells", at - 1)), F.lit(""))


def headed_rows(files: DataFrame, text: str = "value", header_row: int = HEADER_ROW) -> DataFrame:
    """The data rows of CSV sheets given whole, one row a file: the files' other columns, reason, row_idx, header and cells, as of ``promote_header``.

    A file without a header row with something in it is one row with the reason. Quoted cells may hold line ends. A file
    brings its own header, so nothing is joined or shuffled. A sheet is what one person edits, so it fits a task; files are spread over tasks.
    """

    @F.pandas_udf("array<array<string>>")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([list(csv.reader(io.StringIO((t or "").lstrip("\ufeff"), newline=""))) for t in texts], dtype=object)

    clean = lambda cells: F.transform(cells, lambda c: clean_cell(c))
    filled = lambda cells: F.exists(cells, lambda c: c != "")
    kept = [c for c in files.columns if c != text]
    landed = files.select(*kept, rows(F.col(text)).alias("_rows")).withColumn("header", clean(F.get("_rows", F.lit(header_row - 1))))
    headed = F.coalesce(filled("header"), F.lit(False))
    told = landed.select(*kept, F.when(~headed, F.lit(f"no header in row {header_row}")).alias("reason"), "header", F.posexplode_outer(F.when(headed, F.col("_rows"))).alias("_at", "cells"))
    told = told.select(*kept, "reason", (F.col("_at") + 1).cast("long").alias("row_idx"), "header", clean("cells").alias("cells"))
    return told.where(F.col("reason").isNotNull() | ((F.col("row_idx") > header_row) & filled("cells")))


def catalogue_of(promoted: DataFrame, *kept: str) -> DataFrame:
    """The columns that routing uses, from ``promote_header``'s rows, after those to be kept (by default source_file)."""
    return promoted.select(*(kept or ("source_file",)), "row_idx", *(cell(title).alias(name) for title, name in FIELDS.items()), product_url().alias("link"))


def write_catalogue(mapped: DataFrame, unmapped: DataFrame, path: str) -> None:
    """Mapped rows as Parquet by sheet under path/mapped, in block and row order; unmapped rows under path/unmapped, in order of row_seq.

    Files of a sheet follow each other by name. Both folders are replaced, so that none is left of an earlier run.
    """
    order_output(mapped).drop("sheet_ord").orderBy("sheet", "block_ord", "row_seq").write.mode("overwrite").partitionBy("sheet").parquet(f"{path}/mapped")
    unmapped.orderBy("row_seq").write.mode("overwrite").parquet(f"{path}/unmapped")


def write_enriched(listing: DataFrame, path: str) -> None:
    """The enriched listing as Parquet by sheet, in row order."""
    listing.orderBy("sheet", "row_idx").write.mode("overwrite").partitionBy("sheet").parquet(path)
