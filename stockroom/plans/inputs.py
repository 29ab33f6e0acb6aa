"""Derived inputs of the queries as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V
from stockroom.operators.cache import upsert_cache
from stockroom.operators.layout import Laid, blank_rows_of, laid_out, positions
from stockroom.operators.rules import classify, mapped
from stockroom.plans import derive
from stockroom.sources.shared import stored

RUN_TIME = "2024-06-01 00:00:00"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.derived(spark, sf_dir, derive.CATALOGUE)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(catalogue(spark, sf_dir))


def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapped rows of the catalogue. What the rules say is stored: a filter on it goes down to the scan, ahead of the dealing out of rows, and computes it once more."""
    return mapped(stored(classified(spark, sf_dir).select("row_seq", "brand", "sku", "link", "sheet", "block"), "classified"))


def laid(spark: SparkSession, sf_dir: str) -> Laid:
    return laid_out(mapped_rows(spark, sf_dir), held=True)


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as sheets: a banner row, a header row whose last title varies by file, and the data."""
    rows = derive.derived(spark, sf_dir, derive.GRID)
    titles = [F.lit(t) for t in ("Brand", "Product Group", "Subcategory", " Model / SKU ", "Product Name")]
    files = rows.select("source_file").distinct()
    heads = files.select("source_file", F.lit(4).cast("long").alias("row_idx"), F.array(*titles, F.concat(F.col("source_file"), F.lit(" Product URL"))).alias("cells"))
    banner = files.select("source_file", F.lit(1).cast("long").alias("row_idx"), F.array(F.lit("Master catalogue")).alias("cells"))
    data = rows.select("source_file", "row_idx", F.array("brand", "product_group", "subcategory", "sku", "product_name", "link").alias("cells"))
    return data.unionByName(heads).unionByName(banner)


def rows_to_enrich(spark: SparkSession, sf_dir: str, of: Laid | None = None) -> DataFrame:
    """Blank rows with ord: by sheet order, then by row. ``of``: the layout of the rows, if it is at hand."""
    blank = blank_rows_of(positions(laid(spark, sf_dir) if of is None else of))
    place = F.array_position(F.array(*map(F.lit, V.SHEETS)), F.col("sheet"))
    return blank.withColumn("ord", place * 1_000_000_000_000 + F.col("row_idx"))


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.derived(spark, sf_dir, derive.CACHE_LOG)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each URL in the log."""
    log = cache_log(spark, sf_dir)
    return upsert_cache(log.drop("ord").limit(0), log)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.derived(spark, sf_dir, derive.PAIRS)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, pairs): the pairs of each page in order, four at most."""
    of = F.array_sort(F.collect_list(F.struct("seq", "label", "value")))
    # rows of part are dealt out by their keys, so a page's pairs come from one task: only part is shuffled
    got = derive.derived(spark, sf_dir, derive.PAIRS, by="p_partkey").groupBy("page_key").agg(of.alias("p"))
    return got.select("page_key", F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("pairs"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, url, status, error, html): each page's pairs as a table, a dl, classed divs, JSON-LD or next-data."""
    join = lambda make: F.array_join(F.transform("pairs", make), "")
    c = F.concat
    table = c(F.lit("<table>"), join(lambda p: c(F.lit("<tr><td>"), p["label"], F.lit("</td><td>"), p["value"], F.lit("</td></tr>"))), F.lit("</table>"))
    dl = c(F.lit("<dl>"), join(lambda p: c(F.lit("<dt>"), p["label"], F.lit("<dd>"), p["value"])), F.lit("</dl>"))
    divs = join(lambda p: c(F.lit('<div class="item-Spec"><b class="row-label">'), p["label"], F.lit('</b><i class="row-value">'), p["value"], F.lit("</i></div>")))
    objects = F.array_join(F.transform("pairs", lambda p: c(F.lit('{"name": "'), p["label"], F.lit('", "value": "'), p["value"], F.lit('"}'))), ",")
    ld = c(F.lit('<script type="application/ld+json">{"x": ['), objects, F.lit("]}</script>"))
    nxt = c(F.lit('<script id="__NEXT_DATA__">{"props": {"specs": ['), objects, F.lit("]}}</script>"))
    k = F.col("page_key")
    body = F.when(k % 5 == 0, table).when(k % 5 == 1, dl).when(k % 5 == 2, divs).when(k % 5 == 3, ld).otherwise(nxt)
    link = F.when(k % 3 == 0, c(F.lit('<a href="/docs/spec-'), k.cast("string"), F.lit('.pdf">Sheet</a>'))).otherwise(F.lit(""))
    status = F.when(k % 11 == 3, 403).when(k % 11 == 5, 404).when(k % 11 == 7, F.lit(None).cast("int")).otherwise(200)
    return paired(spark, sf_dir).select(
        "page_key", c(F.lit("https://shop.example.com/p/"), k.cast("string")).alias("url"), status.alias("status"), F.when(k % 11 == 7, F.lit("timeout")).otherwise(F.lit("")).alias("error"),
        c(F.lit("<html><body><p>Intro<p>More"), body, link, F.lit("</body>")).alias("html"),
    )


def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pdf_url, page_no, text): the pairs of every third page as lines, a document page each, ten blank ones after."""
    rows = pairs(spark, sf_dir).where("page_key % 3 = 0")
    url = F.concat(F.lit("https://shop.example.com/docs/spec-"), F.col("page_key").cast("string"), F.lit(".pdf"))
    return rows.select(url.alias("pdf_url"), (F.col("seq") + 6).cast("int").alias("page_no"), F.concat(F.lit("Sheet\n  "), "label", F.lit(": "), "value", F.lit("  \n")).alias("text"))


def crawl_by_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, error, html) for the links of rows as they are written, with and without a slash."""
    # one evaluation of the pages: both addresses come from a row, not from a union of two
    return html_pages(spark, sf_dir).drop("page_key").withColumn("url", F.explode(F.array("url", F.concat("url", F.lit("/")))))


def recrawl_by_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``crawl_by_link`` as captures: each twice before the run, one that failed before these, and another page after the run."""
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp")
    own = lambda day: F.struct("status", "error", "html", at(day).alias("fetched_at"))
    other = lambda status, html, day: F.struct(F.lit(status).alias("status"), F.lit("").alias("error"), html.alias("html"), at(day).alias("fetched_at"))
    later = F.lit("<table><tr><td>Net dimension (WxHxD)<td>1 2 3</table>")
    captures = F.array(own("2024-05-01"), own("2024-05-01"), other(500, F.col("html"), "2024-04-01"), other(200, later, "2024-07-01"))
    return crawl_by_link(spark, sf_dir).select("url", F.explode(captures).alias("c")).select("url", "c.*")


#: Rows to a sheet of ``csv_sheets``; every so many of them one has no header.
SHEET_ROWS, WITHOUT_HEADER = 100, 5


def csv_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, value): the catalogue as CSV sheets of ``SHEET_ROWS`` rows at most, a text each, with the URL first or last and blank rows at the end."""
    cells = ["brand", "product_group", "subcategory", "sku", "product_name", "link"]
    quoted = lambda names: F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in names))
    number = F.floor(F.col("row_seq") / SHEET_ROWS)
    first = number % 2 == 0
    line = F.when(first, quoted([cells[-1], *cells[:-1]])).otherwise(quoted(cells))
    rows = catalogue(spark, sf_dir).select(number.alias("number"), "row_seq", line.alias("line")).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("row_seq", "line"))).alias("l"))
    titles = ["Brand", "Product Group", "Subcategory", " Model / SKU ", "Product Name"]
    head = F.when(F.col("number") % WITHOUT_HEADER == WITHOUT_HEADER - 1, F.lit("")).when(F.col("number") % 2 == 0, F.lit(",".join(["Shop product url ", *titles]))).otherwise(F.lit(",".join([*titles, "Product URL"])))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("number", F.concat(F.lit('Master catalogue\n"a banner,\nof two lines"\n\n'), head, F.lit("\n"), lines, F.lit("\n\n,,\n")).alias("value"))
