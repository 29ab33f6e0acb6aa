"""Dimensions for rows that lack them: cache, crawled pages, linked documents, and the results written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V
from stockroom.functions.clean import brand_key
from stockroom.functions.dimensions import dimension_result, is_dim_label, pairs_from_text
from stockroom.operators.cache import fetch_worklist, has_link, held_for, new_cache_rows, one_result, replay_results, upsert_cache
from stockroom.operators.pages import pairs_from_html
from stockroom.sources.shared import SMALL_ROWS, dealt, stored

RESULT_TYPE = "struct<height:string,width:string,depth:string,confidence:string,source_url:string,raw_text:string,reason:string>"


def not_found(reason: Column, source_url: Column) -> Column:
    """A result without dimensions."""
    none = F.lit(None).cast("string")
    return F.struct(none.alias("height"), none.alias("width"), none.alias("depth"), F.lit(V.NOT_FOUND).alias("confidence"), source_url.alias("source_url"), F.lit("").alias("raw_text"), reason.alias("reason"))


def fetch_outcome(status: Column, error: Column) -> Column:
    """Why a page could not be had; null if it was."""
    code = status.cast("string")
    return (
        F.when(error == "timeout", F.lit("timeout"))
        .when(error != "", F.concat(F.lit("request error: "), error))
        .when(status.isin(403, 429), F.concat(F.lit("access refused (HTTP "), code, F.lit(")")))
        .when(status >= 400, F.concat(F.lit("HTTP "), code))
        .when(status.isNull(), F.lit(V.FETCH_FAILED))
    )


def latest_captures(crawl: DataFrame, as_of: Column | None = None, *, good_first: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, url, outcome, html): of each URL's captures the last one at or before ``as_of``, or the last one of all.

    ``crawl``: url, status, error, html, and fetched_at if there are several runs; captures without a time come before all others.
    Of captures of one moment one that succeeded is taken before one that failed; what is still even, by content, so that equal captures are one.
    ``by``: columns that tell what a capture is of where that isn't its URL alone; each is a URL of its own then.
    ``good_first``: an earlier success is taken before a later failure. A partial aggregate: a URL captured a million times is no hot key.
    """
    at = F.col("fetched_at").cast("timestamp") if "fetched_at" in crawl.columns else F.lit(None).cast("timestamp")
    taken = crawl.select(*by, "url", fetch_outcome(F.col("status"), F.col("error")).alias("outcome"), "html", at.alias("_at"))
    if as_of is not None:
        taken = taken.where(F.col("_at").isNull() | (F.col("_at") <= as_of))
    good = F.col("outcome").isNull()
    order = F.struct(*([good.alias("kept")] if good_first else []), F.col("_at").alias("at"), good.alias("good"), F.coalesce("outcome", F.lit("")).alias("why"), F.length("html").alias("n"), F.xxhash64("html").alias("content"))
    return taken.groupBy(*by, "url").agg(F.max_by(F.struct("outcome", "html"), order).alias("c")).select(*by, "url", "c.*")


#: Links whose hashes may be broadcast, 8 bytes each.
HASHED_ROWS = 1_000_000


def asked_for(crawl: DataFrame, links: DataFrame) -> DataFrame:
    """The captures of some links (url), and few others: by the links, or by their hashes where they are too many; all beyond ``HASHED_ROWS``."""
    wanted = links.distinct()
    n = wanted.limit(HASHED_ROWS + 1).count()
    if n <= SMALL_ROWS:
        return crawl.join(F.broadcast(wanted), "url", "left_semi")
    if n <= HASHED_ROWS:
        hashes = links.select(F.xxhash64("url").alias("_hash")).distinct()
        return crawl.withColumn("_hash", F.xxhash64("url")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return crawl


def attach_pages(worklist: DataFrame, crawl: DataFrame, as_of: Column | None = None, *, good_first: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The work list with outcome and html of each link, a row for each of its rows; a link that wasn't crawled has failed.

    ``crawl``, ``as_of``, ``good_first`` and ``by`` (columns of both that are joined beside the link): as of ``latest_captures``. Where the links or their hashes are few enough to broadcast
    (``asked_for``), captures that nobody asked for stay at the scan. Beyond that all are compared, as far as possible before they are shuffled, and joined by that
    same key: a page is shuffled once. The work list, few bytes to much work, is dealt out first: where its pages are broadcast, its tasks are those that parse them.
    """
    worklist = dealt(worklist)
    crawled = latest_captures(asked_for(crawl, worklist.select(F.col("link").alias("url"))), as_of, good_first=good_first, by=by).select(*by, F.col("url").alias("link"), F.col("outcome").alias("_outcome"), "html", F.lit(True).alias("_seen"))
    seen = F.coalesce("_seen", F.lit(False))
    return worklist.join(crawled, [*by, "link"], "left").select(*worklist.columns, "html", "_outcome", "_seen").withColumn("outcome", F.when(seen, F.col("_outcome")).otherwise(F.lit(V.FETCH_FAILED))).drop("_outcome", "_seen")


def route_brand(rows: DataFrame, brand: str = "brand", link: str = "link") -> DataFrame:
    """Adds parser (the brand's key, or null) and routed: the result of rows without a parser."""
    key = brand_key(F.col(brand))
    before, after = V.NO_PARSER.split("{brand}")
    awaited = not_found(F.lit(V.NO_PARSER_YET), F.col(link))
    unknown = not_found(F.concat(F.lit(before), F.coalesce(brand, F.lit("")), F.lit(after)), F.col(link))
    parsed = key.isin(V.PARSED_BRANDS)
    return rows.withColumns({"parser": F.when(parsed, key), "routed": F.when(parsed, F.lit(None).cast(RESULT_TYPE)).when(key.isin(V.AWAITED_BRANDS), awaited).otherwise(unknown)})


def doc_text(pdf_text: DataFrame, pages: int = V.DOCUMENT_PAGES) -> DataFrame:
    """(pdf_url, text): the first pages of each document, joined by newlines."""
    first = pdf_text.where(F.col("page_no") <= pages).groupBy("pdf_url").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return first.select("pdf_url", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def dim_pairs(pairs: Column) -> Column:
    """The pairs whose label is about dimensions."""
    return F.filter(pairs, lambda p: is_dim_label(p["label"]))


def pick_result(page: Column, n_page_pairs: Column, pdf: Column, url: Column) -> Column:
    """The page's result if resolved, else a document's that found something, else the page's, else none."""
    nothing = not_found(F.lit(V.NOTHING_FOUND), url)
    usable = pdf["confidence"].isin(V.RESOLVED, V.NEEDS_REVIEW)
    return F.when((n_page_pairs > 0) & (page["confidence"] == V.RESOLVED), page).when(usable, pdf).when(n_page_pairs > 0, page).otherwise(nothing)


def page_dimensions(attached: DataFrame, pdf_text: DataFrame, convention: str = "overall", match: str = "substring") -> DataFrame:
    """Adds result to rows with link, outcome and html. Documents are read only for pages not resolved.

    Pages are joined and parsed once: what they say is stored, and then asked for the documents that it needs and for results.
    """
    kept = [c for c in attached.columns if c != "html"]
    fetched = attached.withColumn("html", F.when(F.col("outcome").isNull(), F.col("html")))
    parsed = stored(pairs_from_html(fetched, "html", "link").select(*kept, dim_pairs(F.col("pairs")).alias("_pairs"), "pdf_url"), "page-pairs", batch_rows=2000, dear=True)
    paged = parsed.withColumn("_page", dimension_result(F.col("_pairs"), F.col("link"), convention, match))
    open_ = (F.size("_pairs") == 0) | (F.col("_page.confidence") != V.RESOLVED)
    wanted = stored(paged.withColumn("_pdf", F.when(open_, F.col("pdf_url"))).drop("pdf_url"), "page-results")
    # documents that some open page links to, each resolved once
    needed = wanted.where("_pdf IS NOT NULL").select(F.col("_pdf").alias("pdf_url")).distinct()
    texts = doc_text(pdf_text.join(needed, "pdf_url", "left_semi")).withColumn("_doc", dim_pairs(pairs_from_text(F.col("text"))))
    read = texts.where(F.size("_doc") > 0).select(F.col("pdf_url").alias("_pdf"), dimension_result(F.col("_doc"), F.col("pdf_url"), convention, match).alias("_read"))
    picked = pick_result(F.col("_page"), F.size("_pairs"), F.col("_read"), F.col("link"))
    result = F.when(F.col("outcome").isNull(), picked).otherwise(not_found(F.col("outcome"), F.col("link")))
    return wanted.join(read, "_pdf", "left").select(*kept, result.alias("result"))


Parser = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def page_parsers(as_of: Column | None = None, convention: str = "overall", match: str = "substring") -> dict[str, Parser]:
    """The page job for each brand that has one, with its options."""
    return {b: lambda rows, crawl, texts: page_dimensions(attach_pages(rows, crawl, as_of), texts, convention, match) for b in V.PARSED_BRANDS}


def fetch_results(worklist: DataFrame, crawl: DataFrame, pdf_text: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(url_key, ord, result) of a work list, routed by brand. ``parsers``: brand key to (rows, crawl, documents) -> rows with result."""
    parsers = page_parsers() if parsers is None else parsers
    routed = route_brand(worklist)
    out = routed.where("parser IS NULL").select("url_key", "ord", F.col("routed").alias("result"))
    for key, parse in parsers.items():
        rows = routed.where(F.col("parser") == key).select("url_key", "ord", "brand", "link")
        out = out.unionByName(parse(rows, crawl, pdf_text).select("url_key", "ord", "result"))
    return out


def enrich(rows: DataFrame, cache: DataFrame, crawl: DataFrame, pdf_text: DataFrame, fetched_at: Column, force: bool = False, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, new cache) of rows to enrich. Results: the rows, each once, with height ... reason; a null link comes out empty.

    ``crawl`` may hold several captures of a URL: the last at or before ``fetched_at``, the time of the run, counts. ``parsers`` replaces
    the page jobs, and with them that choice. The rows, the work list and its results are stored: each is used more than once, and
    none is computed again.
    """
    rows = stored(rows.withColumn("link", F.coalesce("link", F.lit(""))), "rows-to-enrich")
    asked = held_for(rows, cache)
    work = stored(fetch_worklist(rows, asked, force), "work-list")
    own = stored(one_result(fetch_results(work, crawl, pdf_text, page_parsers(fetched_at) if parsers is None else parsers)), "own-results")
    replayed = replay_results(rows, own, asked, force).select(*rows.columns, "result")
    linkless = rows.where(~has_link(F.col("link"))).withColumn("result", not_found(F.lit(V.NO_URL), F.lit("")))
    results = replayed.unionByName(linkless).select(*rows.columns, "result.*")
    return results, upsert_cache(cache, new_cache_rows(own, fetched_at))


def needs_review(confidence: Column) -> Column:
    """Whether a row is to be highlighted."""
    return confidence != V.RESOLVED


def apply_results(grid: DataFrame, results: DataFrame) -> DataFrame:
    """The listing with dimensions, confidence and source written to the rows that have a result."""
    r = results.select("sheet", "row_idx", "height", "width", "depth", "confidence", "source_url", F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    both = grid.join(r, ["sheet", "row_idx"], "left")
    head = (F.btrim("c1") == "Brand") & (F.btrim("c2") == "Product")
    cells = {f"c{i}": F.when(hit, F.col(c)).otherwise(F.col(f"c{i}")) for i, c in ((3, "height"), (4, "width"), (5, "depth"), (7, "confidence"), (8, "source_url"))}
    for i, title in zip((7, 8), V.RESULT_HEADERS):
        cells[f"c{i}"] = F.when(head & (F.coalesce(f"c{7}", F.lit("")) == ""), F.lit(title)).otherwise(cells[f"c{i}"])
    return both.withColumns(cells).select("sheet", "row_idx", *(f"c{i}" for i in range(1, 9)))

