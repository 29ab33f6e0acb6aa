"""DuckDB SQL for the registered queries, written apart from the Spark expressions.

Rules are a table of values here and joined; the Spark side compiles them. Pairs are grouped in long form here;
the Spark side folds arrays. ``BASE`` holds the common tables; a query takes those that it names.
"""

from __future__ import annotations

from stockroom.functions import fixed_values as V
from stockroom.plans import derive


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "CAST([" + ", ".join(map(_text, items)) + "] AS VARCHAR[])"


_RULES = ", ".join(f"({i}, {_text(g)}, {_list(t)}, {_text(s)}, {_text(b)})" for i, (g, t, s, b) in enumerate(V.RULES))
_OVERRIDES = ", ".join(f"({i}, {j}, {_text(g)}, {_list(t)}, {_list(k)}, {_text(s)}, {_text(b)})" for i, (g, t, rules) in enumerate(V.OVERRIDES) for j, (_, k, s, b) in enumerate(rules))
_SHEETS = ", ".join(f"({i}, {_text(s)})" for i, s in enumerate(V.SHEETS, 1))
_ANY = "len(list_filter({terms}, lambda t: contains(lower({text}), lower(t)))) > 0"
_BLOCK = "CASE WHEN block = '__USE_SUBCATEGORY__' THEN CASE WHEN trim(subcategory) = '' THEN 'Uncategorised' ELSE trim(subcategory) END ELSE block END"

_RE = {
    "dim": r"(?i)\b(net\s+dimension|gross\s+dimension|overall\s+dimension|product\s+dimension|unit\s+dimension|dimension|width|height|depth)\b",
    "cavity": r"(?i)\b(cutout|cut[\s-]out|cavity|recess|installation|opening)\b",
    "overall": r"(?i)\b(net|overall|total|product|unit|external|outer)\b",
    "axes": r"([WHDwhd])\s*[×xX*]\s*([WHDwhd])\s*[×xX*]\s*([WHDwhd])",
}
_MM = r"CASE WHEN unit = 'cm' THEN array_to_string(list_transform(string_split_regex({n}, '\s*[-–]\s*'), lambda p: CAST(CAST(p AS BIGINT) * 10 AS VARCHAR)), '-') ELSE trim({n}) END"


def _unit(of: str) -> str:
    return f"nullif(lower(regexp_extract({of}, '(?i)\\((mm|cm|m)\\)', 1)), '')"


_WORDS = [("width", "W"), ("w", "W"), ("height", "H"), ("h", "H"), ("depth", "D"), ("d", "D")]


def _resolved(name: str, source: str, key: str, *, words: bool = False, skip: str = "cav AND NOT ovl", told: str = "cav AND NOT ovl") -> str:
    """Tables <name>_r with h, w, d, conflict, raw_text, confidence, reason by key from rows (key, seq, label, value).

    ``words``: an axis is named by a whole word; ``skip``: the labels that don't count; ``told``: those of them that raw_text ends with.
    """
    axis = "CASE WHEN contains(l, 'width') THEN 'W' WHEN contains(l, 'w') THEN 'W' WHEN contains(l, 'height') THEN 'H' WHEN contains(l, 'h') THEN 'H' WHEN contains(l, 'depth') THEN 'D' WHEN contains(l, 'd') THEN 'D' END"
    if words:
        axis = "CASE " + " ".join(f"WHEN regexp_matches(l, '\\b{w}\\b') THEN '{a}'" for w, a in _WORDS) + " END"
    return f"""
{name}_d AS (SELECT {key}, seq, label, value, lower(label) AS l, regexp_matches(label, '{_RE["cavity"]}') AS cav, regexp_matches(label, '{_RE["overall"]}') AS ovl,
    coalesce({_unit("label")}, {_unit("value")}, 'mm') AS unit, regexp_extract_all(replace(value, ',', ''), '\\d+(?:\\s*[-–]\\s*\\d+)?', 0) AS ns,
    row_number() OVER (PARTITION BY {key} ORDER BY seq) AS line,
    upper(regexp_extract(label, '{_RE["axes"]}', 1)) AS a1, upper(regexp_extract(label, '{_RE["axes"]}', 2)) AS a2, upper(regexp_extract(label, '{_RE["axes"]}', 3)) AS a3
    FROM {source} WHERE regexp_matches(label, '{_RE["dim"]}')),
{name}_u AS (SELECT *, row_number() OVER (PARTITION BY {key}, cav AND NOT ovl ORDER BY seq) AS skip FROM {name}_d),
{name}_v AS (SELECT {key}, seq * 4 AS place, {axis} AS axis, {_MM.format(n="ns[1]")} AS v FROM {name}_u WHERE NOT ({skip}) AND a1 = '' AND len(ns) > 0
    UNION ALL SELECT {key}, seq * 4, a1, {_MM.format(n="ns[1]")} FROM {name}_u WHERE NOT ({skip}) AND a1 <> '' AND len(ns) >= 3 AND a1 <> a2 AND a1 <> a3
    UNION ALL SELECT {key}, seq * 4 + 1, a2, {_MM.format(n="ns[2]")} FROM {name}_u WHERE NOT ({skip}) AND a1 <> '' AND len(ns) >= 3 AND a2 <> a3
    UNION ALL SELECT {key}, seq * 4 + 2, a3, {_MM.format(n="ns[3]")} FROM {name}_u WHERE NOT ({skip}) AND a1 <> '' AND len(ns) >= 3),
{name}_a AS (SELECT {key}, axis, arg_min(v, place) AS v, count(DISTINCT v) > 1 AS differs FROM {name}_v WHERE axis IS NOT NULL GROUP BY ALL),
{name}_p AS (SELECT {key}, max(CASE WHEN axis = 'H' THEN v END) AS h, max(CASE WHEN axis = 'W' THEN v END) AS w, max(CASE WHEN axis = 'D' THEN v END) AS d, bool_or(differs) AS conflict FROM {name}_a GROUP BY {key}),
{name}_t AS (SELECT {key}, string_agg(CASE WHEN line <= 12 THEN label || ': ' || value END, chr(10) ORDER BY seq)
      || coalesce(chr(10) || '[Cavity dims skipped]: ' || string_agg(CASE WHEN {told} AND skip <= 4 THEN label || ': ' || value END, '; ' ORDER BY seq), '') AS raw_text FROM {name}_u GROUP BY {key}),
{name}_r AS (SELECT t.{key}, h, w, d, coalesce(conflict, false) AS conflict, raw_text,
    CASE WHEN conflict THEN 'Needs Review' WHEN h IS NOT NULL AND w IS NOT NULL AND d IS NOT NULL THEN 'Resolved' WHEN h IS NOT NULL OR w IS NOT NULL OR d IS NOT NULL THEN 'Needs Review' ELSE 'Not Found' END AS confidence,
    CASE WHEN conflict THEN 'Conflicting dimension values found on page' WHEN h IS NOT NULL AND w IS NOT NULL AND d IS NOT NULL THEN ''
         WHEN h IS NOT NULL OR w IS NOT NULL OR d IS NOT NULL THEN 'Partial dimensions found: H=' || coalesce(h, 'None') || ' W=' || coalesce(w, 'None') || ' D=' || coalesce(d, 'None') ELSE '' END AS reason
    FROM {name}_t t LEFT JOIN {name}_p p ON t.{key} = p.{key})"""


BASE = f"""
cat AS ({derive.CATALOGUE}),
rules(rule_ord, grp, terms, sheet, block) AS (VALUES {_RULES}),
ovr(ovr_ord, rule_ord, grp, triggers, keywords, sheet, block) AS (VALUES {_OVERRIDES}),
sheets(sheet_ord, sheet) AS (VALUES {_SHEETS}),
ruled AS (SELECT row_seq, arg_min(r.sheet, rule_ord) AS sheet, arg_min({_BLOCK}, rule_ord) AS block FROM cat JOIN rules r ON lower(trim(product_group)) = lower(r.grp)
    WHERE len(terms) = 0 OR {_ANY.format(terms="terms", text="trim(subcategory)")} GROUP BY row_seq),
ovrd AS (SELECT row_seq, arg_min(o.sheet, ovr_ord * 1000 + rule_ord) AS sheet, arg_min({_BLOCK}, ovr_ord * 1000 + rule_ord) AS block FROM cat JOIN ovr o ON o.grp = '' OR lower(trim(product_group)) = lower(o.grp)
    WHERE (len(triggers) = 0 OR {_ANY.format(terms="triggers", text="trim(subcategory)")}) AND {_ANY.format(terms="keywords", text="product_name || ' ' || sku")} GROUP BY row_seq),
cls AS (SELECT cat.*, coalesce(o.sheet, r.sheet) AS sheet, coalesce(o.block, r.block) AS block,
    CASE WHEN coalesce(o.sheet, r.sheet) IS NOT NULL THEN NULL WHEN trim(product_group) = '' THEN 'Missing Product Group'
         WHEN lower(trim(product_group)) NOT IN (SELECT lower(grp) FROM rules) THEN 'No M10 sheet for Product Group ''' || trim(product_group) || ''''
         ELSE 'No mapping for subcategory ''' || trim(subcategory) || ''' in Product Group ''' || trim(product_group) || '''' END AS reason
    FROM cat LEFT JOIN ovrd o ON cat.row_seq = o.row_seq LEFT JOIN ruled r ON cat.row_seq = r.row_seq),
map AS (SELECT sheet, block, row_seq, brand AS "Brand", sku AS "Product", '' AS "Height", '' AS "Width", '' AS "Depth", link AS "Link" FROM cls WHERE sheet IS NOT NULL),
blocks AS (SELECT sheet, block, count(*) AS n, min(row_seq) AS first_seq, row_number() OVER (PARTITION BY sheet ORDER BY min(row_seq)) AS block_ord FROM map GROUP BY sheet, block),
starts AS (SELECT *, CAST(1 + coalesce(sum(n + 3) OVER (PARTITION BY sheet ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM blocks),
pos AS (SELECT m.*, CAST(s.start + 1 + row_number() OVER (PARTITION BY m.sheet, m.block ORDER BY m.row_seq) AS BIGINT) AS row_idx FROM map m JOIN starts s ON m.sheet = s.sheet AND m.block = s.block),
grid AS (SELECT sheet, start AS row_idx, block AS c1, '' AS c2, '' AS c3, '' AS c4, '' AS c5, '' AS c6, '' AS c7, '' AS c8 FROM starts
    UNION ALL SELECT sheet, start + 1, 'Brand', 'Product', 'Height', 'Width', 'Depth', 'Link', '', '' FROM starts
    UNION ALL SELECT sheet, row_idx, "Brand", "Product", '', '', '', "Link", '', '' FROM pos
    UNION ALL SELECT sheet, start + n + 2, '', '', '', '', '', '', '', '' FROM starts WHERE block_ord < (SELECT max(block_ord) FROM starts s WHERE s.sheet = starts.sheet)),
todo AS (SELECT p.sheet, row_idx, trim("Brand") AS brand, "Product" AS sku, "Link" AS link, rtrim(trim("Link"), '/') AS url_key, s.sheet_ord * 1000000000000 + row_idx AS ord
    FROM pos p JOIN sheets s ON p.sheet = s.sheet WHERE "Product" <> ''),
clog AS ({derive.CACHE_LOG}),
cache AS (SELECT url_key, arg_max(height, ord) AS height, arg_max(width, ord) AS width, arg_max(depth, ord) AS depth, arg_max(confidence, ord) AS confidence, arg_max(source_url, ord) AS source_url,
    arg_max(raw_text, ord) AS raw_text, arg_max(reason, ord) AS reason, max(fetched_at) AS fetched_at
    FROM (SELECT c.* FROM clog c JOIN (SELECT url_key, max(fetched_at) AS latest FROM clog GROUP BY url_key) x ON c.url_key = x.url_key AND c.fetched_at = x.latest) GROUP BY url_key),
work AS (SELECT url_key, min(ord) AS ord, arg_min(brand, ord) AS brand, arg_min(link, ord) AS link FROM todo WHERE link <> '' AND url_key NOT IN (SELECT url_key FROM cache) GROUP BY url_key),
forced AS (SELECT url_key, ord, brand, link FROM todo WHERE link <> '' AND url_key NOT IN (SELECT url_key FROM cache WHERE confidence = 'Resolved')),
pairs AS ({derive.PAIRS}),
{_resolved("web", "pairs", "page_key")},
docs AS (SELECT * FROM pairs WHERE page_key % 3 = 0 AND seq + 6 <= 8),
{_resolved("doc", "docs", "page_key")},
crawled AS (SELECT DISTINCT page_key, CASE WHEN page_key % 11 = 7 THEN 'timeout' WHEN page_key % 11 = 3 THEN 'access refused (HTTP 403)' WHEN page_key % 11 = 5 THEN 'HTTP 404' END AS outcome FROM pairs),
page AS (SELECT c.page_key, c.outcome,
    CASE WHEN c.outcome IS NOT NULL THEN 'fail' WHEN w.confidence = 'Resolved' THEN 'web' WHEN d.confidence IN ('Resolved', 'Needs Review') THEN 'doc' WHEN w.page_key IS NOT NULL THEN 'web' ELSE 'none' END AS took,
    w.h AS wh, w.w AS ww, w.d AS wd, w.confidence AS wc, w.raw_text AS wt, w.reason AS wr, d.h AS dh, d.w AS dw, d.d AS dd, d.confidence AS dc, d.raw_text AS dt, d.reason AS dr
    FROM crawled c LEFT JOIN web_r w ON c.page_key = w.page_key LEFT JOIN doc_r d ON c.page_key = d.page_key),
dims AS (SELECT page_key, took, CASE took WHEN 'web' THEN wh WHEN 'doc' THEN dh END AS height, CASE took WHEN 'web' THEN ww WHEN 'doc' THEN dw END AS width, CASE took WHEN 'web' THEN wd WHEN 'doc' THEN dd END AS depth,
    CASE took WHEN 'web' THEN wc WHEN 'doc' THEN dc ELSE 'Not Found' END AS confidence, CASE took WHEN 'web' THEN wt WHEN 'doc' THEN dt ELSE '' END AS raw_text,
    CASE took WHEN 'web' THEN wr WHEN 'doc' THEN dr WHEN 'fail' THEN outcome ELSE 'No dimension data found on page or linked PDFs' END AS reason FROM page),
own AS (SELECT k.url_key, k.ord, k.link, lower(trim(k.brand)) AS b, k.brand, d.* FROM work k LEFT JOIN dims d ON k.url_key = 'https://shop.example.com/p/' || CAST(d.page_key AS VARCHAR)),
owned AS (SELECT url_key, ord, CASE WHEN b = 'lg' THEN height END AS height, CASE WHEN b = 'lg' THEN width END AS width, CASE WHEN b = 'lg' THEN depth END AS depth,
    CASE WHEN b = 'lg' THEN coalesce(confidence, 'Not Found') ELSE 'Not Found' END AS confidence,
    CASE WHEN b = 'lg' AND took = 'doc' THEN 'https://shop.example.com/docs/spec-' || CAST(page_key AS VARCHAR) || '.pdf' ELSE link END AS source_url, CASE WHEN b = 'lg' THEN coalesce(raw_text, '') ELSE '' END AS raw_text,
    CASE WHEN b = 'lg' THEN coalesce(reason, 'fetch failed') WHEN b IN ('bosch', 'samsung') THEN 'Adapter not yet implemented' ELSE 'No adapter implemented for brand ''' || brand || '''' END AS reason FROM own),
res AS (SELECT t.sheet, t.row_idx, t.brand, t.sku, t.link, t.ord,
    CASE WHEN c.url_key IS NOT NULL THEN nullif(c.height, '') ELSE o.height END AS height, CASE WHEN c.url_key IS NOT NULL THEN nullif(c.width, '') ELSE o.width END AS width,
    CASE WHEN c.url_key IS NOT NULL THEN nullif(c.depth, '') ELSE o.depth END AS depth,
    CASE WHEN t.link = '' THEN 'Not Found' ELSE coalesce(c.confidence, o.confidence) END AS confidence, CASE WHEN t.link = '' THEN '' ELSE coalesce(c.source_url, o.source_url) END AS source_url,
    CASE WHEN t.link = '' THEN '' ELSE coalesce(c.raw_text, o.raw_text) END AS raw_text, CASE WHEN t.link = '' THEN 'No product URL available' ELSE coalesce(c.reason, o.reason) END AS reason
    FROM todo t LEFT JOIN cache c ON t.link <> '' AND t.url_key = c.url_key LEFT JOIN owned o ON t.link <> '' AND t.url_key = o.url_key)
"""


def oracle(select: str) -> str:
    """A query over the common tables."""
    return f"WITH {BASE}\n{select}"


def word_oracle(select: str) -> str:
    """A query over the pairs resolved by whole words: word_r."""
    return f"WITH pairs AS ({derive.PAIRS}), {_resolved('word', 'pairs', 'page_key', words=True)}\n{select}"


def cavity_oracle(select: str) -> str:
    """A query over the pairs of cavities: cav_r."""
    return f"WITH pairs AS ({derive.PAIRS}), {_resolved('cav', 'pairs', 'page_key', skip='ovl AND NOT cav', told='false')}\n{select}"
