"""Dated URL lists joined to captures as of their fetch time.

A list is a log: at some time a key (a registered domain, a host, or a host with the first part of its
path) is added to it or removed. ``validity`` turns the log into intervals that do not overlap. A capture
meets the entries of its own keys, from the whole host up through its parent domains, that were active when
it was fetched. The most specific active entry decides; of equally specific ones, "deny" does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored


#: Suffixes of two labels and more under which domains are registered. A parameter: give the list that you trust.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.in", "co.kr", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "github.io", "blogspot.com")
#: Longest host name; anything longer is none.
HOST_CHARS = 253


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dots; null if there is none, or if it is too long to be one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:@]+)", 1)
    host = F.rtrim(host, F.lit("."))
    return F.when((host != "") & (F.length(host) <= HOST_CHARS), host)


def is_address(host: Column) -> Column:
    """Whether a host is an IP address, which has no parent domains."""
    return host.rlike(r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$")


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before a suffix, with it: the longest of ``suffixes`` or else the last label. Null for a bare suffix; an address is whole."""
    known = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True))
    found = F.regexp_extract(host, rf"([^.]+\.(?:{known}|[^.]+))$", 1)
    return F.when(is_address(host), host).when(~host.isin(*suffixes), F.nullif(found, F.lit("")))


def keys_of(url: Column) -> Column:
    """Keys of a URL: its host with the first part of its path, its host, and each parent of two labels or more."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    path = F.when(first != "", F.array(F.concat(host, F.lit("/"), first))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(path, F.when(is_address(host), F.array(host)).otherwise(parents))))


def validity(entries: DataFrame) -> DataFrame:
    """(list, verdict, key, valid_from, valid_to) from a log (list, verdict, key, action, dated).

    An entry holds from an "add" to the next row of its list and key, or for ever (null). Of rows with one
    date, a "remove" counts last. Rows with a null key, date or action are left out. Repeated rows make
    empty intervals, which are left out.
    """
    log = entries.where("key IS NOT NULL AND dated IS NOT NULL AND action IN ('add', 'remove')")
    following = F.lead("dated").over(W.partitionBy("list", "key").orderBy("dated", F.col("action") == "remove", "verdict"))
    spans = log.withColumn("valid_to", following).where("action = 'add' AND (valid_to IS NULL OR valid_to > dated)")
    return spans.select("list", "verdict", "key", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, keep: tuple[str, ...] = ("page_id",), url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``keep``, host, n_active, decided_by and blocked for each row of ``captures``.

    n_active: active entries met. decided_by: the key of the most specific one (null: none). blocked: whether
    that entry says "deny". A capture with a null or odd URL or a null fetch time meets no entry. Repeated
    captures each return a row. Empty lists block nothing. Names in ``keep`` win over a result of the same name.
    """
    rows = stored(captures.select(*keep, host_of(F.col(url)).alias("_host"), keys_of(F.col(url)).alias("_keys"), F.col(fetched).alias("_at"), F.monotonically_increasing_id().alias("_row")), "captures")
    spans = stored(validity(entries), "list-intervals").select(F.col("key").alias("_key"), "verdict", "valid_from", "valid_to")
    wanted = rows.select("_row", "_at", F.explode("_keys").alias("_key"))
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    met = wanted.join(spans, "_key").where(active)
    rank = F.struct(F.length("_key").alias("length"), (F.col("verdict") == "deny").alias("deny"), F.col("_key").alias("key"))
    decided = met.groupBy("_row").agg(F.count("*").alias("_n"), F.max(rank).alias("_top"))
    told = {"host": F.col("_host"), "n_active": F.coalesce("_n", F.lit(0)).cast("long"), "decided_by": F.col("_top.key"), "blocked": F.coalesce("_top.deny", F.lit(False))}
    return rows.join(decided, "_row", "left").select(*keep, *(c.alias(name) for name, c in told.items() if name not in keep))


# Captures and lists for the query, from the table of pages -------------------------------------------------


def captures(pages: DataFrame) -> DataFrame:
    """Pages with the fetch time of the query: a minute of 2024 that follows from page_id."""
    minute = F.pmod(F.col("page_id") * 2221, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("fetched_at"))


#: In the given tables sites are registered under these.
PAGE_SUFFIXES = ("example.com", "example.net", "example.org")


def derived_lists(pages: DataFrame) -> DataFrame:
    """A log for the query: registered domains, hosts and hosts with a path of the pages, added and removed on days of 2024."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.get(keys_of(F.col("url")), F.lit(0)).alias("path")).where("host IS NOT NULL").distinct()
    hosts = seen.select("host").distinct()
    domains = hosts.select(registered_domain(F.col("host"), PAGE_SUFFIXES).alias("key")).where("key IS NOT NULL").distinct()
    number = lambda key: F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long")
    day = lambda n, shift: F.timestamp_seconds(F.lit(1_704_067_200) + (F.pmod(n, F.lit(300)) + shift) * 86_400)
    numbered = lambda df: df.withColumn("h", number(F.col("key")))
    of = numbered(domains)
    known_bad = F.col("key").rlike("spam|pills|casino")
    log = lambda df, name, verdict, action, shift: df.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), "key", F.lit(action).alias("action"), day(F.col("h"), shift).alias("dated"))
    dated = log(of.where("h % 4 = 0"), "spam", "deny", "add", 0)
    dated = dated.unionByName(log(of.where("h % 8 = 0"), "spam", "deny", "remove", 60))
    dated = dated.unionByName(log(of.where("h % 16 = 0"), "spam", "deny", "add", 120))
    always = of.where(known_bad).select(F.lit("known").alias("list"), F.lit("deny").alias("verdict"), "key", F.lit("add").alias("action"), F.timestamp_seconds(F.lit(1_704_067_200)).alias("dated"))
    blogs = numbered(hosts.where("host LIKE 'blog.%'").select(F.col("host").alias("key"))).where("h % 3 = 0")
    paths = numbered(seen.where("path <> host").select(F.col("path").alias("key"))).where("h % 5 = 0")
    return dated.unionByName(always).unionByName(log(blogs, "trusted", "allow", "add", 30)).unionByName(log(paths, "paths", "deny", "add", 10))


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url,
                  nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') AS host,
                  (page_id * 2221) % 525600 AS mins FROM pages),
hosts AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.(?:example\.com|example\.net|example\.org|[^.]+))$', 1) AS key FROM hosts
            WHERE host NOT IN ('example.com', 'example.net', 'example.org') AND NOT regexp_matches(host, '^[0-9]+(\.[0-9]+){3}$')),
dn AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h FROM domains WHERE key <> ''),
bn AS (SELECT host AS key, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM hosts WHERE host LIKE 'blog.%'),
sn AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT host || '/' || seg AS key FROM (
        SELECT host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM p WHERE host IS NOT NULL) WHERE seg <> '')),
log AS (SELECT 'spam' AS list, 'deny' AS verdict, key, 'add' AS action, (h % 300) * 1440 AS dated FROM dn WHERE h % 4 = 0
        UNION ALL SELECT 'spam', 'deny', key, 'remove', (h % 300 + 60) * 1440 FROM dn WHERE h % 8 = 0
        UNION ALL SELECT 'spam', 'deny', key, 'add', (h % 300 + 120) * 1440 FROM dn WHERE h % 16 = 0
        UNION ALL SELECT 'known', 'deny', key, 'add', 0 FROM dn WHERE regexp_matches(key, 'spam|pills|casino')
        UNION ALL SELECT 'trusted', 'allow', key, 'add', (h % 300 + 30) * 1440 FROM bn WHERE h % 3 = 0
        UNION ALL SELECT 'paths', 'deny', key, 'add', (h % 300 + 10) * 1440 FROM sn WHERE h % 5 = 0),
spans AS (SELECT *, lead(dated) OVER (PARTITION BY list, key ORDER BY dated, action = 'remove') AS until FROM log),
l AS (SELECT r, mins, host, string_split(host, '.') AS ls, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM p WHERE host IS NOT NULL),
k AS (SELECT DISTINCT r, mins, key FROM (
        SELECT r, mins, array_to_string(ls[i:], '.') AS key FROM (SELECT r, mins, ls, unnest(range(1, greatest(len(ls) - 1, 1) + 1)) AS i FROM l)
        UNION ALL SELECT r, mins, host || '/' || seg FROM l WHERE seg <> '')),
m AS (SELECT k.r, k.key, s.verdict FROM k JOIN spans s ON k.key = s.key AND s.action = 'add' AND k.mins >= s.dated AND (s.until IS NULL OR k.mins < s.until)),
o AS (SELECT r, key, verdict, count(*) OVER (PARTITION BY r) AS n,
             row_number() OVER (PARTITION BY r ORDER BY length(key) DESC, verdict = 'deny' DESC, key DESC) AS q FROM m)
SELECT p.page_id, p.host, CAST(coalesce(o.n, 0) AS BIGINT) AS n_active, o.key AS decided_by, coalesce(o.verdict = 'deny', false) AS blocked
FROM p LEFT JOIN o ON p.r = o.r AND o.q = 1
"""
