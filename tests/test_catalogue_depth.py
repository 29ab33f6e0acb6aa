"""Crawls with several captures, page parsing, large numbers, many rules, sparse row numbers, and the log-structured cache."""

import random
import re
import threading
import time
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockroom.functions import clean
from stockroom.operators import cache, enrich, layout, pages, rules
from stockroom.plans import derive, inputs, queries
from stockroom.sources import catalogue, shared
from stockroom.streaming import log_cache, streams

SF = "/root/testdata/sf0.001"
TODO = "sheet string, row_idx int, brand string, sku string, link string, ord long"
CATALOGUE = "row_seq long, source_file string, brand string, product_group string, subcategory string, product_name string, sku string, link string"
CRAWL = "url string, status int, error string, html string, fetched_at string"


def rows(df):
    return [tuple(r) for r in df.collect()]


# captures and links -----------------------------------------------------------------------------------------


def test_one_capture_of_each_url_as_of_the_run(spark):
    ok, bad = "<table><tr><td>Net dimension (WxHxD)<td>{} 2 3</table>", None
    given = [
        ("a", 200, "", ok.format(1), "2024-01-01"), ("a", 404, "", bad, "2024-01-02"), ("a", 200, "", ok.format(9), "2024-03-01"),  # the last before the run failed
        ("b", 500, "", bad, "2024-01-02"), ("b", 200, "", ok.format(2), "2024-01-02"), ("b", 200, "", ok.format(2), "2024-01-02"),  # a retry of the same moment
        ("c", 200, "", ok.format(3), "2024-02-02"), ("d", None, "timeout", bad, None), ("e", 200, "", ok.format(4), None), ("f", 200, "", None, "2024-01-01"),
    ]
    crawl = spark.createDataFrame(given, CRAWL).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    work = spark.createDataFrame([(u,) for u in "aabbcdefz"], "link string")
    now = F.lit("2024-02-01").cast("timestamp")
    got = rows(enrich.attach_pages(work, crawl, now).select("link", "outcome", F.regexp_extract("html", r">(\d) 2", 1)))
    assert Counter(got) == Counter({("a", "HTTP 404", None): 2, ("b", None, "2"): 2, ("c", "fetch failed", None): 1, ("d", "timeout", None): 1, ("e", None, "4"): 1, ("f", None, None): 1, ("z", "fetch failed", None): 1})
    assert ("a", None, "1") in rows(enrich.attach_pages(work, crawl, now, good_first=True).select("link", "outcome", F.regexp_extract("html", r">(\d) 2", 1)))
    assert ("a", None, "9") in rows(enrich.attach_pages(work, crawl).select("link", "outcome", F.regexp_extract("html", r">(\d) 2", 1)))


@pytest.mark.parametrize("force", [False, True])
def test_enriched_rows_are_the_rows_given(spark, force):
    rng = random.Random(11)
    links = [None, "", " ", "https://h/1", "https://h/1/", "https://h/2", "https://h/3", "https://h/4//"]
    given = [("s", i, rng.choice(["LG", "lg ", "Bosch", "Odd", None]), f"k{i}", rng.choice(links), i) for i in range(60)]
    crawl = [(rng.choice(links[3:]), rng.choice([200, 200, 404, None]), rng.choice(["", "timeout"]), rng.choice([None, "<dl><dt>Width<dd>5</dl>", "<table><tr><td>Net dimension (WxHxD)<td>1 2 3</table>"]), rng.choice([None, "2024-01-01", "2024-01-05", "2025-01-01"])) for _ in range(80)]
    todo = spark.createDataFrame(given, TODO)
    pages_ = spark.createDataFrame(crawl, CRAWL).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    texts = spark.createDataFrame([], "pdf_url string, page_no int, text string")
    held = spark.createDataFrame([("https://h/3", "1", "2", "3", "Resolved", "s", "t", "r", None), ("https://h/4", "", None, "", "Needs Review", None, None, None, None)], streams.CACHE_SCHEMA.replace("confidence string, ", "").replace("depth string,", "depth string, confidence string,"))
    results, kept = enrich.enrich(todo, held, pages_, texts, F.lit("2024-06-01").cast("timestamp"), force)
    got = results.orderBy("ord").collect()
    assert [(r.sheet, r.row_idx, r.brand, r.sku, r.link, r.ord) for r in got] == [(*g[:4], g[4] or "", g[5]) for g in given]
    assert all(r.confidence and r.reason is not None for r in got)
    assert {r.reason for r, g in zip(got, given) if not (g[4] or "").strip()} == {"No product URL available"}
    assert kept.count() == kept.select("url_key").distinct().count() and kept.where("url_key = ''").count() == 0


def test_several_results_of_a_key_multiply_no_row(spark):
    todo = spark.createDataFrame([("s", i, "LG", "k", "u" if i else "u/", i) for i in range(3)], TODO)
    result = lambda h: F.struct(F.lit(h).alias("height"), *(F.lit(None).cast("string").alias(c) for c in ("width", "depth")), F.lit("Needs Review").alias("confidence"), *(F.lit("").alias(c) for c in ("source_url", "raw_text", "reason")))
    own = spark.range(1).select(F.lit("u").alias("url_key"), F.lit(0).cast("long").alias("ord"), F.explode(F.array(result("2"), result("1"))).alias("result"))
    none = spark.createDataFrame([], streams.CACHE_SCHEMA)
    assert [r.result.height for r in cache.replay_results(todo, own, none).orderBy("ord").collect()] == ["1", "1", "1"]
    assert cache.replay_results(todo, own, none, force=True).count() == 3


# pages ------------------------------------------------------------------------------------------------------


class Node:
    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.inside = tag, attrs, []

    def all(self):
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.all()

    def strings(self):
        for x in self.inside:
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style", "template"):
                yield from x.strings()

    def text(self, between=" "):
        return between.join(s for s in (x.strip() for x in self.strings()) if s)


class Tree(HTMLParser):
    """A plain tree, searched again for each element: what the numbered page must agree with."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        for at in range(len(self.open) - 1, 0, -1):
            if tag not in pages.ENDS or self.open[at].tag in pages.WITHIN[tag]:
                break
            if self.open[at].tag in pages.ENDS[tag]:
                del self.open[at:]
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].inside.append(node)
        if tag not in pages.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in pages.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                break

    def handle_data(self, data):
        inside = self.open[-1].inside
        if inside and isinstance(inside[-1], str):
            inside[-1] += data
        else:
            inside.append(data)


def plain_pairs(html):
    nodes, found = list(Tree(html).root.all()), []
    has = lambda n, p: any(re.search(p, c, re.I) for c in n.attrs.get("class", "").split())
    for n in (n for n in nodes if n.tag == "dl"):
        inner = list(n.all())
        found += zip([x.text() for x in inner if x.tag == "dt"], [x.text() for x in inner if x.tag == "dd"])
    for n in (n for n in nodes if n.tag == "table"):
        for row in (x for x in n.all() if x.tag == "tr"):
            cells = [x.text() for x in row.all() if x.tag in ("td", "th")]
            if len(cells) >= 2:
                found.append((cells[0], cells[1]))
    for n in nodes:
        if has(n, "spec"):
            label, value = (next((x for x in n.all() if has(x, p)), None) for p in ("label|name|key|title", "value|data|content"))
            if label and value and label is not value:
                found.append((label.text(), value.text()))
    about = lambda x: re.search("spec|product.guide|data.sheet", x, re.I)
    link = next((n.attrs["href"] for n in nodes if n.tag == "a" and ".pdf" in n.attrs.get("href", "").lower() and (about(n.text("")) or about(n.attrs["href"]))), None)
    return found, link or next((n.attrs["data-pdf"] for n in nodes if "data-pdf" in n.attrs), None)


BITS = [
    "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<dl>", "</dl>", "<dt>", "<dd>", "</dd>", "<p>", "</p>", "<b>", "</b>", "<div class='spec'>", "<div class='x Spec-row label'>", "</div>", "<i class=label>", "<i class=value>", "</i>",
    "<u class='my-name content'>", "</u>", "<li>", "<ul>", "</ul>", "<br>", "<br/>", "<div/>", "<script>x</script>", "<script class='value'>zz</script>", "<template class='spec title'>", "</template>", "<style>a</style>", "text", "  a ", "&amp;", "\n",
    "<a href='x.pdf'>", "<a href='/spec.pdf'>", "</a>", "Data sheet", "<i data-pdf='q'>", "<!-- c -->", "<option>", "<select>", "</select>", "</", "<", "<td", "<section>",
]


def test_numbered_pages_equal_plain_trees():
    rng = random.Random(7)
    for _ in range(6000):
        html = "".join(rng.choices(BITS, k=rng.randint(1, 40)))
        found, link = pages.page_pairs(html, None)
        assert ([(p["label"], p["value"]) for p in found], link) == plain_pairs(html), html


@pytest.mark.parametrize(
    "html",
    [
        "<table><tr><td>" * 3000, "<div class='spec'>" * 5000 + "<b class=label>x</b><b class=value>y</b>", "<div class='spec'><b class=label>x</b><b class=value>y</b>" * 2000, "<b>" * 20_000 + "<p>" * 13_000,
        "<ul><li>" * 12_000, "<li><b>" * 14_000, "<b>" * 14_000 + "</i>" * 14_000, "<a href='x.pdf'>t" * 6000, "<dl><dt>" * 12_000, "<script>" * 12_000, "<template>t" * 9000,
    ],
)
def test_hostile_pages_take_linear_time(html):
    began = time.perf_counter()
    pages.page_pairs(html, "https://h/")
    assert time.perf_counter() - began < 1.5


def test_repeated_pairs_are_bounded_and_change_no_result(spark):
    nested = "<table><tr><td>Width<td>5</td></tr>" + "<tr><td>Height<td><table><tr><td>Depth<td>7</td></tr>" * 40
    got = [(p["label"], p["value"]) for p in pages.page_pairs(nested, None)[0]]
    want = plain_pairs(nested)[0]
    assert got == want[: len(got)] or Counter(got) <= Counter(want)
    assert len(got) <= pages.REPEATS * nested.count('<tr>') < len(want)
    result = lambda pairs: spark.createDataFrame([([{"label": k, "value": v} for k, v in pairs],)], "p array<struct<label:string,value:string>>").select(queries.dimensions.dimension_result(enrich.dim_pairs(F.col("p")), F.lit("u")).alias("r")).first().r
    assert result(got) == result(want)
    # each list has one more term than the one in it: no inner list repeats an outer one's pairs, and the page's text is bounded
    assert sum(len(p["label"]) + len(p["value"]) + 16 for p in pages.page_pairs("<dl><dt>" * 3000 + "<dd>" * 3000, None)[0]) <= pages.MOST_TEXT


def test_the_prefilter_sets_aside_only_pages_without_pairs(spark):
    rng = random.Random(3)
    odd = ['<script type="application/ld&#x2B;json">{"name":"a","value":"b"}</script>', "<a href='x&#46;pdf'>data sheet</a>", "<a href='x&period;pdf'>product guide</a>", "<i class='&#115;pec'><b class=label>l</b><b class=value>v</b></i>", "<i class='ſpec'><b class=label>l</b><b class=value>v</b></i>", '<script id="&lowbar;_NEXT_DATA__">[{"key":"k","data":"d"}]</script>', '<script type="application/ld&plus;json">{"name":"a","value":"b"}</script>', '<script id="&UnderBar;_NEXT_DATA__">[{"key":"k","data":"d"}]</script>', "<DL><dt>a<dd>b</DL>", "<i DATA-pdf=x>"]
    plain = ["<p>", "text", "&amp;", "<b class='x'>", "&nbsp;", "<a href='x.html'>", "\n"]
    texts = [*odd, *("".join(rng.choices(plain + odd + BITS, k=rng.randint(1, 6))) for _ in range(1500)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, html string").withColumn("url", F.lit("https://h/p"))
    for r in pages.pairs_from_html(df).collect():
        found, link = pages.page_pairs(r.html, "https://h/p")
        assert ([p.asDict() for p in r.pairs], r.pdf_url) == (found, link), r.html
        assert r.i >= len(odd) or found or link
    assert df.where(F.col("html").rlike(pages.HOLDS)).count() < df.count()


def test_half_surrogates_stop_no_job(spark):
    text = '{"name": "Width \\ud800", "value": "5"}'
    df = spark.createDataFrame([(f'<script type="application/ld+json">{text}</script>', text, "https://h/")], "html string, json string, url string")
    got = pages.pairs_from_html(df).select("pairs", pages.pairs_from_json(F.col("json")).alias("j")).first()
    assert [(p.label, p.value) for p in got.pairs] == [("Width ?", "5")] == [(p.label, p.value) for p in got.j]


# cells ------------------------------------------------------------------------------------------------------


def test_floats_of_any_size(spark):
    rng = random.Random(2)
    given = [1e19, 1e20, 1e22, 1e23, 1e308, 1.7976931348623157e308, float("inf"), float("-inf"), 1e-20, -1e-20, 0.00012345, 0.001, 0.0001, 0.00001, 1e-300, 12345678.5, -12345678.25, -0.0, 0.0, 9e18, -9.3e18, 2.0**63, 2.0**62, 1e7, 1e16, -1e30, 4503599627370495.5, 1.5e-7]
    given += [rng.randint(1, 999) * 10.0 ** rng.randint(-12, 40) for _ in range(300)] + [float(rng.getrandbits(53)) * 2.0 ** rng.randint(0, 960) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in given], "d double")
    got = {r.d: r.t for r in df.select("d", clean.clean_cell(F.col("d"), "double").alias("t")).collect()}
    assert got == {v: str(int(v)) if v.is_integer() else str(v) for v in given}
    floats = spark.createDataFrame([(0.1,), (3.0,), (float("nan"),), (None,), (2.5e7,), (1e-5,)], "d float")
    assert [r.t for r in floats.select(clean.clean_cell(F.col("d"), "float").alias("t")).collect()] == ["0.1", "3", "", "", "25000000", "1e-05"]


# rules ------------------------------------------------------------------------------------------------------


def test_many_rules_of_one_group_equal_compiled_ones(spark):
    rng = random.Random(6)
    letters = "abcé %_."
    word = lambda n: "".join(rng.choices(letters, k=n))
    given = [(rng.choice(["One", "TWO"]), [word(rng.randint(1, 7)) for _ in range(rng.randint(1, 3))], "Ovens", f"b{i}") for i in range(400)] + [("three", [], "Ovens", "any"), ("four", ["zz", ""], "Ovens", "some"), ("one", [], "Ovens", "last")]
    table = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], rules.RULE_SCHEMA)
    texts = [(i, rng.choice([" one", "two", "three", "four", "five", None]), rng.choice([None, "", word(rng.randint(1, 14)).upper()])) for i in range(800)]
    cat = spark.createDataFrame([(i, "f", "LG", g, s, "n", "k", "") for i, g, s in texts], CATALOGUE)
    want = set(rows(rules.compiled(cat, given, []).where("sheet IS NOT NULL").select("row_seq", "sheet", "block")))
    got = rules.match_rules(cat, table)
    assert set(rows(got.select("row_seq", "sheet", "block"))) == want and got.count() == len(want) and len(want) > 300
    index = rules.rule_index(table)
    assert index.groupBy("group", "term").count().where("count > 1").count() == 0
    assert rules.match_rules(cat, table.limit(0)).count() == 0 and rules.match_rules(cat.limit(0), table).count() == 0


def test_a_text_meets_only_terms_that_it_may_hold(spark):
    table = spark.createDataFrame([(i, "all", [f"model {i} oven"], "Ovens", f"b{i}") for i in range(3000)], rules.RULE_SCHEMA)
    index = rules.rule_index(table)
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] < 100  # none is filed under a gram of "model" or "oven"
    cat = spark.createDataFrame([(i, "f", "LG", "all", f"the model {i} oven", "n", "k", "") for i in range(0, 3000, 100)], CATALOGUE)
    assert {(r.row_seq, r.block) for r in rules.match_rules(cat, table).collect()} >= {(0, "b0"), (100, "b100"), (2900, "b2900")}


# layout -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("numbers", ["monotonic", "hash", "ties"])
def test_places_of_any_numbers(spark, numbers):
    seq = {"monotonic": F.monotonically_increasing_id(), "hash": F.xxhash64("i"), "ties": F.col("i") % 7}[numbers]
    df = spark.range(0, 3000, 1, 6).withColumnRenamed("id", "i").withColumn("row_seq", seq.cast("long"))
    df = df.select("row_seq", F.when(F.col("i") % 5 < 4, "Ovens").otherwise("Cooktops").alias("sheet"), F.when(F.col("i") % 11 < 9, "big").otherwise(F.concat(F.lit("b"), (F.col("i") % 3).cast("string"))).alias("block"), F.col("i").cast("string").alias("Product"))
    got = layout.layout_positions(df, lane=100).collect()
    want, start = {}, {}
    given = rows(df.select("sheet", "block", "row_seq"))
    for sheet in ("Ovens", "Cooktops"):
        firsts = {}
        for s, b, q in given:
            if s == sheet:
                firsts[b] = min(firsts.get(b, q), q)
        at = 1
        for b in sorted(firsts, key=lambda b: (firsts[b], b)):
            own = sorted(q for s, x, q in given if (s, x) == (sheet, b))
            start[sheet, b] = at
            want |= {(sheet, at + 2 + i): (b, q) for i, q in enumerate(own)}
            at += len(own) + 3
    if numbers != "ties":  # the order of blocks that begin with equal numbers isn't defined
        assert {(r.sheet, r.row_idx): (r.block, r.row_seq) for r in got} == want
    assert len({(r.sheet, r.row_idx) for r in got}) == len(got) == 3000
    sizes = [r["count"] for r in layout.ranged(df, 100).groupBy("_part").count().collect()]
    assert numbers == "ties" or max(sizes) < 300


# cache ------------------------------------------------------------------------------------------------------

RESULT = "url_key string, height string, width string, depth string, confidence string, source_url string, raw_text string, reason string, fetched_at timestamp, ord long"


def batch(spark, urls, day, height, ord_=0):
    return spark.createDataFrame([(u, height, "", "", "Resolved", "", "x" * 50, "", None, ord_) for u in urls], RESULT).withColumn("fetched_at", F.lit(day).cast("timestamp")).coalesce(1)


def held(spark, path):
    return {r.url_key: r.height for r in log_cache.read_cache(spark, str(path)).collect()}


def test_a_batch_writes_its_own_rows_however_large_the_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_cache, "LEAST_ROWS", 20)
    path, want, sizes, seen = tmp_path / "cache", {}, [], set()
    log_cache.append(batch(spark, [f"u{i}" for i in range(50_000)], "2024-01-01", "0"), str(path))
    first = {p: p.stat().st_size for p in (path / "rows").rglob("*.parquet")}
    want |= {f"u{i}": "0" for i in range(50_000)}
    for k in range(100):
        urls = [f"u{(k * 7 + j) % 600}" for j in range(5)]
        day = f"2024-{2 + k % 3:02d}-01"  # later batches are often older
        log_cache.append(batch(spark, urls, day, f"{day} {k:03d}"), str(path))
        want |= {u: max(want.get(u, ""), f"{day} {k:03d}") for u in urls}
        log_cache.compact(spark, str(path))
        new = {p: p.stat().st_size for p in (path / "rows").rglob("*.parquet")}
        sizes.append(sum(n for p, n in new.items() if p not in seen and p not in first))
        seen |= set(new)
    assert held(spark, path) == want
    assert max(sizes) < sum(first.values()) / 4 and sum(sizes) / 100 < sum(first.values()) / 20
    assert len(log_cache.live(spark, str(path))) < 3 * log_cache.FANOUT
    assert set(first) <= seen and sum(1 for p in (path / "rows").rglob("*.parquet") if p in first) == len(first)  # the large run was never written again
    before = len(list((path / "log").iterdir()))
    gone = log_cache.vacuum(spark, str(path), keep_seconds=0)
    assert gone and held(spark, path) == want and len([p for p in (path / "log").iterdir() if not p.name.endswith(".crc")]) < before
    keys = spark.createDataFrame([("u1",), ("none",)], "url_key string")
    assert [r.url_key for r in log_cache.read_cache(spark, str(path), keys).collect()] == ["u1"]


def test_two_writers_lose_no_batch(spark, tmp_path):
    path, failed = str(tmp_path / "cache"), []

    def write(name):
        try:
            for k in range(6):
                log_cache.append(batch(spark, [f"{name}{k}", "both"], f"2024-01-{k + 1:02d}", f"{k}{name}"), path)
                log_cache.compact(spark, path, fanout=3)
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = held(spark, path)
    assert set(got) == {f"{n}{k}" for n in "ab" for k in range(6)} | {"both"} and got["both"] in ("5a", "5b")


def test_a_batch_counts_once_its_entry_is_whole(spark, tmp_path):
    path = tmp_path / "cache"
    log_cache.append(batch(spark, ["u"], "2024-01-01", "1"), str(path))
    log_cache.append(batch(spark, ["u"], "2024-01-01", "2"), str(path))  # the same moment: the later batch wins
    assert held(spark, path) == {"u": "2"}
    (path / "log" / "half.json").write_text('{"name": "ha')
    assert held(spark, path) == {"u": "2"}
    one = Path(path / "log")
    names = sorted(p.name for p in one.iterdir() if p.suffix == ".json")
    with pytest.raises(Exception, match="already exists"):
        log_cache._Folder(spark, str(one)).create(names[0], "{}")
    assert log_cache.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_a_bucketed_cache_is_not_shuffled(spark, monkeypatch):
    held_ = spark.range(5000).select(F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("url_key"), *(F.lit("1").alias(c) for c in ("height", "width", "depth")), F.lit("Resolved").alias("confidence"), *(F.lit("").alias(c) for c in ("source_url", "raw_text", "reason")), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    stored = cache.store_cache(held_, "bucketed_cache_test", 4)
    todo = spark.range(6000).select(F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row_idx"), F.lit("LG").alias("brand"), F.lit("k").alias("sku"), F.concat(F.lit("https://h/"), F.col("id").cast("string"), F.lit("/")).alias("link"), F.col("id").alias("ord"))
    found = cache.lookup_cache(todo, stored.hint("merge"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(url_key") <= 1 and "Bucketed: true" in plan
    assert found.where("cached IS NOT NULL").count() == 5000 and found.count() == 6000
    # a run of few links takes what it asks for from the scan
    few = cache.held_for(todo.limit(10), held_)
    assert few.count() == 10 and "FileScan" in few._jdf.queryExecution().executedPlan().toString() and cache.held_for(todo, held_) is not held_
    monkeypatch.setattr(cache, "small", lambda df, **how: None)  # as if the links were too many
    assert cache.held_for(todo, held_) is held_
    new = stored.limit(3).select("url_key", F.lit("9").alias("height"), "width", "depth", "confidence", "source_url", "raw_text", "reason", F.lit("2025-01-01").cast("timestamp").alias("fetched_at"), F.lit(1).cast("long").alias("ord"))
    both = cache.upsert_bucketed(stored, new)
    assert both.count() == 5000 and both.where("height = '9'").count() == 3
    spark.sql("DROP TABLE bucketed_cache_test")


# sources ----------------------------------------------------------------------------------------------------


def test_many_files_of_few_schemas_are_few_scans(spark, tmp_path):
    for i in range(30):
        head = ["Brand,x", "x,Brand", "Brand,y,Shop Product URL"][i % 3]
        (tmp_path / f"f {i}+.csv").write_text(f"{head}\n" + {0: "LG,1", 1: "1,LG", 2: "LG,2,u"}[i % 3] + "\n")
    got = catalogue.read_catalogues(spark, [str(tmp_path / f"f {i}+.csv") for i in range(30)], fmt="csv")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 3
    assert Counter(rows(got.select("Brand", "x", "y", "Shop Product URL"))) == {("LG", "1", "", ""): 20, ("LG", "", "2", "u"): 10}
    assert got.select("source_file").distinct().count() == 30
    for i, kind in enumerate(["x int", "y string", "x string", "x string"]):
        spark.createDataFrame([(str(i) if "string" in kind else i,)], kind).write.parquet(str(tmp_path / f"p{i}"))
    one = catalogue.read_catalogues(spark, [str(tmp_path / f"p{i}") for i in (1, 2, 3)])
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert Counter(rows(one.select("x", "y"))) == {("", "1"): 1, ("2", ""): 1, ("3", ""): 1}
    mixed = catalogue.read_catalogues(spark, [str(tmp_path / f"p{i}") for i in range(4)])  # x is a number in one file
    assert mixed._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 3
    assert Counter(rows(mixed.select("x", "y"))) == {("0", ""): 1, ("", "1"): 1, ("2", ""): 1, ("3", ""): 1}
    for folder in ("a/k=1", "b/j=2"):  # each its own partitions
        spark.createDataFrame([("v",)], "x string").write.parquet(str(tmp_path / folder))
    assert rows(catalogue.read_catalogues(spark, [str(tmp_path / "a/k=1"), str(tmp_path / "b/j=2")]).select("x")) == [("v",), ("v",)]
    (tmp_path / "empty.csv").write_text("")
    assert catalogue.read_catalogues(spark, [str(tmp_path / "empty.csv")], fmt="csv").count() == 0


def test_sheets_as_they_arrive_equal_the_batch(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    banner = 'Master\n"two\nlines"\n\n'
    (source / "a.csv").write_text(banner + "Brand,Product Group,Subcategory,Model / SKU,Product Name,Product URL\nLG,Cooking,Steam Oven,k1,n,u1\n,,,,,\n\nLG,Laundry,x,k2,n,u2\n")
    (source / "b.csv").write_text("﻿" + banner + " shop product url ,Subcategory,Product Group,Other,Brand\nu3, Gas Hob ,cooking,z,Bosch,too many\nu4\n")
    (source / "c.csv").write_text(banner + "\nLG,Cooking,Steam Oven\n")
    (source / "d.csv").write_text("only one line\n")
    run = lambda: streams.catalogue_stream(spark, str(source), sink, str(tmp_path / "c"), files_per_batch=1).awaitTermination()
    run()
    (source / "e.csv").write_text(banner + "Product Group,Brand\nDishwashing,LG\n")
    run()
    run()
    got = spark.read.parquet(f"{sink}/rows")
    assert Counter(rows(got.select("source_file", "row_idx", "brand", "sku", "link", "sheet", "block"))) == Counter(
        [("a.csv", 5, "LG", "k1", "u1", "Ovens", "Built-in"), ("a.csv", 8, "LG", "k2", "u2", None, None), ("b.csv", 5, "Bosch", "", "u3", "Cooktops", "Gas"), ("b.csv", 6, "", "", "u4", None, None), ("e.csv", 5, "LG", "", "", "DishWashers", "Dishwasher")]
    )
    assert sorted(rows(spark.read.parquet(f"{sink}/set_aside").select("source_file", "reason"))) == [("c.csv", "no header in row 4"), ("d.csv", "no header in row 4")]


def test_a_batch_of_sheets_is_two_jobs(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        head = "" if i == 1 else "Brand,Product Group,Subcategory,Model / SKU,Product Name,Product URL"
        (source / f"{i}.csv").write_text(f'Master\n"two\nlines"\n\n{head}\nLG,Cooking,Steam Oven,k{i},n,u\n\n,,\n')
    stream = streams.catalogue_stream(spark, str(source), sink, str(tmp_path / "c"), files_per_batch=1)
    stream.awaitTermination()
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(stream.runId))) <= 3 * 2
    assert sorted(rows(spark.read.parquet(f"{sink}/rows").select("source_file", "row_idx", "sku", "sheet"))) == [("0.csv", 5, "k0", "Ovens"), ("2.csv", 5, "k2", "Ovens")]
    assert rows(spark.read.parquet(f"{sink}/set_aside").select("source_file", "reason")) == [("1.csv", "no header in row 4")]


def test_streams_side_by_side_equal_one(spark, tmp_path):
    head, sink = "Brand,Product Group,Subcategory,Model / SKU,Product Name,Product URL", str(tmp_path / "out")

    def put(i):
        (tmp_path / "in" / f"number={i}").mkdir(parents=True)
        (tmp_path / "in" / f"number={i}" / "s.csv").write_text(f'Master\n"two\nlines"\n\n{"" if i % 4 == 1 else head}\nLG,Cooking,Steam Oven,k{i},n,u\n')

    def run():
        lanes = {name: str(tmp_path / "in" / f"number=*[{digits}]") for name, digits in (("even", "02468"), ("odd", "13579"))}
        streams.run_catalogue_streams(spark, lanes, sink, str(tmp_path / "c"), files_per_batch=7)
        kept, aside = spark.read.parquet(f"{sink}/rows").select("sku", "sheet"), spark.read.parquet(f"{sink}/set_aside").select("reason")
        return Counter(rows(kept)), Counter(rows(aside))

    want = lambda n: (Counter((f"k{i}", "Ovens") for i in range(n) if i % 4 != 1), Counter({("no header in row 4",): len([i for i in range(n) if i % 4 == 1])}))
    for i in range(14):
        put(i)
    assert run() == want(14)
    # seven small sheets are one task and one file
    assert {f.name: len(list(f.glob("batch=*/*.parquet"))) for f in (tmp_path / "out" / "rows").iterdir()} == {"lane=even": 1, "lane=odd": 1}
    put(14)
    put(15)
    assert run() == run() == want(16)


def test_a_stream_that_fails_stops_the_others(spark, tmp_path, monkeypatch):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.csv").write_text("one line\n")
    (tmp_path / "out" / "rows").mkdir(parents=True)
    (tmp_path / "out" / "rows" / "lane=a").write_text("in the way")
    seen, start = [], streams.catalogue_stream
    monkeypatch.setattr(streams, "catalogue_stream", lambda *a, **b: seen.append(start(*a, **b)) or seen[-1])
    with pytest.raises(Exception, match="lane=a"):
        streams.run_catalogue_streams(spark, {n: str(tmp_path / n) for n in ("a", "b")}, str(tmp_path / "out"), str(tmp_path / "c"), files_per_batch=1)
    assert len(seen) == 2 and not any(s.isActive for s in seen)


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    sc, key = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(40):
        (tmp_path / f"number={i}").mkdir()
        (tmp_path / f"number={i}" / "s.csv").write_text("x")
    before = spark.conf.get(key)
    with shared.listed_by_cores(spark):
        sc.setJobGroup("list-few", "")
        assert spark.read.text(str(tmp_path / "number=*")).count() == 40
    sc.setLocalProperty("spark.jobGroup.id", None)
    first = min(sc.statusTracker().getJobIdsForGroup("list-few"))
    assert [sc.statusTracker().getStageInfo(s).numTasks for s in sc.statusTracker().getJobInfo(first).stageIds] == [sc.defaultParallelism]
    assert spark.conf.get(key) == before


def test_sheets_of_the_catalogue_go_through_streams_side_by_side(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id p_partkey", "concat('n', id) p_name").write.parquet(str(tmp_path / "part.parquet"))
    seen, start = [], streams.catalogue_stream
    monkeypatch.setattr(streams, "catalogue_stream", lambda *a, **b: seen.append(start(*a, **b)) or seen[-1])
    assert queries.QUERIES["s1_catalogue_stream"](spark, str(tmp_path)).count() == 1600 + 4
    files = [sum(p.numInputRows for p in s.recentProgress) for s in seen]
    assert sum(files) == 20 and max(files) == 2  # 20 sheets: three batches one after another in one stream
    assert max(p.numInputRows for s in seen for p in s.recentProgress) <= 7


def test_pages_of_one_address_keep_their_own_captures(spark, tmp_path):
    # the address of 1 (fetched), 2 (refused) and 7 (not crawled) is the same
    given = [(1, "u", "a"), (2, "u", "bb"), (7, "u", "ccc"), (3, "v", "d")]
    spark.createDataFrame(given, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(rows(queries.QUERIES["c5_attach_pages"](spark, str(tmp_path))))
    import duckdb

    want = duckdb.sql(queries.ORACLES["c5_attach_pages"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert got == sorted(want) == [(1, "u", None, 1), (2, "u", "access refused (HTTP 403)", 2), (3, "v", "access refused (HTTP 429)", 1), (7, "u", "fetch failed", None)]
    by_url = spark.createDataFrame([(u, 200, "", h) for _, u, h in given], "url string, status int, error string, html string")
    assert enrich.attach_pages(spark.createDataFrame([(1, "u"), (2, "u")], "page_id long, link string"), by_url).select("html").distinct().count() == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_captures_come_from_one_evaluation_of_the_pages(spark):
    for made, times in ((inputs.crawl_by_link(spark, SF), 2), (inputs.recrawl_by_link(spark, SF), 8)):
        assert plan_of(made).count("collect_list(") == 1
        assert made.count() == times * inputs.html_pages(spark, SF).count()
    kinds = inputs.recrawl_by_link(spark, SF).where("url = 'https://shop.example.com/p/3/'").select(F.date_format("fetched_at", "MM-dd"), "status", "error", F.col("html").startswith("<html>"))
    assert Counter(rows(kinds)) == {("05-01", 403, "", True): 2, ("04-01", 500, "", True): 1, ("07-01", 200, "", False): 1}


def test_many_links_leave_captures_at_the_scan_by_their_hashes(spark, monkeypatch):
    crawl = spark.range(50).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit(200).alias("status"), F.lit("").alias("error"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("html"))
    work = spark.createDataFrame([("u3",), ("u3",), ("u7",), ("none",), (None,)], "link string")
    want = Counter([("u3", None, "h3")] * 2 + [("u7", None, "h7"), ("none", "fetch failed", None), (None, "fetch failed", None)])
    for small, hashed, left in ((100, 100, 2), (1, 100, 2), (1, 1, 50)):
        monkeypatch.setattr(enrich, "SMALL_ROWS", small)
        monkeypatch.setattr(enrich, "HASHED_ROWS", hashed)
        assert enrich.asked_for(crawl, work.select(F.col("link").alias("url"))).count() == left
        assert Counter(rows(enrich.attach_pages(work, crawl).select("link", "outcome", "html"))) == want


def test_rows_of_part_are_dealt_out(spark):
    assert derive.derived(spark, SF, derive.CATALOGUE).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_pages_are_made_once_for_their_dimensions(spark, monkeypatch):
    seen, attach = [], enrich.attach_pages
    monkeypatch.setattr(queries.E, "attach_pages", lambda work, crawl, *a, **b: seen.extend([work, crawl]) or attach(work, crawl, *a, **b))
    queries.QUERIES["h6_page_dimensions"](spark, SF)
    assert len(seen) == 2 and not any("collect_list(" in plan_of(df) for df in seen)


@pytest.mark.parametrize("name", ["a3_large_and_tiny", "a8_unmapped_order", "a9_write_results", "b3_many_rules", "c2_lookup_bucketed", "c5_captures", "e3_sparse_positions", "e7_upsert_bucketed", "f10_whole_words", "f10_cavities", "h7_enrich_recrawled", "s1_catalogue_stream"])
def test_new_oracles(spark, name):
    from test_catalogue import test_oracles

    test_oracles(spark, name)


def test_pairs_of_a_page_are_not_shuffled(spark):
    plan = inputs.paired(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # rows of part are dealt out by their keys, and that is all (three exchanges before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(p_partkey" in plan


def test_rules_are_not_computed_by_a_filter_on_them(spark):
    mapped = inputs.mapped_rows(spark, SF)
    assert "RLIKE" not in plan_of(mapped)
    want = rules.mapped(inputs.classified(spark, SF))
    assert mapped.columns == want.columns and Counter(rows(mapped)) == Counter(rows(want))


@pytest.mark.parametrize("name", ["c6_apply_results", "a9_write_results"])
def test_rows_are_laid_out_once_for_the_listing_and_its_results(spark, monkeypatch, name):
    laid, ranged = [], layout.ranged
    monkeypatch.setattr(layout, "ranged", lambda mapped, *a, **b: laid.append(mapped) or ranged(mapped, *a, **b))
    caches, hold = [], enrich.held_for
    monkeypatch.setattr(enrich, "held_for", lambda rows, cache: caches.append(cache) or hold(rows, cache))
    queries.QUERIES[name](spark, SF)
    assert len(laid) == 1 and len(caches) == 1 and "max_by" not in plan_of(caches[0])


def test_few_rows_are_parsed_by_many_tasks(spark):
    work = spark.range(40).coalesce(1).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("link"))
    crawl = work.select(F.col("link").alias("url"), F.lit(200).alias("status"), F.lit("").alias("error"), F.lit("h").alias("html"))
    # its pages are broadcast: the tasks are those of the work list, one before
    tasks = enrich.attach_pages(work, F.broadcast(crawl)).withColumn("task", F.spark_partition_id())
    assert tasks.select("task").distinct().count() == spark.sparkContext.defaultParallelism
