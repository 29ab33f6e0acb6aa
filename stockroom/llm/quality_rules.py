"""Quality rules in a short-circuit cascade, with DataFrame functions only.

A rule is a test on measures of a whole text (true: reject), and a measure is an expression on the text or on
other measures. ``cascade`` runs the rules one after another on each row until one rejects: a measure is
computed, once, when the first rule that needs it is reached, and not at all on rows that are rejected before.
Each rule is timed from the raw text on a sample, with all measures that it needs, and what it rejects there
is counted; rules are ordered by rejection per cost. The order decides how much work is done, and
which rule is named as the first to reject; it never decides whether a row is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Words of a stretch in which ``passed`` counts distinct words.
STRETCH = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _combined(hashes: Column, span: int) -> Column:
    """Hashes of runs of 2 * ``span`` elements from those of runs of ``span``."""
    n = F.size(hashes) - span
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(span + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Elements in windows of ``WINDOW`` that are found twice or more."""

    def from_sorted(s: Column) -> Column:
        # get(s, -1) is null, and so is get(s, size): neither equals a key
        twice = F.filter(s, lambda x, j: (x["key"] == F.get(s, j - 1)["key"]) | (x["key"] == F.get(s, j + 1)["key"]))
        places = F.array_sort(F.transform(twice, lambda x: x["at"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, at: F.struct((at + WINDOW).alias("end"), (acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    pairs = F.array_sort(F.transform(windows, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, from_sorted))


def _repeated(hashes: Column) -> Column:
    """Words in windows of ``WINDOW`` (8) words found twice or more, from the words' hashes.

    A window found twice holds a run of four found twice, which most texts don't have.
    """
    fours = let(_combined(hashes, 1), lambda two: _combined(two, 2))
    of_fours = lambda four: F.when(F.size(F.array_distinct(four)) == F.size(four), F.lit(0)).otherwise(let(_combined(four, 4), _covered))
    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(fours, of_fours))


def _distinct_in_stretches(hashes: Column) -> Column:
    """Distinct words in each stretch of ``STRETCH`` words, summed over the stretches that make up the whole text."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(STRETCH))
    return F.aggregate(starts, F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice(hashes, at, STRETCH))))


Measures = Mapping[str, Column]

#: Measures by name: what each needs, and how it follows from that. "text" is the text itself, null as empty.
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[Measures], Column]]] = {
    "words": (("text",), lambda m: F.array_remove(F.split(m["text"], SPACE + "+"), "")),
    "hashes": (("words",), lambda m: F.transform(m["words"], lambda x: F.xxhash64(x))),
    "n_words": (("words",), lambda m: F.size(m["words"])),
    "word_chars": (("words",), lambda m: F.length(F.array_join(m["words"], ""))),
    "n_repeat_words": (("hashes",), lambda m: _repeated(m["hashes"])),
    "n_distinct": (("hashes",), lambda m: F.size(F.array_distinct(m["hashes"]))),
    "n_distinct_near": (("hashes",), lambda m: _distinct_in_stretches(m["hashes"])),
    "n_symbols": (("text",), lambda m: F.regexp_count(m["text"], F.lit(r"[#*$%&|<>]"))),
    "n_upper": (("text",), lambda m: F.regexp_count(m["text"], F.lit(r"\p{Lu}"))),
    "n_lines": (("text",), lambda m: F.size(F.split(m["text"], "\n", -1))),
    "lines": (("text",), lambda m: F.filter(F.split(m["text"], "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))),
    "n_dup_lines": (("lines",), lambda m: F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))),
}
#: Measures that ``judged`` returns.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_measures(names: list[str], bound: Measures, use: Callable[[Measures], Column]) -> Column:
    """``use`` with the measures ``names`` (and what they need) added to ``bound``, each computed once for a row."""
    name = next((n for n in names if n not in bound), None)
    if name is None:
        return use(bound)
    needs, make = MEASURES[name]
    missing = [n for n in needs if n not in bound]
    if missing:
        return with_measures([*missing, *names], bound, use)
    return let(make(bound), lambda value: with_measures(names, {**bound, name: value}, use))


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test``, on the measures that it needs, is true. Null doesn't reject."""

    needs: tuple[str, ...]
    test: Callable[[Measures], Column]


def base_rules(min_words: int = 20, repeat_percent: int = 30) -> dict[str, Rule]:
    """The rules that make base_failed: too few words, or too many in repeated windows."""
    return {
        "short": Rule(("n_words",), lambda m: m["n_words"] < min_words),
        "repeated words": Rule(("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > repeat_percent * m["n_words"]),
    }


def standard_rules(min_words: int = 20, repeat_percent: int = 30) -> dict[str, Rule]:
    """All rules by name."""
    return base_rules(min_words, repeat_percent) | {
        "symbols": Rule(("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
        "long words": Rule(("word_chars", "n_words"), lambda m: m["word_chars"] > 20 * m["n_words"]),
        "repeated lines": Rule(("n_dup_lines", "n_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
        "few words": Rule(("n_distinct", "n_words"), lambda m: 5 * m["n_distinct"] < m["n_words"]),
        "shouting": Rule(("n_upper", "word_chars"), lambda m: 10 * m["n_upper"] > 3 * m["word_chars"]),
    }


def stretch_rules(min_words: int = 20, repeat_percent: int = 30) -> dict[str, Rule]:
    """``standard_rules``, but "few words" goes by stretches of ``STRETCH`` words, so that length alone rejects no text.

    The share of distinct words of a whole text falls as it grows. Up to ``STRETCH`` words the rules are the same.
    """
    few = Rule(("n_distinct_near", "n_words"), lambda m: 5 * m["n_distinct_near"] < m["n_words"])
    return standard_rules(min_words, repeat_percent) | {"few words": few}


def cascade(names: list[str], rules: Mapping[str, Rule], bound: Measures) -> Column:
    """The name of the first of ``names`` that rejects the text with the measures ``bound`` ("text" among them), else null."""
    if not names:
        return F.lit(None).cast("string")
    rule = rules[names[0]]
    return with_measures(list(rule.needs), bound, lambda m: F.when(rule.test(m), F.lit(names[0])).otherwise(cascade(names[1:], rules, m)))


def body_of(text: str) -> Measures:
    return {"text": F.coalesce(F.col(text), F.lit(""))}


def sampled(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``docs``, drawn at random from all of it."""
    return docs.sample(min(1.0, rows / max(docs.count(), 1)), seed=seed)


def _timed(rules: Mapping[str, Rule], text: str, runs: int) -> Column:
    """struct<seconds, hits> of a row: for each rule the least time of ``runs`` from the raw text, and whether it rejects.

    The clock is read inside the task between one rule and the next, as the fields of a struct are computed in their order.
    """
    now = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    tests = [F.coalesce(with_measures(list(rule.needs), body_of(text), rule.test), F.lit(False)) for rule in rules.values()]
    n = len(tests)
    fields = [now.alias("t0")]
    for i in range(n * runs):
        fields += [tests[i % n].alias(f"h{i}"), now.alias(f"t{i + 1}")]

    def told(read: Column) -> Column:
        least = lambda i: F.least(*(read[f"t{j + 1}"] - read[f"t{j}"] for j in range(i, n * runs, n)), F.lit(2**62))
        return F.struct(F.array(*(least(i) / 1e9 for i in range(n))).alias("seconds"), F.array(*(read[f"h{i}"] for i in range(n))).alias("hits"))

    return let(F.struct(*fields), told)


def order_rules(sample: DataFrame, rules: Mapping[str, Rule], text: str = "text", runs: int = 2) -> list[str]:
    """Names of ``rules`` by share of ``sample`` rejected per second, most first; ties keep their order.

    One job times all rules, each alone and from the raw text, inside its tasks (``_timed``): what else the driver or the
    cluster does isn't counted. A rule's cost is the sum over the rows, rounded to a power of two, so that noise seldom changes
    an order. On an empty sample the rules keep their order.
    """
    if not rules:
        return []
    spark, key = sample.sparkSession, "spark.sql.subexpressionElimination.enabled"
    sample, before = stored(sample.select(text), "rule-sample").coalesce(4), spark.conf.get(key)
    spark.conf.set(key, "false")  # a measure that two rules share would be computed before the clock is read
    try:
        rows = sample.select(_timed(rules, text, max(runs, 1)).alias("r"))
        seconds, hits = (lambda i: F.sum(F.col("r.seconds")[i])), (lambda i: F.avg(F.col("r.hits")[i].cast("double")))
        got = rows.agg(*(seconds(i).alias(f"s{i}") for i in range(len(rules))), *(hits(i).alias(f"h{i}") for i in range(len(rules)))).first()
    finally:
        spark.conf.set(key, before)
    ranks = {name: (got[f"h{i}"] or 0.0) / 2.0 ** round(math.log2(max(got[f"s{i}"] or 0.0, 1e-9))) for i, name in enumerate(rules)}
    return sorted(rules, key=lambda name: -ranks[name])


def judged(docs: DataFrame, *, text: str = "text", min_words: int = 20, repeat_percent: int = 30, sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, failed_rule and kept.

    base_failed: by ``base_rules``; failed_rule: the first of ``standard_rules`` in measured order that rejects the
    text, else null; kept: none does. Null and empty texts have no words: they are short. Windows are told apart by 64-bit
    hashes of their words' hashes. A text of any length is measured whole, in time n log n of its words. Existing columns
    with these names are replaced, and so is one named _judged. ``order``: the rules' order, if an earlier run's is to be repeated.
    """
    base, rules = base_rules(min_words, repeat_percent), standard_rules(min_words, repeat_percent)
    names = order or order_rules(sampled(docs.select(text), sample_rows), rules, text)

    def told(m: Measures) -> Column:
        failed = base["short"].test(m) | base["repeated words"].test(m)
        return F.struct(*(m[n].cast("long").alias(n) for n in SHOWN), failed.alias("base_failed"), cascade(names, rules, m).alias("failed_rule"))

    rows = docs.withColumn("_judged", with_measures(list(SHOWN), body_of(text), told))
    rows = rows.withColumns({c: F.col(f"_judged.{c}") for c in (*SHOWN, "base_failed", "failed_rule")})
    return rows.withColumn("kept", F.col("failed_rule").isNull()).drop("_judged")


def passed(docs: DataFrame, *, text: str = "text", min_words: int = 20, repeat_percent: int = 30, sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that none of ``stretch_rules`` rejects: nothing is measured beyond the first rule that rejects.

    Null and empty texts are short; with ``min_words`` of 0 they stay. Columns are those of ``docs``. ``order``: as of ``judged``.
    """
    rules = stretch_rules(min_words, repeat_percent)
    names = order or order_rules(sampled(docs.select(text), sample_rows), rules, text)
    return docs.where(cascade(names, rules, body_of(text)).isNull())


QUERY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS key FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS n FROM k),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_distinct(ws)) AS n_distinct,
             CAST(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS upper
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > len(string_split(t, chr(10))) OR 5 * n_distinct < n_words OR 10 * upper > 3 * word_chars) AS kept
FROM b
"""
