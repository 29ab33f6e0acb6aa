"""Language of web pages by fusing evidence.

Four kinds of evidence are taken as independent given the language: the text's letter trigrams (a hashed
model fitted on labelled documents), the language that the markup declares, the hint in the address (a
two-letter path or country suffix), and what the host's other pages are in. How far declarations
and hints can be trusted, and what hosts hold, is counted over all pages, each page counting as the
likelihoods of its own text say. A host's counts are smoothed by its registered domain's, those by the counts
of the suffix that the domain is registered under, and those by all pages'; a page's own share is taken out of
the counts before they speak for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored
from stockroom.llm.url_lists import SUFFIXES, host_of, registered_domain

BUCKETS = 1 << 14


def letters_of(html: Column) -> Column:
    """Lower-case words of a page or text without its tags, scripts, styles and entities.

    A script or style that isn't closed takes the rest of the page; "<" begins a tag if ">" comes before the next "<".
    So each sign is read a fixed number of times, whatever the page holds.
    """
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<[^<>]*+>|&[a-z]++;", " ")
    return F.lower(F.regexp_replace(bare, r"\P{L}+", " "))


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the trigrams of a text's code points."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(code) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = (code[:-2] * np.uint64(0x1F123BB5) + code[1:-1] * np.uint64(0x9E3779B1) + code[2:] * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
    return np.bincount(((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)


def fit_text_model(labelled: DataFrame, *, train_rows: int = 5000, add: float = 0.5, least_rows: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket in each, from rows (text, lang).

    The languages are those of all rows. About ``train_rows`` distinct texts are used, drawn by a hash of the text,
    but of each language about ``least_rows`` at least, and all if it has fewer; each document's counts are scaled
    to its number of trigrams to the power of a half, so that long documents don't outweigh the rest. Rows without
    a language are left out.
    """
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("h"))
    texts = stored(known.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.count("*").alias("n")), "labelled-languages")
    share = F.greatest(F.lit(train_rows) / texts.agg(F.sum("n").alias("n")).first()["n"], F.lit(least_rows) / F.col("n")) if not texts.isEmpty() else F.lit(1.0)
    most = texts.select("lang", (F.least(share, F.lit(1.0)) * (1 << 20)).cast("long").alias("most"))
    langs = sorted(r.lang for r in texts.select("lang").collect())
    drawn = known.join(F.broadcast(most), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("most")).dropDuplicates(["lang", "h"]).select("lang", letters_of(F.col("text")).alias("text"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                n = trigram_counts(text)
                held[lang] = held.get(lang, 0) + n / max(n.sum(), 1) ** 0.5
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counted = stored(drawn.mapInPandas(sums, "lang string, bucket int, n double"), "trigrams", batch_rows=500)
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts = np.full((len(langs), BUCKETS), add)
    np.add.at(counts, (table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)), table["n"].to_numpy())
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def page_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, domain, zone, declared, hint, and text: the log likelihood of the page's text by language.

    domain: the registered domain of the host, or the host where it has none; zone: what the domain is registered
    under. The log likelihoods are the mean over the trigrams times the root of their number: trigrams of one page
    are far from independent. Without letters all are 0.
    """
    table = model[1]
    short = lambda c: F.when(c.rlike("^[a-z]{2}$"), c).otherwise(F.lit(""))
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    domain = F.coalesce(registered_domain(host, suffixes), host)
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([a-z]{2})", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    hint = F.when(path != "", path).otherwise(short(F.regexp_extract(host, r"\.([^.]+)$", 1)))
    shown = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), domain.alias("domain"), F.regexp_extract(domain, r"^[^.]+\.(.+)$", 1).alias("zone"), short(declared).alias("declared"), hint.alias("hint"),
        letters_of(F.col("html")).alias("letters"),
    )

    @F.pandas_udf("array<double>")
    def likelihoods(letters: pd.Series) -> pd.Series:
        found = []
        for text in letters:
            n = trigram_counts(text)
            at = np.flatnonzero(n)
            found.append((table[:, at] @ n[at]) / max(n.sum(), 1) ** 0.5)
        return pd.Series(found, dtype=object)

    return stored(shown.withColumn("text", likelihoods("letters")).drop("letters"), "page-evidence", batch_rows=500)


def identify(pages: DataFrame, labelled: DataFrame, *, train_rows: int = 5000, host_weight: float = 2.0, add: float = 0.5, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared and hint for each row of ``pages`` (page_id, url, html).

    ``labelled`` (text, lang) fits the text model; without labelled rows lang is null. A null or empty page
    is judged by its address and host; a null URL has the empty host and domain. Of equally likely languages
    the first by name is taken; text_lang is null where the page has no three letters. Repeated rows each return a
    row. Any 64-bit page_id is returned as it is. ``suffixes``: what domains are registered under (last labels need no entry).
    """
    model = fit_text_model(labelled, train_rows=train_rows)
    langs = model[0]
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), none.alias("declared"), none.alias("hint"))
    at = range(len(langs))

    def normal(logs: Column) -> Column:
        top = F.array_max(logs)
        powers = F.transform(logs, lambda x: F.exp(x - top))
        return F.get(F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b))), F.lit(0))

    rows = stored(page_evidence(pages, model, suffixes).withColumn("p", normal(F.col("text"))), "page-likelihoods")
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"n{i}") for i in at]

    def counts(key: str) -> DataFrame:
        return stored(rows.groupBy(key).agg(*sums), f"by-{key}").select(key, F.array(*(F.col(f"n{i}") for i in at)).alias(f"by_{key}"))

    # two-letter codes: at most 677 rows each
    everywhere = rows.agg(*sums).first()
    total = np.array([everywhere[i] or 0.0 for i in at]) + add
    share = F.array(*(F.lit(float(x)) for x in total / total.sum()))
    of = rows.join(F.broadcast(counts("declared")), "declared").join(F.broadcast(counts("hint")), "hint").join(counts("zone"), "zone").join(counts("domain"), "domain").join(counts("host"), "host")
    size = lambda n: F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
    held_out = lambda n, i: F.greatest(F.get(n, F.lit(i)) - F.get("p", F.lit(i)), F.lit(0.0))
    logs = []
    for i in at:
        prior = F.get(share, F.lit(i))
        for level in ("zone", "domain", "host"):
            prior = (held_out(F.col(f"by_{level}"), i) + host_weight * prior) / (size(F.col(f"by_{level}")) - 1 + host_weight)
        told = [F.log((held_out(F.col(f"by_{kind}"), i) + add) / float(total[i])) for kind in ("declared", "hint")]
        logs.append(F.get("text", F.lit(i)) + F.log(prior) + told[0] + told[1])
    fused = of.withColumn("_q", normal(F.array(*logs)))
    names = F.array(*map(F.lit, langs))
    first_of = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    return fused.select("page_id", first_of(F.col("_q")).alias("lang"), F.round(F.array_max("_q"), 6).alias("confidence"), F.when(F.array_min("text") < 0, first_of(F.col("text"))).alias("text_lang"), "declared", "hint")
