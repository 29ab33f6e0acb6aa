"""Mixing sources to target weights by raking, with DataFrame functions only.

Documents fall into cells of source, language and topic, and each cell has a weight: its tokens. Raking
(iterative proportional fitting) scales the cells to the target share of each source, then of each
language, then of each topic, again and again. What it ends with is a weight for each cell that has
the target marginals and keeps the cells' own association. A document's probability is its cell's
calibrated weight by its cell's tokens, times one scale. Whether a document is drawn follows from a hash of
its id, so a repeated run draws the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored

DIMENSIONS = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    """Tokens as mixing weighs them: bytes by four, and one that ends the document. Null is empty."""
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long") + 1


def topic_of(text: Column) -> Column:
    """A coarse topic of a text: table, notice, brief, article or long."""
    body = F.coalesce(text, F.lit(""))
    size = F.length(body)
    return (
        F.when(body.contains(" | "), F.lit("table"))
        .when(F.lower(body).contains("license"), F.lit("notice"))
        .when(size < 500, F.lit("brief"))
        .when(size < 5000, F.lit("article"))
        .otherwise(F.lit("long"))
    )


def tempered_targets(cells: DataFrame, power: float = 0.9) -> DataFrame:
    """(dimension, value, share): each value's share of the tokens to the given power, rescaled to sum to one."""
    long = reduce(DataFrame.unionByName, [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens")) for d in DIMENSIONS])
    grown = long.withColumn("grown", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    sums = grown.groupBy("dimension").agg(F.sum("grown").alias("total"))
    return grown.join(F.broadcast(sums), "dimension").select("dimension", "value", F.coalesce(F.try_divide("grown", "total"), F.lit(0.0)).alias("share"))


def rake(cells: DataFrame, targets: DataFrame, *, tolerance: float = 1e-9, max_rounds: int = 50) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight, calibrated to ``targets``; weights sum to one.

    Rounds end when no value's share is further than ``tolerance`` from its target; ``max_rounds`` ends them where the
    targets contradict each other. Each round is written, which cuts lineage. A value that is in ``targets`` but in no cell has no effect; the shares of the others are rescaled. A
    value without a target gets none: its cells have weight 0. Each step sums the cells by value, which meet on the
    map side, and joins the ratios back: a value with most of the cells is never in one task.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        goal = targets.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col("share").cast("double").alias("share"))
        met = goal.join(cells.select(d).distinct(), d, "left_semi").agg(F.sum("share")).first()[0] or 1.0
        out = out.join(goal.select(d, (F.col("share") / met).alias(f"goal_{d}")), d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
    out = stored(out, "raked")
    for _ in range(max_rounds):
        for d in DIMENSIONS:
            ratio = F.when(F.sum("weight") > 0, F.max(f"goal_{d}") / F.sum("weight")).otherwise(F.lit(0.0))
            out = out.join(out.groupBy(d).agg(ratio.alias("factor")), d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        out = stored(out, "raked")
        if residual(out) <= tolerance:
            break
    total = out.agg(F.sum("weight")).first()[0] or 1.0
    return out.select("source", "lang", "topic", "tokens", (F.col("weight") / total).alias("weight"))


def residual(cells: DataFrame) -> float:
    """The largest distance of a value's share of the weights from its goal, over the dimensions before the last.

    A round ends with the last dimension, so there all shares are at their goals.
    """
    first = DIMENSIONS[:-1]
    sums = cells.groupingSets([[d] for d in first], *first).agg(F.grouping_id().alias("level"), F.sum("weight").alias("have"), *(F.max(f"goal_{d}").alias(d[0]) for d in first))
    # bit by bit from the left, a dimension's bit is 0 where the row is one of its values
    goal = F.when(F.col("level") == 1, F.col(first[0][0])).otherwise(F.col(first[1][0]))
    return sums.select(F.abs(F.col("have") - goal).alias("far")).agg(F.max("far")).first()[0] or 0.0


def uniform_of(doc_id: Column, seed: str) -> Column:
    """A number from 0 up to 1 that follows from the id (null: from the seed alone)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mixed(docs: DataFrame, *, targets: DataFrame | None = None, power: float = 0.9, tolerance: float = 1e-9, seed: str = "mix", tokens: Column | None = None, topic: Column | None = None, budget: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with tokens, topic, probability and sampled.

    ``targets``: (dimension, value, share); by default each dimension's own shares to ``power``. The scale is
    the largest at which no probability is over one, so no document would be needed twice and none is
    capped; then the one cell with the largest ratio sets the rate of all. With a ``budget``, the share of all
    tokens that is drawn, the scale follows from it alone: probability is how often a document is expected, and
    may be over one, and a column copies has how often it is drawn, its whole repeats and a draw for the rest.
    Probabilities are not rounded, so a document of the rarest cell keeps its chance.
    Null source or language is a value of its own, "". Repeated rows share their probability and
    their draw. Cells whose documents all have no tokens, which only a caller's ``tokens`` can give, are drawn with probability 0. Clashing columns tokens, topic, probability, sampled and, with a budget, copies of ``docs`` are replaced.
    """
    tokens = tokens_of(F.col("text")) if tokens is None else tokens
    topic = topic_of(F.col("text")) if topic is None else topic
    cell = [F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("topic")]
    rows = docs.drop("probability", "sampled").withColumns({"tokens": tokens, "topic": topic})
    cells = stored(rows.groupBy(*(c.alias(d) for c, d in zip(cell, DIMENSIONS))).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, stored(tempered_targets(cells, power), "targets") if targets is None else targets, tolerance=tolerance)
    ratio = raked.withColumn("ratio", F.try_divide("weight", "tokens"))
    # weights sum to one, so by a budget a cell's weight is its share of the tokens to be drawn
    top = ratio.agg(F.max("ratio") if budget is None else F.try_divide(F.lit(1.0), budget * F.sum("tokens"))).first()[0] or 1.0
    chance = stored(ratio.select(F.struct(*DIMENSIONS).alias("cell"), (F.col("ratio") / top).alias("chance")), "chances")
    out = rows.join(chance, F.struct(*(c.alias(d) for c, d in zip(cell, DIMENSIONS))) == chance["cell"], "left").drop(chance["cell"]).withColumn("probability", F.coalesce(chance["chance"], F.lit(0.0))).drop(chance["chance"])
    drawn = uniform_of(F.col("doc_id"), seed)
    if budget is None:
        return out.withColumn("sampled", drawn < F.col("probability"))
    whole = F.floor("probability")
    copies = (whole + (drawn < F.col("probability") - whole).cast("int")).cast("int")
    return out.withColumn("copies", copies).withColumn("sampled", F.col("copies") > 0)


def oracle_sql(rounds: int = 20, power: float = 0.9, seed: str = "mix", budget: float = 0.5) -> str:
    """DuckDB SQL for (doc_id, tokens, topic, probability, copies, sampled) of a draw of ``budget`` of all tokens."""
    steps, last = [], "cells"
    for k in range(rounds):
        for d in DIMENSIONS:
            weight = "CAST(tokens AS DOUBLE)" if last == "cells" else "weight"
            name = f"{d[0]}{k}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, {weight} * (SELECT share FROM targets t WHERE t.dimension = '{d}' AND t.value = c.{d}) / sum({weight}) OVER (PARTITION BY {d}) AS weight FROM {last} c)"
            )
            last = name
    shares = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, pow(CAST(sum(tokens) AS DOUBLE), {power}) AS g FROM cells GROUP BY {d}" for d in DIMENSIONS)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(strlen(coalesce(text, '')) // 4 + 1 AS BIGINT) AS tokens,
    CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(lower(text), 'license') THEN 'notice' WHEN length(coalesce(text, '')) < 500 THEN 'brief'
         WHEN length(text) < 5000 THEN 'article' ELSE 'long' END AS topic FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
grown AS ({shares}),
targets AS MATERIALIZED (SELECT dimension, value, g / sum(g) OVER (PARTITION BY dimension) AS share FROM grown),
{", ".join(steps)},
q AS (SELECT source, lang, topic, weight / tokens * {budget} * sum(tokens) OVER () AS probability FROM {last}),
u AS (SELECT doc_id, tokens, topic, probability, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS drawn
      FROM d JOIN q USING (source, lang, topic)),
c AS (SELECT *, CAST(floor(probability) + CAST(drawn < probability - floor(probability) AS INTEGER) AS INTEGER) AS copies FROM u)
SELECT doc_id, tokens, topic, round(probability, 6) AS probability, copies, copies > 0 AS sampled FROM c
"""
