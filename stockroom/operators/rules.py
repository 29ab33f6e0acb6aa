"""Routing of catalogue rows to (sheet, block) by ordered rules, the first match winning.

A catalogue has the columns brand, product_group, subcategory, product_name, sku, link and row_seq, and any
others. Rules come as plain lists or as tables. A list is folded into one expression: no join, no shuffle,
and the number of rules is bounded by what a person can keep in order. A table of rules may be of any length: it
is turned into an index of the grams of its terms, and joined by these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V
from stockroom.functions.clean import brand_key, contains_any, stripped
from stockroom.functions.dimensions import once
from stockroom.sources.shared import small, stored

#: Names of columns for the field names that override rules use.
FIELDS = {"Brand": "brand", "Product Group": "product_group", "Subcategory": "subcategory", "Product Name": "product_name", "Model / SKU": "sku"}
RULE_SCHEMA = "rule_ord int, product_group string, terms array<string>, sheet string, block string"
OVERRIDE_SCHEMA = "ovr_ord int, rule_ord int, product_group string, triggers array<string>, check_fields array<string>, keywords array<string>, sheet string, block string"


def default_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(V.RULES)], RULE_SCHEMA)


def default_overrides(spark: SparkSession) -> DataFrame:
    """The built-in override rules as a table, one row for each keyword rule."""
    return spark.createDataFrame([(i, j, g, t, f, k, s, b) for i, (g, t, rules) in enumerate(V.OVERRIDES) for j, (f, k, s, b) in enumerate(rules)], OVERRIDE_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a JSON file: {"rules": [{product_group, subcategory_contains, m10_sheet, block}]}, in order."""
    schema = "rules array<struct<product_group:string,subcategory_contains:array<string>,m10_sheet:string,block:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("rules"))
    empty = F.array().cast("array<string>")
    return _known_sheets_only(rows.select(F.col("pos").alias("rule_ord"), F.coalesce("col.product_group", F.lit("")).alias("product_group"), F.coalesce("col.subcategory_contains", empty).alias("terms"), F.col("col.m10_sheet").alias("sheet"), "col.block"))


def load_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override rules from a JSON file: {"overrides": [{product_group, trigger_subcategory_contains, rules}]}."""
    rule = "struct<check_fields:array<string>,keyword_contains:array<string>,m10_sheet:string,block:string>"
    schema = f"overrides array<struct<product_group:string,trigger_subcategory_contains:array<string>,rules:array<{rule}>>>"
    of = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("overrides").alias("ovr_ord", "o"))
    rows = of.select("ovr_ord", "o", F.posexplode("o.rules").alias("rule_ord", "r"))
    empty, fields = F.array().cast("array<string>"), F.array(F.lit("Product Name"), F.lit("Model / SKU"))
    return _known_sheets_only(
        rows.select(
            "ovr_ord", "rule_ord", F.coalesce("o.product_group", F.lit("")).alias("product_group"), F.coalesce("o.trigger_subcategory_contains", empty).alias("triggers"),
            F.coalesce("r.check_fields", fields).alias("check_fields"), F.coalesce("r.keyword_contains", empty).alias("keywords"), F.col("r.m10_sheet").alias("sheet"), "r.block",
        )
    )


def _known_sheets_only(rules: DataFrame) -> DataFrame:
    known = F.col("sheet").isin(V.SHEETS) | F.coalesce("sheet", F.lit("")).isin("")
    return rules.withColumn("sheet", F.when(known, F.col("sheet")).otherwise(F.raise_error(F.concat(F.lit("no such sheet: "), "sheet"))))


def resolve_block(block: Column, subcategory: Column) -> Column:
    """A rule's block, or the row's own subcategory where the rule says so."""
    own = stripped(subcategory)
    return F.when(block == V.USE_SUBCATEGORY, F.when(own == "", F.lit("Uncategorised")).otherwise(own)).otherwise(block)


def _holds(low: Column, terms: list[str]) -> Column:
    """Whether a text in lower case holds any term literally: one pattern, so that a long list stays one expression."""
    quoted = ["\\Q" + t.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in terms]
    return low.rlike("|".join(quoted)) if quoted else F.lit(False)


def _first(tests: list[Column]) -> Column:
    """Number of the first test that is true, else null."""
    none = F.lit(None).cast("int")
    if not tests:
        return none
    return reduce(lambda chain, it: chain.when(it[1], F.lit(it[0])), enumerate(tests[1:], 1), F.when(tests[0], F.lit(0))).otherwise(none)


def _rule_tests(rules: list, row: Column) -> list[Column]:
    return [(row["group"] == want.lower()) & (_holds(row["low"], terms) if terms else F.lit(True)) for want, terms, _, _ in rules]


def _override_tests(overrides: list, row: Column) -> list[Column]:
    """A test for each keyword rule; the texts that it looks at are fields of ``row``."""
    tests = []
    for want, triggers, rules in overrides:
        fires = (row["group"] == want.lower()) if want else F.lit(True)
        if triggers:
            fires = fires & _holds(row["low"], triggers)
        tests += [fires & _holds(row[_checked_name(fields)], keywords) for fields, keywords, _, _ in rules]
    return tests


def _checked_name(fields: list[str]) -> str:
    return "text of " + ", ".join(fields).replace(".", "_")


def _checked(fields: list[str], columns: list[str]) -> Column:
    """The named fields joined by spaces, in lower case. A field that the catalogue lacks reads as empty."""
    names = [FIELDS.get(f, f) for f in fields]
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) if n in columns else F.lit("") for n in names)))


def _named(number: Column, names: list[str | None]) -> Column:
    return F.get(F.array(*(F.lit(n).cast("string") for n in names)), number) if names else F.lit(None).cast("string")


def compiled(catalogue: DataFrame, rules: list, overrides: list) -> DataFrame:
    """Adds sheet and block (null: no rule matches) and _rule: the number of the first match, overrides first.

    The lists are folded into one expression. An override that is triggered but finds no keyword leaves the row to
    the next one, and then to the rules.
    """
    looked = {_checked_name(f): f for _, _, inner in overrides for f, _, _, _ in inner}
    texts = [_checked(f, catalogue.columns).alias(name) for name, f in looked.items()]
    row = F.struct(brand_key(F.col("product_group")).alias("group"), F.lower(stripped(F.col("subcategory"))).alias("low"), *texts)
    # one number for both outcomes; a filter on them that reaches this computes it once more
    number = once(row, lambda x: _first(_override_tests(overrides, x) + _rule_tests(rules, x)))
    targets = [(s, b) for _, _, inner in overrides for _, _, s, b in inner] + [(s, b) for _, _, s, b in rules]
    numbered = catalogue.withColumn("_rule", number)
    block = _named(F.col("_rule"), [b for _, b in targets])
    return numbered.withColumns({"sheet": _named(F.col("_rule"), [s for s, _ in targets]), "block": resolve_block(block, F.col("subcategory"))})


#: Signs to a gram of the rule index.
GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` signs of a text, none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def rule_index(rules: DataFrame) -> DataFrame:
    """(group, gram, term, rule_ord): each term of a group once, with its first rule, under its rarest gram.

    A term of fewer than ``GRAM`` signs is its own gram. A rule without terms, or with an empty one, has neither gram nor term. So a text
    can hold a term only if it holds the gram that the term is filed under.
    """
    group, terms = F.lower("product_group").alias("group"), F.transform("terms", F.lower)
    anything = (F.size("terms") == 0) | F.array_contains(terms, "")
    listed = rules.select("rule_ord", group, F.explode(F.when(anything, F.array(F.lit(None).cast("string"))).otherwise(F.filter(terms, lambda t: t.isNotNull()))).alias("term"))
    first = listed.groupBy("group", "term").agg(F.min("rule_ord").alias("rule_ord"))
    grams = F.when(F.length("term") < GRAM, F.array("term")).otherwise(_grams(F.col("term"), GRAM))
    filed = first.where("term IS NOT NULL").withColumn("gram", F.explode(grams))
    common = filed.groupBy("group", "gram").agg(F.count("*").alias("n"))
    rarest = filed.join(common, ["group", "gram"]).groupBy("group", "term", "rule_ord").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    none = F.lit(None).cast("string")
    return rarest.select("group", "gram", "term", "rule_ord").unionByName(first.where("term IS NULL").select("group", none.alias("gram"), none.alias("term"), "rule_ord"))


def match_rules(catalogue: DataFrame, rules: DataFrame, key: str = "row_seq") -> DataFrame:
    """(key, sheet, block) of the first matching row of a table of rules.

    Distinct (group, subcategory) are matched, not rows: each meets the rule of its group that asks for nothing, and through the grams
    of its text the terms that are filed under one of them (``rule_index``). So a hundred thousand rules of one group
    cost a text its own length, and never rows by rules. Both joins are equal joins.
    """
    index = stored(rule_index(rules), "rule-index")
    asked = catalogue.select(brand_key(F.col("product_group")).alias("group"), stripped(F.col("subcategory")).alias("_sub")).distinct()
    texts = stored(asked.join(small(index.select("group").distinct()), "group", "left_semi").withColumn("_low", F.lower("_sub")), "rule-texts")
    sizes = [r.n for r in index.where("gram IS NOT NULL").select(F.length("gram").alias("n")).distinct().collect()]
    own = F.flatten(F.array(*(_grams(F.col("_low"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    met = texts.withColumn("gram", F.explode(own)).join(small(index.where("gram IS NOT NULL")), ["group", "gram"]).where(F.contains("_low", "term")).select("group", "_sub", "rule_ord")
    plain = texts.join(small(index.where("gram IS NULL").select("group", "rule_ord")), "group").select("group", "_sub", "rule_ord")
    first = stored(met.unionByName(plain).groupBy("group", "_sub").agg(F.min("rule_ord").alias("rule_ord")).join(small(rules.select("rule_ord", "sheet", "block")), "rule_ord"), "rule-hits")
    rows = catalogue.select(key, brand_key(F.col("product_group")).alias("group"), stripped(F.col("subcategory")).alias("_sub"), "subcategory")
    return rows.join(small(first), ["group", "_sub"]).select(key, "sheet", resolve_block(F.col("block"), F.col("subcategory")).alias("block"))


def match_overrides(catalogue: DataFrame, overrides: DataFrame, key: str = "row_seq") -> DataFrame:
    """(key, sheet, block) of the first override rule of a table whose keyword is found.

    A row has its group and the empty one as keys, so that overrides for any group are found by the same equal join. The
    table is broadcast after its rows are counted; a longer one is joined by shuffling.
    """
    names = {v: k for k, v in FIELDS.items()}
    cells = F.create_map(*(x for c in catalogue.columns for x in (F.lit(names.get(c, c)), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))))
    rows = catalogue.select(key, brand_key(F.col("product_group")).alias("_group"), stripped(F.col("subcategory")).alias("_sub"), "subcategory", cells.alias("_cells"))
    o = overrides.select("ovr_ord", "rule_ord", "triggers", "check_fields", "keywords", "sheet", "block", F.lower("product_group").alias("_group"))
    met = rows.withColumn("_group", F.explode(F.array_distinct(F.array("_group", F.lit(""))))).join(small(o), "_group")
    checked = F.array_join(F.transform("check_fields", lambda f: F.coalesce(F.try_element_at("_cells", f), F.lit(""))), " ")
    hits = met.where((F.size("triggers") == 0) | contains_any(F.col("_sub"), F.col("triggers"))).where(contains_any(checked, F.col("keywords")))
    first = hits.groupBy(key).agg(F.min_by(F.struct("sheet", resolve_block(F.col("block"), F.col("subcategory")).alias("block")), F.struct("ovr_ord", "rule_ord")).alias("t"))
    return first.select(key, "t.sheet", "t.block")


def unmapped_reason(groups: list[str]) -> Column:
    """Why a row matched no rule; ``groups``: the groups that rules name."""
    group, sub = stripped(F.col("product_group")), stripped(F.col("subcategory"))
    before, after = V.UNKNOWN_GROUP.split("{group}")
    s0, s1, s2 = V.UNKNOWN_SUBCATEGORY.replace("{group}", "{subcategory}").split("{subcategory}")
    return (
        F.when(group == "", F.lit(V.MISSING_GROUP))
        .when(~F.lower(group).isin([g.lower() for g in groups]), F.concat(F.lit(before), group, F.lit(after)))
        .otherwise(F.concat(F.lit(s0), sub, F.lit(s1), group, F.lit(s2)))
    )


def classify(catalogue: DataFrame, rules: list | None = None, overrides: list | None = None) -> DataFrame:
    """Adds sheet, block and reason to a catalogue; either the reason or the other two are null.

    A matched rule with an empty sheet or block leaves the row unmapped, with its reason "Unknown".
    """
    rules, overrides = V.RULES if rules is None else rules, V.OVERRIDES if overrides is None else overrides
    found = compiled(catalogue, rules, overrides)
    full = (F.coalesce("sheet", F.lit("")) != "") & (F.coalesce("block", F.lit("")) != "")
    reason = F.when(~full, F.when(F.col("_rule").isNull(), unmapped_reason([r[0] for r in rules])).otherwise(F.lit(V.UNKNOWN)))
    return found.withColumns({"sheet": F.when(full, F.col("sheet")), "block": F.when(full, F.col("block")), "reason": reason}).drop("_rule")


def mapped(classified: DataFrame) -> DataFrame:
    """Rows with a destination: dimensions are blank, the SKU is the product."""
    blank = F.lit("")
    return classified.where("sheet IS NOT NULL").select("sheet", "block", "row_seq", F.col("brand").alias("Brand"), F.col("sku").alias("Product"), blank.alias("Height"), blank.alias("Width"), blank.alias("Depth"), F.col("link").alias("Link"))


def unmapped(classified: DataFrame) -> DataFrame:
    """Rows without a destination, with the reason."""
    order = ["brand", "product_group", "subcategory", "sku", "product_name", "reason", "link"]
    return classified.where("sheet IS NULL").select("row_seq", *(F.col(c).alias(n) for c, n in zip(order, V.UNMAPPED_HEADERS)))
