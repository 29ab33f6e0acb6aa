"""Cells, keys and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom.functions.fixed_values import NA_WORDS

#: White space in the Unicode sense; plain trim takes only spaces.
WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(col: Column) -> Column:
    """Text without white space at its ends; null is empty."""
    return F.coalesce(F.btrim(col, F.lit(WS)), F.lit(""))


#: Whole floats from here on are no longs.
_BEYOND_LONG = 9e18
_LIMB = 1_000_000_000


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def _exact_digits(size: Column) -> Column:
    """Every digit of a whole double of ``_BEYOND_LONG`` or more: its leading bits as a long, doubled in base 10^9."""
    # one bit less than the logarithm says, so that its rounding doesn't matter; powers of two are exact
    shift = (F.floor(F.log2(size)) - 53).cast("int")
    bits = (size / F.pow(F.lit(2.0), shift)).cast("long")

    def times(limbs: Column, factor: Column) -> Column:
        step = lambda done, limb: F.struct(
            F.concat(done["out"], F.array((limb * factor + done["carry"]) % _LIMB)).alias("out"), _div(limb * factor + done["carry"], _LIMB).alias("carry")
        )
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(limbs, start, step, lambda done: F.when(done["carry"] > 0, F.concat(done["out"], F.array(done["carry"]))).otherwise(done["out"]))

    factors = F.concat(F.array_repeat(F.lit(1 << 20).cast("long"), _div(shift.cast("long"), 20).cast("int")), F.array(F.pow(F.lit(2.0), shift % 20).cast("long")))
    limbs = F.reverse(F.aggregate(factors, F.array(bits % _LIMB, _div(bits, _LIMB)), times))
    shown = F.transform(limbs, lambda limb, i: F.when(i == 0, limb.cast("string")).otherwise(F.lpad(limb.cast("string"), 9, "0")))
    return F.regexp_replace(F.array_join(shown, ""), "^0+(?=.)", "")


def _number_text(col: Column) -> Column:
    """A float as a spreadsheet reader's text: whole ones as all their digits; below 1e-4 with an exponent; inf and -inf."""
    value, said = col.cast("double"), col.cast("string")
    size, sign = F.abs(value), F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.when(size < _BEYOND_LONG, F.when(size < _BEYOND_LONG, value).cast("long").cast("string")).otherwise(F.concat(sign, _exact_digits(F.when(size >= _BEYOND_LONG, size))))
    # said is d.dddE-n below 1e-3, d.dddEn from 1e7 on
    first, rest = F.regexp_extract(said, r"(\d)\.", 1), F.regexp_replace(F.regexp_extract(said, r"\.(\d+)E", 1), "^0$", "")
    power = F.regexp_extract(said, r"E-?(\d+)", 1)
    large = F.concat(sign, first, F.substring(rest, F.lit(1), power.try_cast("int")), F.lit("."), F.substring(rest, power.try_cast("int") + 1, F.length(rest)))
    tail = F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit(""))
    tiny = F.concat(sign, first, tail, F.lit("e-"), F.when(F.length(power) < 2, F.lit("0")).otherwise(F.lit("")), power)
    return (
        F.when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(value % 1 == 0, whole)
        .when(size >= 1e7, large)
        .when(size >= 1e-3, said)
        .when(size >= 1e-4, F.concat(sign, F.lit("0.000"), first, rest))
        .otherwise(tiny)
    )


def clean_cell(col: Column, kind: str = "string", na_values: bool = False) -> Column:
    """A cell as text: null and NaN empty, whole floats as all their digits without a point, the rest stripped.

    No float stops the job: infinities are inf and -inf, and fractions below 1e-4 have an exponent of two digits at least.

    ``kind``: the Spark type name of the column. ``na_values``: whether words for missing values are empty.
    """
    if kind in ("double", "float"):
        return F.when(col.isNull() | F.isnan(col), F.lit("")).otherwise(_number_text(col))
    if kind == "boolean":
        return F.coalesce(F.initcap(col.cast("string")), F.lit(""))
    text = stripped(col.cast("string"))
    return F.when(text.isin(NA_WORDS), F.lit("")).otherwise(text) if na_values else text


def contains_any(text: Column, terms: list[str] | Column) -> Column:
    """Whether the text holds any term as a literal substring in any case; no term: false."""
    low = F.lower(text)
    if isinstance(terms, Column):
        return F.exists(terms, lambda t: F.contains(low, F.lower(t)))
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(low, F.lit(term.lower()))
    return found


def url_key(col: Column) -> Column:
    """A URL as cache key: stripped, without any slash at its end."""
    return F.rtrim(stripped(col), F.lit("/"))


def brand_key(col: Column) -> Column:
    """A brand as routing key: stripped and in lower case."""
    return F.lower(stripped(col))


def is_blank_dims(h: Column, w: Column, d: Column) -> Column:
    """Whether height, width and depth are all blank."""
    return (stripped(h) == "") & (stripped(w) == "") & (stripped(d) == "")


def is_header(first: Column, second: Column) -> Column:
    """Whether a row's first cells are those of a header row."""
    return (stripped(first) == "Brand") & (stripped(second) == "Product")
