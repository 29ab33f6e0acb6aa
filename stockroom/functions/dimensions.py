"""Dimensions from (label, value) pairs, as expressions on arrays: no row leaves its page.

A page's pairs are folded once, from the first to the last, into the first value of each axis, whether a later one differs, and
the lines that a person would want to see. The fold is written as SQL text, which is built, parsed and analysed in a few
milliseconds; the functions of columns below put the same pieces of text to use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V
from stockroom.functions.clean import WS, stripped


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def applied(text: str, **given: Column) -> Column:
    """An SQL expression of x, which has the given columns as fields."""
    return F.get(F.call_function("transform", F.array(F.struct(*(c.alias(name) for name, c in given.items()))), F.expr(f"x -> {text}")), F.lit(0))


# pieces of SQL: each takes and gives expressions as text ---------------------------------------------------


def _let(name: str, value: str, text: str) -> str:
    """``text`` with ``name`` standing for ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {text}), 0)"


def _use(label: str, convention: str) -> str:
    cavity, overall = f"{label} RLIKE r'{V.CAVITY_LABEL}'", f"{label} RLIKE r'{V.OVERALL_LABEL}'"
    return {"overall": f"(NOT {cavity} OR {overall})", "cavity": f"(NOT {overall} OR {cavity})"}.get(convention, "true")


def _unit(label: str, value: str) -> str:
    of = lambda c: f"nullif(lower(regexp_extract({c}, r'{V.UNIT}', 1)), '')"
    return f"coalesce({of(label)}, {of(value)}, 'mm')"


def _mm(number: str, unit: str) -> str:
    parts = f"transform(split({number}, r'{V.RANGE_SIGN}'), n -> try_cast(n AS DECIMAL(36, 0)) * 10)"
    scaled = _let("ns", parts, "CASE WHEN forall(ns, n -> n IS NOT NULL) THEN array_join(transform(ns, n -> CAST(CAST(n AS DECIMAL(38, 0)) AS STRING)), '-') END")
    return f"CASE WHEN {unit} = 'cm' THEN coalesce({scaled}, {number}) ELSE coalesce(btrim({number}, '{WS}'), '') END"


def _axes(label: str) -> str:
    listed = ", ".join(f"upper(regexp_extract({label}, r'{V.AXIS_TRIPLET}', {i}))" for i in (1, 2, 3))
    return f"CASE WHEN {label} RLIKE r'{V.AXIS_TRIPLET}' THEN array({listed}) ELSE CAST(array() AS ARRAY<STRING>) END"


def _numbers(value: str) -> str:
    return f"regexp_extract_all(replace({value}, ',', ''), r'{V.NUMBER}', 0)"


def _axis(label: str, match: str) -> str:
    hit = (lambda w: f"contains(lower({label}), '{w}')") if match == "substring" else (lambda w: rf"lower({label}) RLIKE r'(?U)\b{w}\b'")
    return "CASE " + " ".join(f"WHEN {hit(word)} THEN '{axis}'" for word, axis in V.SINGLE_AXIS) + " END"


def _said(label: str, value: str, use: str, match: str) -> str:
    """array<struct<axis, value>> of one pair; ``use``: whether its label counts."""
    none = "CAST(array() AS ARRAY<STRUCT<axis: STRING, value: STRING>>)"
    q = f"named_struct('axes', {_axes(label)}, 'numbers', {_numbers(value)}, 'unit', {_unit(label, value)})"
    pair = lambda axis, number: f"named_struct('axis', {axis}, 'value', {_mm(number, 'q.unit')})"
    last = "filter({}, (p, i) -> NOT exists(slice(q.axes, i + 2, 3), later -> later = p.axis))"
    triplet = f"CASE WHEN size(q.numbers) >= {V.TRIPLET_NUMBERS} THEN {last.format(f'transform(q.axes, (a, i) -> {pair("a", "get(q.numbers, i)")})')} ELSE {none} END"
    alone = _let("axis", _axis(label, match), f"CASE WHEN axis IS NOT NULL AND size(q.numbers) > 0 THEN array({pair('axis', 'get(q.numbers, 0)')}) ELSE {none} END")
    return f"CASE WHEN {use} THEN {_let('q', q, f'CASE WHEN size(q.axes) > 0 THEN {triplet} ELSE {alone} END')} ELSE {none} END"


_NOTHING = "named_struct('h', CAST(NULL AS STRING), 'w', CAST(NULL AS STRING), 'd', CAST(NULL AS STRING), 'conflict', false, 'lines', CAST(array() AS ARRAY<STRING>), 'skipped', CAST(array() AS ARRAY<STRING>))"


def _step(convention: str, match: str) -> str:
    """What a further pair adds: the first value of an axis stays, and a later one that differs is a conflict."""
    first = ", ".join(f"'{a.lower()}', coalesce(acc.{a.lower()}, get(filter(v, x -> x.axis = '{a}'), 0).value)" for a in "HWD")
    differs = "coalesce(exists(v, x -> CASE x.axis WHEN 'H' THEN acc.h WHEN 'W' THEN acc.w ELSE acc.d END <> x.value), false)"
    kept = lambda name, most, when: f"CASE WHEN size(acc.{name}) < {most} AND {when} THEN concat(acc.{name}, array(concat(p.label, ': ', p.value))) ELSE acc.{name} END"
    lines, skipped = kept("lines", V.RAW_LINES, "true"), kept("skipped", V.SKIPPED_LINES, f"NOT used AND p.label RLIKE r'{V.CAVITY_LABEL}'")
    grown = f"named_struct({first}, 'conflict', acc.conflict OR {differs}, 'lines', {lines}, 'skipped', {skipped})"
    return f"(acc, p) -> {_let('used', _use('p.label', convention), _let('v', _said('p.label', 'p.value', 'used', match), grown))}"


_RAW = f"concat(array_join(acc.lines, '\n'), CASE WHEN size(acc.skipped) > 0 THEN concat('\n{V.SKIPPED}', array_join(acc.skipped, '; ')) ELSE '' END)"


def _verdict(h: str, w: str, d: str, conflict: str) -> str:
    """(confidence, reason) as SQL; a conflict is tested first."""
    shown = V.PARTIAL.split("{")[0], *(f" {a}=" for a in "WD")
    partial = "concat(" + ", ".join(f"'{before}', coalesce({c}, 'None')" for before, c in zip(shown, (h, w, d))) + ")"
    say = lambda c, r: f"named_struct('confidence', '{c}', 'reason', {r})"
    some, every = (f"({h} IS NOT NULL {word} {w} IS NOT NULL {word} {d} IS NOT NULL)" for word in ("OR", "AND"))
    conflicts = f"'{V.CONFLICT}'"
    return f"""CASE WHEN {conflict} THEN {say(V.NEEDS_REVIEW, conflicts)} WHEN {every} THEN {say(V.RESOLVED, "''")} WHEN {some} THEN {say(V.NEEDS_REVIEW, partial)} ELSE {say(V.NOT_FOUND, "''")} END"""


def _folded(pairs: Column, finish: str, convention: str, match: str) -> Column:
    return F.call_function("aggregate", pairs, F.expr(_NOTHING), F.expr(_step(convention, match)), F.expr(f"acc -> {finish}"))


# functions of columns -----------------------------------------------------------------------------------


def is_dim_label(label: Column) -> Column:
    """Whether a label is about dimensions. A plural needs one of the single words beside it."""
    return label.rlike(V.DIMENSION_LABEL)


def use_label(label: Column, convention: str = "overall") -> Column:
    """Whether a label counts under a convention: "overall", "cavity", or any other word for all labels."""
    return applied(_use("x.label", convention), label=label)


def detect_unit(label: Column, value: Column) -> Column:
    """The unit in brackets in the label, else in the value, else mm."""
    return applied(_unit("x.label", "x.value"), label=label, value=value)


def to_mm(number: Column, unit: Column) -> Column:
    """A number or range in mm as text. Only cm is scaled; anything that isn't digits stays as it is."""
    return applied(_mm("x.number", "x.unit"), number=number, unit=unit)


def axis_order(label: Column) -> Column:
    """The axes that a label lists, such as W, H, D; empty if it lists none."""
    return applied(_axes("x.label"), label=label)


def parse_numbers(value: Column) -> Column:
    """Numbers and ranges in a value, without thousands commas. A decimal point parts two numbers."""
    return applied(_numbers("x.value"), value=value)


def single_axis(label: Column, match: str = "substring") -> Column:
    """The axis that a label without a triplet names; null if none.

    ``match``: "substring" takes the first listed word that occurs anywhere, so "Depth" falls under "h";
    "word" takes whole words only.
    """
    return applied(_axis("x.label", match), label=label)


def pair_values(label: Column, value: Column, convention: str = "overall", match: str = "substring") -> Column:
    """array<struct<axis, value>>: what one pair says. Of an axis listed twice the last number counts."""
    return applied(_said("x.label", "x.value", _use("x.label", convention), match), label=label, value=value)


def resolve_dims(pairs: Column, convention: str = "overall", match: str = "substring") -> Column:
    """struct<h, w, d, conflict> from an ordered array of struct<label, value> of dimension labels.

    The first value of an axis is kept; any later one that differs is a conflict.
    """
    return _folded(pairs, "named_struct('h', acc.h, 'w', acc.w, 'd', acc.d, 'conflict', acc.conflict)", convention, match)


def raw_text(pairs: Column, convention: str = "overall") -> Column:
    """The first lines of what was read, and the first cavity lines that were skipped."""
    return _folded(pairs, _RAW, convention, "substring")


def confidence(h: Column, w: Column, d: Column, conflict: Column) -> Column:
    """struct<confidence, reason>; a conflict is tested first."""
    return applied(_verdict("x.h", "x.w", "x.d", "x.conflict"), h=h, w=w, d=d, conflict=conflict)


def dimension_result(pairs: Column, source_url: Column, convention: str = "overall", match: str = "substring") -> Column:
    """struct<height, width, depth, confidence, source_url, raw_text, reason> from dimension pairs."""
    told = f"named_struct('height', acc.h, 'width', acc.w, 'depth', acc.d, 'raw_text', {_RAW}, 'verdict', {_verdict('acc.h', 'acc.w', 'acc.d', 'acc.conflict')})"
    got = F.struct(_folded(pairs, told, convention, match).alias("r"), source_url.alias("url"))
    fields = "'height', x.r.height, 'width', x.r.width, 'depth', x.r.depth, 'confidence', x.r.verdict.confidence, 'source_url', x.url, 'raw_text', x.r.raw_text, 'reason', x.r.verdict.reason"
    return F.get(F.call_function("transform", F.array(got), F.expr(f"x -> named_struct({fields})")), F.lit(0))


def pairs_from_text(text: Column) -> Column:
    """array<struct<label, value>> of the lines of a text that read "label: value" (or with a tab)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), V.LINE_END, -1), stripped)
    kept = F.filter(lines, lambda line: line.rlike(V.TEXT_PAIR))
    return F.transform(kept, lambda line: F.struct(stripped(F.regexp_extract(line, V.TEXT_PAIR, 1)).alias("label"), stripped(F.regexp_extract(line, V.TEXT_PAIR, 2)).alias("value")))
