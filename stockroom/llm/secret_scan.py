"""Secrets in texts: keywords first, a pattern only where one was met, then the checksum that the secret itself carries.

All keywords of all kinds are looked for in one pass of an Aho-Corasick automaton over the bytes of a text, ASCII letters in
lower case. A kind's pattern is anchored at the hits, from left to right, and never tried elsewhere; so a text without
keywords costs that one pass. Kinds whose secrets hold a checksum (CRC-32 in base 62, Base58Check, Bech32) keep a match
only if it is right, which leaves random look-alikes alone.

Runs of hexadecimal digits have no keyword. A run of 32 or more covers four neighbouring multiples of eight, so every eighth
byte is looked at, and the pattern is anchored at runs of four hits.

Matches of a kind don't overlap: one that is dropped (too short, or a wrong checksum) still ends where it ends, as a search
with the whole pattern would have it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored

SPANS = "array<struct<kind:string,start:long,end:long>>"

#: Alphabets of the checksums.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def crc62(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the CRC-32 of ``body`` in base 62, with zeros before it."""
    n, digits = zlib.crc32(body), bytearray()
    for _ in check:
        n, digit = divmod(n, 62)
        digits.append(BASE62[digit])
    return n == 0 and bytes(digits[::-1]) == check


def base58check(text: bytes, size: int) -> bool:
    """Whether ``text`` is ``size`` bytes in base 58, the last four the head of the others' double SHA-256."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n >= 1 << 8 * size:
        return False
    data = n.to_bytes(size, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32(text: bytes) -> bool:
    """Whether the Bech32 checksum of ``text``, in either case, is right."""
    name, _, data = text.lower().rpartition(b"1")
    state = 1
    for v in [*(c >> 5 for c in name), 0, *(c & 31 for c in name), *map(BECH32.index, data)]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= g if top >> i & 1 else 0
    return state == 1


@dataclass(frozen=True)
class Kind:
    """keywords (in lower case) that every match begins with, the pattern, and whether a match is kept."""

    keywords: tuple[str, ...]
    pattern: re.Pattern
    keep: Callable[[re.Match], bool]


def _long(n: int, group: int = 0) -> Callable[[re.Match], bool]:
    return lambda m: m.end(group) - m.start(group) >= n


#: Kinds whose matches the base digest covers.
BASE: dict[str, Kind] = {
    "assign": Kind(("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), _long(8, 2)),
    "access": Kind(("akia",), re.compile(rb"AKIA[A-Z0-9]+"), _long(16)),
    "hex": Kind((), re.compile(rb"[0-9a-f]+"), _long(32)),
}
#: Kinds that carry a checksum: version control and package tokens, extended private keys, and keys in Bech32.
CHECKED: dict[str, Kind] = {
    "github": Kind(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), lambda m: crc62(m[1], m[2])),
    "npm": Kind(("npm_",), re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), lambda m: crc62(m[1], m[2])),
    "xprv": Kind(("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), lambda m: base58check(m[0], 82)),
    "age": Kind(("age-secret-key-1",), re.compile(rb"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![0-9A-Z])"), lambda m: bech32(m[0])),
    "nsec": Kind(("nsec1",), re.compile(rb"nsec1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{58}(?![0-9a-z])"), lambda m: bech32(m[0])),
}
KINDS = BASE | CHECKED

#: A run of digits is at least so long; every ``STEP``-th byte of a text is looked at.
HEX_RUN, STEP = 32, 8
_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


@cache
def automaton() -> ahocorasick.Automaton:
    """Every keyword with its kind and length; texts come as bytes, each a sign."""
    found = ahocorasick.Automaton()
    for name, kind in KINDS.items():
        for word in kind.keywords:
            found.add_word(word, (name, len(word)))
    found.make_automaton()
    return found


def hex_runs(data: bytes) -> list[int]:
    """Where runs of hexadecimal digits begin, among them all of ``HEX_RUN`` or more."""
    hit = _IS_HEX[np.frombuffer(data, np.uint8)[::STEP]]
    n = HEX_RUN // STEP
    if len(hit) < n:
        return []
    near, end, starts = np.logical_and.reduce([hit[i : len(hit) - n + 1 + i] for i in range(n)]), 0, []
    for at in (np.flatnonzero(near) * STEP).tolist():
        if at < end:
            continue
        start = at
        while start > end and _IS_HEX[data[start - 1]]:
            start -= 1
        starts.append(start)
        end = KINDS["hex"].pattern.match(data, start).end()
    return starts


def scan(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of every secret in a UTF-8 text, by start and then by kind in the order of ``KINDS``."""
    hits: dict[str, list[int]] = {}
    for end, (name, length) in automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(name, []).append(end - length + 1)
    hits["hex"] = hex_runs(data)
    found = []
    for order, (name, kind) in enumerate(KINDS.items()):
        done = 0
        for at in sorted(hits.get(name, ())):
            m = kind.pattern.match(data, at) if at >= done else None
            if m:
                done = m.end()
                if kind.keep(m):
                    found.append((m.start(), order, name, done))
    return [(name, start, end) for start, _, name, end in sorted(found)]


def spans_of(data: bytes) -> list[dict]:
    """``scan`` with places in code points."""
    found = scan(data)
    if not data.isascii():
        places = sorted({p for _, *ends in found for p in ends})
        at, before, points = 0, 0, {}
        for p in places:
            before += len(data[at:p].decode("utf-8", "replace"))
            at, points[p] = p, before
        found = [(kind, points[start], points[end]) for kind, start, end in found]
    return [{"kind": kind, "start": start, "end": end} for kind, start, end in found]


def find_secrets(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and spans (kind, start, end in code points, by start and kind) for each row of ``docs``; stored.

    A null text is empty and has no spans. Repeated rows each return a row; an empty table gives none. Other columns are not
    read; a kept column named spans is an error. Rows never meet, so no key can be hot; a text is scanned whole.
    """
    if "spans" in keep:
        raise ValueError("spans is the result's own column")

    @F.pandas_udf(SPANS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([spans_of(t) for t in batch], dtype=object)

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return stored(docs.select(*keep, spans(body).alias("spans")), "secrets", batch_rows=2000)


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, or of those of some kinds, joined by commas."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[{kind}]") -> Column:
    """A text with each span replaced by ``mark``; of spans that overlap the first stays in the mark's name."""
    before, after = (F.lit(x) for x in mark.split("{kind}"))
    step = lambda done, s: F.when(
        s["start"] >= done["at"], F.struct(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), before, s["kind"], after).alias("out"), s["end"].alias("at"))
    ).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["at"], s["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, from ``find_secrets``'s rows."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(listed(F.col("spans"), tuple(BASE)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(n, BASE), base, listed(F.col("spans")).alias("spans"))
