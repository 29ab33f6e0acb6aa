"""Fill-in-the-middle texts, put together by a secondary sort.

A text is cut into prefix, middle and suffix at token boundaries, and each part into chunks of so many tokens. The chunks,
not the texts, are shuffled: keyed by document and by place in the output, repartitioned by document and sorted inside the
partitions (``repartitionAndSortWithinPartitions``, as ``repartition`` and ``sortWithinPartitions`` of a DataFrame: the sort
spills). A document's chunks then stream past an incremental digest, however long it is. What was read gives the original
order back: marks in the output say which part a chunk is of, a second sort inside the same partitions puts the parts in
order, and a second digest is taken of the restored text. Nothing needs a whole text at once but the cutting itself.

A document's key is the partition it was read from, and a digest of its id and text: it doesn't change when a lost task runs
again, and a row repeated many times is spread as its partitions are. Equal rows of one partition share a key; their chunks
are told apart by counting the first ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = re.compile(rb"(<[PSM]>)")
#: Places of the parts in the original text.
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Tokens to a chunk; a chunk of very long tokens is cut further.
CHUNK_TOKENS, CHUNK_BYTES = 8192, 1 << 18
META = ("doc_id", "n", "form", "prefix_chars", "middle_chars")


def token_starts(text: bytes) -> np.ndarray:
    """Where the tokens of a UTF-8 text begin, in bytes: a run of ASCII letters, or any other code point alone."""
    data = np.frombuffer(text, np.uint8)
    low = data | 0x20
    letter = (low >= ord("a")) & (low <= ord("z"))
    begins = ~letter & ((data & 0xC0) != 0x80)
    begins |= letter & ~np.concatenate([[False], letter[:-1]])
    return np.flatnonzero(begins)


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def form_of(text: bytes, h3: int, h4: int, fim_percent: int, spm_percent: int) -> str:
    """plain, psm or spm: plain also where the text is empty or holds a mark."""
    if not text or h3 % 100 >= fim_percent or MARK.search(text):
        return "plain"
    return "spm" if h4 % 100 < spm_percent else "psm"


def chunks(text: bytes, bounds: np.ndarray, first: int, last: int, tokens: int, size: int) -> list[bytes]:
    """Tokens ``first`` to ``last`` of a text, ``tokens`` at a time; at least one chunk, which may be empty."""
    cuts = [*bounds[first:last:tokens].tolist(), int(bounds[last])]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return [p[i : i + size] for p in parts for i in range(0, len(p), size)] or [b""]


def cut(text: bytes, draw: str, fim_percent: int, spm_percent: int, tokens: int = CHUNK_TOKENS, size: int = CHUNK_BYTES) -> tuple[tuple, list[bytes]]:
    """(n, form, prefix_chars, middle_chars) and the chunks of the output, in order; ``draw``: 32 hex digits or more."""
    starts = token_starts(text)
    n, bounds = len(starts), np.append(starts, len(text))
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = form_of(text, h3, h4, fim_percent, spm_percent)
    if form == "plain":
        return (n, form, None, None), chunks(text, bounds, 0, n, tokens, size)
    part = {PREFIX: chunks(text, bounds, 0, a, tokens, size), MIDDLE: chunks(text, bounds, a, b, tokens, size), SUFFIX: chunks(text, bounds, b, n, tokens, size)}
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    told = (n, form, code_points(text[: bounds[a]]), code_points(text[bounds[a] : bounds[b]]))
    return told, [mark + c if not i else c for mark in order for i, c in enumerate(part[mark])]


def _table(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in types.items()], names=list(types))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def sorted_chunks(docs: DataFrame, *, text: str = "text", id: str = "doc_id", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, tokens: int = CHUNK_TOKENS, size: int = CHUNK_BYTES) -> DataFrame:
    """(lane, row, place, doc_id, n, form, prefix_chars, middle_chars, piece): each partition in order of document and place."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    given = docs.select(F.spark_partition_id().alias("lane"), F.col(id).alias("doc_id"), draw.alias("draw"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = {"lane": pa.int32(), "row": pa.binary(), "place": pa.int32(), "doc_id": batch.schema.field("doc_id").type, "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "piece": pa.binary()}
            out = []
            for lane, key, told, body in _rows(batch):
                row = xxhash.xxh3_128(told.encode())
                row.update(body)
                meta, pieces = cut(body, told, fim_percent, spm_percent, tokens, size)
                out += [(lane, row.digest(), place, key, *meta, piece) for place, piece in enumerate(pieces)]
            yield _table(dict(zip(kinds, map(list, zip(*out)), strict=True)) if out else dict.fromkeys(kinds, []), kinds)

    schema = f"lane int, row binary, place int, doc_id {docs.schema[id].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, piece binary"
    return given.mapInArrow(emit, schema).repartition("lane", "row").sortWithinPartitions("lane", "row", "place")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes | None, int, tuple]]:
    """Of sorted chunks: (key, piece, copies so far, meta); at the end of each document its key again and no piece."""
    now, at, copies, meta = None, -1, 0, ()
    for batch in batches:
        for lane, row, place, *rest in _rows(batch):
            if (lane, row) != now:
                if now is not None:
                    yield now, None, copies, meta
                now, at, copies, meta = (lane, row), -1, 0, tuple(rest[:-1])
            copies += place == 0
            if place != at:  # the same place again: a row equal to this one
                at = place
                yield now, rest[-1], copies, meta
    if now is not None:
        yield now, None, copies, meta


def fill_middle(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output (binary UTF-8) for each row of ``docs``.

    ``how``: as of ``sorted_chunks``. A null text is empty, an empty one is plain; a null id draws as an empty one. Repeated
    rows each return a row; an empty table gives none. Other columns are not read, whatever their names. An output is
    as long as its text: only ``digests`` is free of whole texts.
    """
    kind = docs.schema[how.get("id", "doc_id")].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, own = _typed(batches)
        kinds = {"doc_id": own, "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
        pieces: list[bytes] = []
        for _, piece, copies, meta in _documents(batches):
            if piece is not None:
                pieces.append(piece)
                continue
            one = _table(dict(zip(kinds, ([x] for x in (*meta, b"".join(pieces))))), kinds)
            pieces = []
            for _ in range(copies):
                yield one

    return sorted_chunks(docs, **how).mapInArrow(join, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], pa.DataType]:
    """The batches, and the type of their doc_id."""
    first = next(batches, None)
    if first is None:
        return iter(()), pa.int64()

    def all_of() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    return all_of(), first.schema.field("doc_id").type


def assembled(chunked: DataFrame) -> DataFrame:
    """``sorted_chunks`` read once: chunks with their part's rank and place in it, then a row with the output's digest.

    Inside the same partitions the rows are sorted again, by document, rank and place: the original order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, own = _typed(batches)
        kinds = {"lane": pa.int32(), "row": pa.binary(), "rank": pa.int32(), "at": pa.int32(), "piece": pa.binary(), "doc_id": own, "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "copies": pa.int64(), "output_sha256": pa.string()}
        out, held, digest, rank, at = [], 0, hashlib.sha256(), 0, 0
        for key, piece, copies, meta in _documents(batches):
            if piece is None:
                out.append((*key, END, 0, None, *meta, copies, digest.hexdigest()))
                digest, rank, at = hashlib.sha256(), 0, 0
            else:
                digest.update(piece)
                for part in [piece] if meta[2] == "plain" else MARK.split(piece):
                    if part in RANK and meta[2] != "plain":
                        rank, at = RANK[part], 0
                    elif part:
                        out.append((*key, rank, at, part, *meta, None, None))
                        at, held = at + 1, held + len(part)
            if len(out) >= 4096 or held >= 4 << 20:
                yield _table(dict(zip(kinds, map(list, zip(*out)))), kinds)
                out, held = [], 0
        if out:
            yield _table(dict(zip(kinds, map(list, zip(*out)))), kinds)

    kind = chunked.schema["doc_id"].dataType.simpleString()
    schema = f"lane int, row binary, rank int, at int, piece binary, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, copies long, output_sha256 string"
    return chunked.mapInArrow(read, schema).sortWithinPartitions("lane", "row", "rank", "at")


#: The rank of a document's last row, after all its parts.
END = 3


def digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for each row; see ``fill_middle``.

    restored_sha256 is of the text rebuilt from the output and its form. Chunks alone are held, never a whole text.
    """
    kind = docs.schema[how.get("id", "doc_id")].dataType.simpleString()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, own = _typed(batches)
        kinds = {"doc_id": own, "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}
        digest = hashlib.sha256()
        for batch in batches:
            out = []
            for _, _, rank, _, piece, *meta, copies, output in _rows(batch):
                if rank < END:
                    digest.update(piece)
                else:
                    out += [(*meta, output, digest.hexdigest())] * copies
                    digest = hashlib.sha256()
            if out:
                yield _table(dict(zip(kinds, map(list, zip(*out)))), kinds)

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return stored(assembled(sorted_chunks(docs, **how)).mapInArrow(restore, schema), "fill-middle", batch_rows=2000)


_H = "('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), {at}, 8))::UBIGINT"

ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    {_H.format(at=1)} AS h1, {_H.format(at=9)} AS h2, {_H.format(at=17)} AS h3, {_H.format(at=25)} AS h4 FROM documents),
u AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM u),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM f),
x AS (SELECT *, instr(output, '<P>') AS ip, instr(output, '<S>') AS xs, instr(output, '<M>') AS im FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, ip + 3, xs - ip - 3) || substr(output, im + 3) || substr(output, xs + 3, im - xs - 3)
        ELSE substr(output, ip + 3, im - ip - 3) || substr(output, im + 3) || substr(output, xs + 3, ip - xs - 3) END) AS restored_sha256
FROM x"""
