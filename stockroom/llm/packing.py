"""Best-fit packing of token sequences under several capacities at once.

Documents become pieces of at most ``capacity`` tokens. A sequence has a capacity for tokens, for
documents and for attention cost (the sum of squared lengths). Pieces that fill a sequence alone are
set aside. All others are dealt at random into groups of about ``group`` pieces, and each group is packed
by itself: longest piece first, each into the open sequence that has room under every capacity and
ranks best by the weighted residuals, either their dot product with the piece's demands or the norm of
what would be left. Groups are independent, so memory and time in a task stay bounded at any input size;
each leaves about one sequence part empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.encoding import encoder
from stockroom.llm.scratch import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than ``capacity``."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of each document: its ids, then ``end_id``, cut by ``cut``. Null text is the empty text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            of, rows = [], []
            for i, ids in enumerate(tokenizer.ids(batch.column("text").to_pylist())):
                ids += end
                parts = cut(ids, capacity)
                of += [i] * len(parts)
                rows += [(k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])) for k, (start, length) in enumerate(parts)]
            # ids stay in Arrow: pandas turns a batch of ids with a null in it into floats
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, documents: int, attention: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a group."""
    n = len(lengths)
    full = np.array([capacity, documents, attention], float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1) / full
    left = np.ones((n, 3))
    used = np.zeros(n, np.int64)
    bins, at = np.empty(n, np.int64), np.empty(n, np.int64)
    weight = np.asarray(weights, float)
    low = n_open = 0
    for i in np.argsort(-lengths, kind="stable"):
        room = left[low:n_open]
        after = room - demand[i]
        fits = np.flatnonzero((after >= -1e-12).all(axis=1))
        if len(fits):
            if rule == "norm":
                score = -((after[fits] ** 2) @ weight)
            else:
                score = (room[fits] * demand[i]) @ weight
            b = low + fits[np.argmax(score)]
        else:
            b, n_open = n_open, n_open + 1
        bins[i], at[i] = b, used[b]
        used[b] += lengths[i]
        left[b] -= demand[i]
    return bins, at


def pack(
    cut_docs: DataFrame,
    *,
    capacity: int = 2048,
    documents: int = 2048,
    attention: float = 2048.0**2,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
    group: int = 2048,
    oversize: str = "error",
) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``cut_docs`` (a stored table with length, at most ``capacity``).

    ``attention`` may be below ``capacity`` squared, ``documents`` may be 1: each is a capacity of its own, and a piece
    goes only where all three have room. A sequence of at most ``capacity`` tokens never costs more than its square,
    nor holds more than ``capacity`` pieces, so with the defaults only tokens bind.
    ``rule``: "norm" (least weighted norm of the residuals) or "dot" (largest weighted dot product).
    A piece whose attention cost alone is over its capacity is an error, or with ``oversize`` "alone" has a sequence for itself. One with
    more than ``capacity`` tokens is always an error.
    Rows with nulls in other columns and repeated rows are packed like any other; existing columns sequence_id, offset
    and group_no are an error of the caller. Empty in, empty out.
    """
    lone = (F.col("length") >= capacity) | (F.col("length") * F.col("length") > attention)
    of = cut_docs.agg(F.count_if(~lone).alias("n"), F.max("length").alias("longest")).first()
    if documents < 1 or (of.longest or 0) > capacity or (oversize != "alone" and (of.longest or 0) ** 2 > attention):
        raise ValueError("the longest piece doesn't fit in a sequence")
    groups = max(1, -(-of.n // group))
    # a row's group comes from what it holds and, among equal rows, from where it is stored
    mixed = F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(groups))
    columns = cut_docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_docs.schema), "sequence_id long, offset long"])

    def packed(rows: pa.Table) -> pa.Table:
        bins, at = best_fit(rows.column("length").to_numpy(), capacity, documents, attention, weights, rule)
        # even numbers: sequences of groups; odd numbers: pieces that fill one alone
        first = rows.column("group_no")[0].as_py() << 31
        return rows.select(columns).append_column("sequence_id", pa.array(2 * (first + bins))).append_column("offset", pa.array(at))

    small = cut_docs.where(~lone).withColumn("group_no", mixed).groupBy("group_no").applyInArrow(packed, schema)
    alone = cut_docs.where(lone).withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return small.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, **how) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their places; see ``pieces`` and ``pack``."""
    return pack(stored(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), "pieces", batch_rows=500), capacity=capacity, **how)
