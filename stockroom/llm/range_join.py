"""Exact range join of vectors by cosine, through cells around pivots.

On unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots are taken from a
sample, each as far as possible from those before it, and every vector belongs to the cell of its nearest
pivot. Cells are in order, and a vector y of cell j is sent as a guest to a cell i before j if it may lie within
r of one of its vectors x. By the triangle inequality that needs d(y, p_i) <= d(x, p_i) + r <= reach_i + r,
where reach_i is the largest distance of the cell's own vectors. And x is nearer to p_i, so it lies on the
other side of the plane halfway between the pivots, and y's distance from that plane,
(d(y, p_i)^2 - d(y, p_j)^2) / (2 d(p_i, p_j)), is at most r. So each pair meets in one cell, and cells are
independent; within a cell own rows and guests are cut into blocks, and each pair of blocks is one bounded
task. The sample also tells how many pivots cost least; that never changes what is found. Equal vectors count
as one, with their number. A pair of blocks gives a row for each linked vector and star links of the local
components, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.components import components
from stockroom.llm.scratch import stored

#: Added to distances before a cell is ruled out, so that rounding rules out no partner.
SLACK = 1e-6
#: What sending a row costs, in pairs compared.
SENT_COST = 2000
#: Rows of a block at most and at least, and blocks that vectors are cut into where there are enough of them.
MOST_ROWS, LEAST_ROWS, BLOCKS = 16_384, 512, 4
#: The share of a vector's components that is looked at first.
PREFIX = 5, 16


def unit(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length (float64 in bytes) as unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v) -> bytes | None:
    if v is None or len(v) == 0 or any(c is None for c in v):
        return None
    x = np.asarray(v, np.float64)
    top = np.abs(x).max()
    # adding zero turns -0.0 into 0.0, so that equal vectors have equal bytes
    return (x / top + 0.0).astype("<f8").tobytes() if np.isfinite(top) and top > 0 else None


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vec): vectors as bytes, scaled so that the largest component is 1; unusable ones are null."""

    # ids stay in Arrow: pandas turns a batch of ids with a null in it into floats
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = pa.array([_usable(v) for v in batch.column("embedding").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec], names=["vec_id", "vec"])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(convert, "vec_id long, vec binary")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


def spread_pivots(sample: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Vectors of ``sample``, each the farthest from those before it, while one is more than half a ``radius`` away."""
    picked, far = [0], distances(sample, sample[:1])[:, 0]
    while len(picked) < most and far.max() > radius / 2:
        picked.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def dealt(d: np.ndarray, between: np.ndarray, reach: np.ndarray | None, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and whether it is a guest of each cell, from its distances ``d`` to the pivots.

    Without ``reach`` it is taken from these rows.
    """
    own = d.argmin(axis=1)
    least = d[np.arange(len(d)), own]
    if reach is None:
        reach = np.full(d.shape[1], -np.inf)
        np.maximum.at(reach, own, least)
    from_plane = (d**2 - least[:, None] ** 2) <= 2 * between[:, own].T * (radius + SLACK) + SLACK
    return own, (np.arange(d.shape[1])[None, :] < own[:, None]) & from_plane & (d <= reach[None, :] + radius + SLACK)


def cheapest(pivots: np.ndarray, sample: np.ndarray, total: int, radius: float, block_rows: int) -> np.ndarray:
    """As many of ``pivots``, in order, as cost least for ``total`` vectors like those of ``sample``."""
    d, between, best = distances(sample, pivots), distances(pivots, pivots), (math.inf, 1)
    k = 1
    while k <= len(pivots):
        own, guest = dealt(d[:, :k], between[:k, :k], None, radius)
        n, g = np.bincount(own, minlength=k) * total / len(sample), guest.sum(axis=0) * total / len(sample)
        blocks, guest_blocks = np.ceil(n / block_rows), np.ceil(g / block_rows)
        cost = (n * (n / 2 + g)).sum() + SENT_COST * (n * (blocks + guest_blocks) + g * blocks).sum()
        best = min(best, (float(cost), k))
        k *= 2
    return pivots[: best[1]]


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each node's root) after joining the nodes ``a`` with the nodes ``b``."""
    root = parent.copy()
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up


def candidates(x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``x`` and of ``y`` with a cosine of at least ``cosine``, in stretches of ``x``.

    A dot product is at most that of the first components plus the product of the others' norms, which is one dot product of
    a third of the length, in single precision with some slack. What passes is computed in full. A stretch where much passes is
    computed in full at once: the result is the same.
    """
    k = max(1, x.shape[1] * PREFIX[0] // PREFIX[1])
    short = lambda v: np.concatenate([v[:, :k], np.linalg.norm(v[:, k:], axis=1, keepdims=True)], axis=1).astype(np.float32)
    own, other = short(x), np.ascontiguousarray(short(y).T)
    for at in range(0, len(x), 256):
        i, j = np.nonzero(own[at : at + 256] @ other >= cosine - 1e-5)
        if len(i) * 50 > len(own[at : at + 256]) * len(y):
            i, j = np.nonzero(x[at : at + 256] @ y.T >= cosine)
        else:
            close = np.einsum("ij,ij->i", x[at + i], y[j]) >= cosine
            i, j = i[close], j[close]
        yield at + i, j


def block_links(x: np.ndarray, x_copies: np.ndarray, y: np.ndarray | None, y_copies: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of each vector of ``x`` and then ``y``, and each one's local root. Without ``y``, of ``x`` with itself."""
    other, weights = (x, x_copies) if y is None else (y, y_copies)
    shift = 0 if y is None else len(x)
    n, parent = np.zeros(shift + len(other), np.int64), np.arange(shift + len(other))
    for i, j in candidates(x, other, cosine):
        if y is None:  # each pair once
            i, j = i[i < j], j[i < j]
        if len(i):
            np.add.at(n, i, weights[j])
            np.add.at(n, j + shift, x_copies[i])
            parent = join_roots(parent, i, j + shift)
    return n, parent


CELL = ["dim", "cell", "left", "right"]


def range_links(rows: DataFrame, *, cosine: float = 0.9, max_pivots: int = 1024, sample_rows: int = 4096, block_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``rows`` (vec_id, embedding).

    n_links: other rows at ``cosine`` or more. component_id: the smallest vec_id reachable by links, itself
    included; kept: it is its own. A vector that is null, empty or zero, or that has a null or non-finite
    component, links with nothing. Vectors of different lengths never link. Equal and repeated rows link with each
    other. A row without vec_id counts as a partner; its component_id is null where no linked row has one.
    Any 64-bit vec_id is returned as it is. ``max_pivots`` and ``sample_rows`` bound what the driver and each task
    hold (vectors); besides, they hold a few numbers for each length that occurs. A pair of blocks holds two times
    ``block_rows`` vectors, by default ``MOST_ROWS``, and fewer where the vectors are few, so that there is work for several tasks.
    """
    own = stored(vectors(rows).withColumn("key", F.unhex(F.sha2("vec", 256))), "vectors")
    first = [F.first("vec").alias("vec"), F.min("vec_id").alias("first"), F.count("*").alias("copies")]
    classes = own.where("vec IS NOT NULL").groupBy("key").agg(*first).withColumns({"no": F.monotonically_increasing_id(), "dim": (F.octet_length("vec") / 8).cast("int")})
    classes = stored(classes, "vector-classes")
    radius = math.sqrt(2 - 2 * cosine)

    total = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    block_rows = block_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-sum(total.values()) // BLOCKS)))
    drawn: dict[int, list[bytes]] = {}
    for r in classes.select("dim", "vec").orderBy(F.xxhash64("vec")).limit(sample_rows).collect():
        drawn.setdefault(r.dim, []).append(bytes(r.vec))
    pivots = {}
    for dim, raw in drawn.items():
        sample = unit(raw)
        pivots[dim] = cheapest(spread_pivots(sample, max_pivots, radius), sample, total[dim], radius, block_rows)
    between = {dim: distances(p, p) for dim, p in pivots.items()}

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, their distances to its pivots); a length without pivots is one cell."""
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = unit(batch.column("vec").take(pa.array(at)).to_pylist()) if dim in pivots else None
            yield int(dim), at, np.zeros((len(at), 1)) if x is None else distances(x, pivots[dim])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, d in by_length(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=["dim", "cell", "apart"])

    size = {(r.dim, r.cell): (r.n, r.reach) for r in classes.select("dim", "vec").mapInArrow(cells, "dim int, cell int, apart double").groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("reach")).collect()}
    width = {dim: len(pivots.get(dim, [0])) for dim in total}
    reach = {dim: np.array([size.get((dim, c), (0, -4.0))[1] for c in range(k)]) for dim, k in width.items()}
    blocks = {dim: np.array([max(1, -(-size.get((dim, c), (0, 0))[0] // block_rows)) for c in range(k)]) for dim, k in width.items()}
    none = np.zeros((1, 1))

    def count_guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, d in by_length(batch):
                n[dim] = n.get(dim, 0) + dealt(d, between.get(dim, none), reach[dim], radius)[1].sum(axis=0)
        for dim, counts in n.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), dim, np.int32)), pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts.astype(np.int64))], names=["dim", "cell", "n"])

    guests = {(r.dim, r.cell): r.n for r in classes.select("dim", "vec").mapInArrow(count_guests, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}
    guest_blocks = {dim: np.array([-(-guests.get((dim, c), 0) // block_rows) for c in range(k)]) for dim, k in width.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, d in by_length(batch):
                home, guest = dealt(d, between.get(dim, none), reach[dim], radius)
                # a row's blocks follow from its number
                mix = ((batch.column("no").to_numpy()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64)
                b = blocks[dim][home]
                block = mix % b
                row = np.repeat(np.arange(len(at)), b)  # own rows: a block meets each block of its cell ...
                other = np.concatenate([np.arange(k) for k in b])
                parts = [(row, home[row], np.minimum(block[row], other), np.maximum(block[row], other), block[row] <= other)]
                row = np.repeat(np.arange(len(at)), guest_blocks[dim][home])  # ... and each block of its guests, which come after
                if len(row):
                    other = np.concatenate([np.arange(k) for k in guest_blocks[dim][home]])
                    parts.append((row, home[row], block[row], b[row] + other, np.ones(len(row), bool)))
                row, cell = np.nonzero(guest)  # guests: a block meets each block of own rows
                if len(row):
                    times = blocks[dim][cell]
                    of, place = np.repeat(np.arange(len(row)), times), blocks[dim][cell] + (mix[row] >> 8) % np.maximum(guest_blocks[dim][cell], 1)
                    parts.append((row[of], cell[of], np.concatenate([np.arange(k) for k in times]), place[of], np.zeros(len(of), bool)))
                for row, cell, left, right, mine in parts:
                    given = [batch.column(c).take(pa.array(at[row])) for c in ("no", "vec", "copies", "dim")]
                    yield pa.RecordBatch.from_arrays([*given, *(pa.array(v.astype(np.int32)) for v in (cell, left, right)), pa.array(mine)], names=["no", "vec", "copies", *CELL, "mine"])

    def compare(met: pa.Table) -> pa.Table:
        mine = met.column("mine").to_numpy()
        alone = met.column("left")[0] == met.column("right")[0]
        order = np.argsort(~mine, kind="stable")
        met, k = met.take(pa.array(order)), int(mine.sum())
        no, copies, vec = met.column("no").to_numpy(), met.column("copies").to_numpy(), met.column("vec").to_pylist()
        if not k or (k == len(no) and not alone):  # one side is empty
            n, parent = np.zeros(len(no), np.int64), np.arange(len(no))
        else:
            n, parent = block_links(unit(vec[:k]), copies[:k], None if alone else unit(vec[k:]), None if alone else copies[k:], cosine)
        told = n > 0
        return pa.table({"no": no[told], "n": n[told], "to": no[parent][told]})

    sent = classes.select("no", "vec", "copies", "dim").mapInArrow(deal, "no long, vec binary, copies long, dim int, cell int, left int, right int, mine boolean")
    met = stored(sent.groupBy(*CELL).applyInArrow(compare, "no long, n long, to long"), "met")
    roots = components(met.select(F.col("no").alias("a"), F.col("to").alias("b")))
    n_links = stored(met.groupBy("no").agg(F.sum("n").alias("n")), "n-links")
    linked = classes.select("key", "no", "first", "copies").join(n_links, "no", "left").join(roots.withColumnRenamed("node", "no"), "no", "left")
    rooted = stored(linked.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "no").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of = stored(rooted.join(least, "root").select("key", "n_links", "component_id"), "vector-links")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return own.select("vec_id", "key").join(of, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
