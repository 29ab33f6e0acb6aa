"""SimHash fingerprints, and links between fingerprints at few differing bits by the general pigeonhole.

If the 64 bits are split into parts with thresholds t_i whose t_i + 1 sum to k + 1, two fingerprints that
differ in at most k bits differ in at most t_i bits of some part i (a threshold of -1 skips its part). Each
fingerprint is stored once for each part by that part's bits; from each, every key within the part's
threshold is probed, and what is found is verified by all bits. A sample of the distinct fingerprints
serves to group bits that vary together and to estimate, for each part and threshold, how many candidates
it would give; dynamic programming then allocates the thresholds. The sample only changes the cost of a
plan: every plan finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.components import components
from stockroom.llm.scratch import stored

BITS = 64
#: Widths of the parts that the planner tries.
WIDTHS = ((32, 32), (22, 21, 21), (28, 18, 18), (32, 16, 16), (16, 16, 16, 16), (22, 14, 14, 14), (13, 13, 13, 13, 12))
#: Cost of a row shuffled for a probe, and of a pair verified inside the join.
PROBE_COST, VERIFY_COST = 1.0, 0.05


def simhash(text: str | None, shingle: int) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number.

    A-Z become lower case, words are runs other than space and U+0009 to U+000D, shingles are joined by a
    space and repeats count. Fewer words than a shingle: the whole sequence is one. No word: zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); null text has no words."""

    # ids stay in Arrow: pandas turns a batch of ids with a null in it into floats
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, fp long")


def grouped_bits(sample: np.ndarray, widths: tuple[int, ...]) -> list[list[int]]:
    """Parts of the given widths: each grows from the bits that correlate most with those it has."""
    spread = sample.std(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        tied = np.nan_to_num(np.abs(np.corrcoef(sample, rowvar=False))) if len(sample) > 1 else np.zeros((BITS, BITS))
    np.fill_diagonal(tied, 0)
    free, parts = set(range(BITS)), []
    for width in widths:
        part = [min(free, key=lambda b: (spread[b], b)) if len(sample) else min(free)]
        free.remove(part[0])
        while len(part) < width:
            nearest = max(free, key=lambda b: (tied[b, part].mean(), -b))
            part.append(nearest)
            free.remove(nearest)
        parts.append(sorted(part))
    return parts


def close_share(sample: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Estimated share of all pairs that differ in at most 0, 1, ... ``most`` bits of a part."""
    chance = np.zeros(len(part) + 1)
    chance[0] = 1.0
    for b in part:  # as if bits were independent
        p = sample[:, b].mean() if len(sample) else 0.5
        differ = max(2 * p * (1 - p), 1e-3)
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    share = np.cumsum(chance)[: most + 1]
    n = len(sample)
    if n > 1:  # and as the sample has it
        x = sample[:, part].astype(np.float32)
        apart = np.zeros(most + 1)
        for at in range(0, n, 512):
            y = x[at : at + 512]
            d = y.sum(1)[:, None] + x.sum(1)[None, :] - 2 * y @ x.T
            apart += [(np.rint(d) <= t).sum() for t in range(most + 1)]
        share = np.maximum(share, (apart - n) / (n * (n - 1)))
    return share


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with t_i + 1 summing to ``total`` at the least sum of costs[i][t_i + 1]."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * total
    for cost in costs:
        best = [min((best[s - u][0] + cost[u], best[s - u][1] + [u - 1]) for u in range(min(s, len(cost) - 1) + 1)) for s in range(total + 1)]
    return best[total]


def plan(sample: np.ndarray, rows: int, k: int) -> list[tuple[list[int], int]]:
    """The cheapest parts and thresholds for ``rows`` distinct fingerprints; skipped parts are left out."""
    found = (float("inf"), [])
    for widths in WIDTHS:
        parts = grouped_bits(sample, widths)
        costs = []
        for part in parts:
            share = close_share(sample, part, k)
            costs.append([0.0] + [PROBE_COST * rows * (1 + sum(comb(len(part), j) for j in range(t + 1))) + VERIFY_COST * share[t] * rows * (rows - 1) / 2 for t in range(k + 1)])
        cost, thresholds = allocate(costs, k + 1)
        if cost < found[0]:
            found = (cost, [(part, t) for part, t in zip(parts, thresholds) if t >= 0])
    return found[1]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _probes(part: int, key: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, flips)), lambda e: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(e).alias("key")))


def links(distinct: DataFrame, *, k: int = 3, sample_rows: int = 2000) -> DataFrame:
    """(a, b): the nodes of all pairs of fingerprints of ``distinct`` (fp, node; no fp twice) at 1 to ``k`` bits, once for each part that finds them."""
    rows = distinct.count()
    drawn = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).collect()]
    bits = np.unpackbits(np.array(drawn, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    stored_keys, probes = [], []
    for i, (part, t) in enumerate(plan(bits, rows, k)):
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in part))))
        stored_keys.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        flips = [_signed(sum(1 << b for b in flip)) for j in range(t + 1) for flip in combinations(part, j)]
        probes.append(_probes(i, key, flips))
    index = distinct.select(F.col("fp").alias("y"), F.col("node").alias("b"), F.explode(F.array(*stored_keys)).alias("at")).select("y", "b", "at.part", "at.key")
    probe = distinct.select(F.col("fp").alias("x"), F.col("node").alias("a"), F.explode(F.concat(*probes)).alias("at")).select("x", "a", "at.part", "at.key")
    close = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= k)
    return probe.join(index, (probe.part == index.part) & (probe.key == index.key) & close).select("a", "b")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, k: int = 3, sample_rows: int = 2000, batch_rows: int = 500) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs`` (doc_id, text).

    Rows are in one component if a chain of fingerprints, each at most ``k`` bits from the next, leads
    from one to the other; component_id is the smallest doc_id in it (null if it has none). Rows with the
    same fingerprint (copies, all texts without words) are one node, so copies are never paired. Repeated
    rows and rows without doc_id return a row each. Any 64-bit doc_id is returned as it is. Empty in, empty out.
    """
    own = stored(fingerprints(docs, shingle=shingle), "fingerprints", batch_rows=batch_rows)
    # a fingerprint is its own node, so ids play no part before the end
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.col("fp").alias("node"), "first"), "distinct-fingerprints")
    found = components(links(distinct.select("fp", "node"), k=k, sample_rows=sample_rows))
    rooted = stored(distinct.join(found, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root")), "rooted")
    of_root = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")
    of = stored(rooted.join(of_root, "root").select("fp", "component_id"), "component-of")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near duplicates by similarity -------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; of a text with fewer words, the hash of all of them."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64))


def views_of(hashes: np.ndarray, views: int, sample: int) -> list[int]:
    """SimHash fingerprints of ``views`` samples: of each view the ``sample`` shingles with the smallest salted hashes.

    Two texts with a share J of their shingles in common have the same sample in a view with a chance of
    about J to the power of ``sample``.
    """
    if not len(hashes):
        return [0] * views
    salts = (np.arange(1, views + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    mixed = (hashes[None, :] ^ salts) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    n = min(sample, len(hashes))
    least = np.argpartition(mixed, n - 1, axis=1)[:, :n]
    bits = np.unpackbits(np.take_along_axis(mixed, least, axis=1).astype("<u8").view(np.uint8).reshape(views, n, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1) > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def block_roots(sets: list[np.ndarray], left: int, similarity: float, known: np.ndarray | None = None) -> np.ndarray:
    """For each of ``sets`` (of distinct hashes) the smallest position that links between two sides lead to.

    The first ``left`` sets meet all others; if they are all, each meets each. ``known``: a component of each
    set, known before. Only pairs that are in one component already are not compared.
    """
    n = len(sets)
    start = 0 if left == n else left
    sizes = np.array([len(s) for s in sets[start:]])
    values, owners = np.concatenate(sets[start:]), np.repeat(np.arange(n - start), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    root = np.arange(n)
    if known is not None:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        root = first[which.ravel()]
    for i in range(left):
        own = sets[i]
        if not len(own) or (root[start:] == root[i]).all():
            continue
        low = np.searchsorted(values, own, "left")
        times = np.searchsorted(values, own, "right") - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        common = np.bincount(owners[at], minlength=n - start)
        near = np.flatnonzero(common >= similarity * (len(own) + sizes - common))
        joined = np.unique(np.append(root[start + near], root[i]))
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
    return root


SIDES = ["bucket", "mine", "theirs"]


def links_in_blocks(sides: DataFrame, similarity: float) -> DataFrame:
    """(a, b): star links of the local components of pairs of blocks of ``sides`` (bucket, mine, theirs, moves, node, label, shingles).

    The rows of a (bucket, mine, theirs) that move meet each of the others; label is a component that a row is in already. A
    task reads its pairs of blocks one after another, and holds one of them.
    """

    def pair(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(rows).combine_chunks()
        order = np.argsort(~both.column("moves").to_numpy(), kind="stable")
        left, node, label = int(both.column("moves").to_numpy().sum()), both.column("node").to_numpy()[order], both.column("label").to_numpy()[order]
        sets = both.column("shingles").chunk(0)
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        root = block_roots([flat[at[i] : at[i + 1]] for i in order], left, similarity, label) if left else np.arange(len(node))
        linked = label[root] != label
        return pa.RecordBatch.from_arrays([pa.array(label[linked]), pa.array(label[root[linked]])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SIDES], axis=1) if len(batch) else np.zeros((0, 3), int)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                if held and tuple(key[at]) != of:
                    yield pair(held)
                    held = []
                of = tuple(key[at])
                held.append(batch.slice(at, end - at))
        if held:
            yield pair(held)

    return sides.repartition(*SIDES).sortWithinPartitions(*SIDES).mapInArrow(compare, "a long, b long")


def text_key() -> Column:
    """Digest of the column text as it is, null as empty; with the id, it tells rows apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def linked_in_buckets(docs: DataFrame, nodes: DataFrame, members: DataFrame, *, similarity: float, shingle: int, block_rows: int, batch_rows: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b), stored: verified links that join what is alike inside the buckets of ``members`` (view, key, key2, node; no row twice).

    ``nodes``: (node, text_key) of all texts. ``known``: (node, root) that links lead to already; nodes of one root aren't compared.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes((t or "").encode().lower().split(), shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "shingles"])

    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    filled = members.groupBy("view", "key", "key2").agg(F.count("*").alias("n"), *sums).where("n > 1")
    # buckets with the same members count once
    buckets = stored(filled.groupBy("n", "x0", "x1").agg(F.min(F.struct("view", "key", "key2")).alias("at")).select("n", "at.*").withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    met = stored(members.join(buckets, ["view", "key", "key2"]).select("bucket", "n", "node"), "met")

    # one text for each node in a bucket, and its shingles
    wanted = met.groupBy("node").agg(F.sum("n").alias("reach"))
    wanted = stored(wanted.join(nodes.select("node", "text_key"), "node"), "candidates")
    # equal texts meet on the map side, and the join uses the grouping's partitions
    texts = docs.groupBy(text_key().alias("text_key")).agg(F.first("text").alias("text")).join(wanted.select("text_key", "node").hint("merge"), "text_key").select("node", "text")
    held = stored(texts.mapInArrow(sets, "node long, shingles array<long>"), "shingles", batch_rows=batch_rows)

    # 1: against the hub and the smallest of each bucket
    ranked = met.join(wanted.select("node", "reach"), "node")
    leaders = stored(ranked.groupBy("bucket").agg(F.max_by("node", F.struct("reach", -F.col("node"))).alias("hub"), F.min("node").alias("least")), "leaders")
    led = stored(met.join(leaders, "bucket"), "led")
    tried = led.select("node", F.explode(F.array("hub", "least")).alias("leader")).where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    if known is not None:
        mine, theirs = (known.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        tried = tried.join(mine, "a", "left").join(theirs, "b", "left").where("NOT coalesce(ra, a) <=> coalesce(rb, b)").select("a", "b")
    left, right = (held.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common >= similarity * (F.size("sa") + F.size("sb") - common)
    first = stored(stored(tried, "tried").join(left, "a").join(right, "b").where((F.size("sa") > 0) & alike).select("a", "b"), "verified")
    if known is not None:
        first = stored(first.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links-so-far")
    labels = components(first)

    # 2: what is still apart in a bucket; its leaders have met everyone
    labelled = stored(led.where("node != hub AND node != least").join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label")), "labelled")
    shares = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    apart = stored(shares.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).where("n > most.n").select("bucket", "n", (F.col("n") - F.col("most.n")).alias("movers"), F.col("most.label").alias("main")), "apart")
    still = labelled.join(apart, "bucket").join(held, "node").select("bucket", "node", "label", "shingles", F.col("label") != F.col("main"), *(F.ceil(F.col(c) / block_rows).alias(f"{c}_blocks") for c in ("movers", "n"))).toDF("bucket", "node", "label", "shingles", "moves", "movers_blocks", "n_blocks")
    place = lambda blocks: F.pmod(F.xxhash64("node", "bucket"), F.col(blocks)).alias("own")
    span = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    plain = ["node", "label", "shingles"]
    # movers against movers and all others: a mover's block goes to each block of all, and each row of all to each block of movers
    mine = still.where("moves").select("bucket", place("movers_blocks").alias("mine"), span("n_blocks").alias("theirs"), F.lit(True).alias("moves"), *plain)
    theirs = still.select("bucket", span("movers_blocks").alias("mine"), place("n_blocks").alias("theirs"), F.lit(False).alias("moves"), *plain)
    rest = stored(links_in_blocks(mine.unionByName(theirs), similarity), "verified", batch_rows=batch_rows)
    return stored(first.unionByName(rest), "all-links")


def text_components(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, k: int = 3, views: int = 14, sample: int = 4, block_rows: int = 512, batch_rows: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) of ``docs`` (doc_id, text): rows has doc_id, text_key and node for each row; roots (node, root).

    A node is a distinct sequence of words (A-Z in lower case); its rows may have any ids, or none. Nodes are
    linked if their sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more, found among
    two kinds of candidates: texts with the same fingerprint, of the whole or in one of ``views`` samples of ``sample``
    shingles; and fingerprints of the whole texts at most ``k`` bits apart, by the general pigeonhole. Whole fingerprints alone don't
    reach this similarity: at 0.8 they differ in about ten bits. All texts with the same fingerprint are a bucket, and
    no pair in a bucket goes untested unless a chain of verified links joins it already:

    1. Each member is verified against two others of its bucket: the one whose buckets are the largest in sum,
       which is the hub of a group of copies if it has one, and the smallest.
    2. Links found make components. Where a bucket still holds several, all members outside its largest component
       are compared with all members, in blocks of about ``block_rows`` by as many, each pair of blocks by itself.

    Then each pair of fingerprints a few bits apart is a bucket in the same way, but only where its texts are not in one
    component by now: a dense family of copies, which has nearly as many such pairs as pairs, is joined before it gets here.

    Verification is on 64-bit hashes of all shingles of the whole texts. roots has every node. Texts may be as long as memory
    holds one; null is empty, and texts without words are one node. Empty in, empty out.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [(t or "").encode().lower().split() for t in texts]
            found = [
                pa.array([xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                pa.array([simhash(t, shingle) for t in texts], pa.int64()),
                pa.array([views_of(shingle_hashes(w, shingle), views, sample) for w in words], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *found], names=["doc_id", "text_key", "content", "fp", "views"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    own = stored(keyed.mapInArrow(sketch, "doc_id long, text_key binary, content binary, fp long, views array<long>"), "sketches", batch_rows=batch_rows)
    nodes = stored(own.groupBy("content").agg(F.first("fp").alias("fp"), F.first("views").alias("views"), F.min("text_key").alias("text_key")).withColumn("node", F.monotonically_increasing_id()), "texts")
    rows = own.select("doc_id", "text_key", "content").join(nodes.select("content", "node"), "content").select("doc_id", "text_key", "node")
    how = {"similarity": similarity, "shingle": shingle, "block_rows": block_rows, "batch_rows": batch_rows}

    # buckets of the views and of equal whole fingerprints
    bucket = F.posexplode(F.concat("views", F.array("fp"))).alias("view", "key")
    members = stored(nodes.select("node", bucket).select("view", "key", F.lit(0).cast("long").alias("key2"), "node"), "members")
    verified = linked_in_buckets(docs, nodes, members, **how)
    roots = components(verified)

    # pairs of fingerprints whose texts are still apart; a fingerprint's texts may be of several components
    rooted = stored(nodes.select("node", "fp").join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root")), "rooted")
    distinct = stored(rooted.groupBy("fp").agg(F.min("node").alias("node"), F.min("root").alias("low"), F.max("root").alias("high")), "distinct-fingerprints")
    ends = [distinct.select(F.col("node").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ab"]
    together = "low_a = high_a AND low_b = high_b AND low_a = low_b"
    near = stored(links(distinct.select("fp", "node"), k=k).join(ends[0], "a").join(ends[1], "b").where(f"NOT ({together})").select("a", "b").distinct(), "fingerprint-links")
    if not near.isEmpty():
        heads = near.select("a", "b", F.explode(F.array("a", "b")).alias("head")).join(distinct.select("fp", F.col("node").alias("head")), "head").select("fp", "a", "b")
        pairs = stored(heads.join(rooted.select("node", "fp"), "fp").select(F.lit(-1).alias("view"), F.col("a").alias("key"), F.col("b").alias("key2"), "node"), "members")
        roots = components(linked_in_buckets(docs, nodes, pairs, known=roots, **how))
    return rows, nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def similar_documents(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text); see ``text_components`` for links.

    component_id is the smallest doc_id of the component, null where no row of it has one. Repeated rows and rows
    without doc_id return a row each. Texts without words are one component. Any 64-bit doc_id is allowed.
    """
    rows, roots = text_components(docs, **how)
    of_rows = stored(rows.join(roots, "node").select("doc_id", "root"), "rows-by-component")
    return of_rows.join(stored(of_rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids"), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` (with doc_id and text) for each component of ``text_components``, with all its columns.

    It is a row with the smallest doc_id that the component has, and without one only where no row has an id; among
    different texts with that id the one with the smallest digest. Of rows equal in both any one stays.
    """
    rows, roots = text_components(docs, **how)
    counted = rows.groupBy("node", "doc_id", "text_key").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key", "n")
    best = counted.groupBy("node").agg(F.min(rank).alias("row"))
    chosen = stored(best.join(roots, "node").groupBy("root").agg(F.min("row").alias("row")).select("row.*"), "chosen")
    # the ids grow with the corpus, so they are shuffled to the texts at every size
    key = ["doc_id", "text_key"]
    own = "_text_key" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of the caller's
    given = docs.withColumn(own, text_key())
    match = lambda of: given["doc_id"].cast("long").eqNullSafe(of["doc_id"]) & (given[own] == of["text_key"])
    once, repeated = chosen.where("n = 1").select(*key), chosen.where("n > 1").select(*key)
    kept = given.join(once.hint("merge"), match(once), "left_semi")
    if not repeated.isEmpty():
        kept = kept.unionByName(given.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", own]))
    return kept.drop(own)
