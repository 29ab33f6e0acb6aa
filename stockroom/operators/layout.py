"""Places of mapped rows in their sheets, and the flat listing of a sheet read back.

Only aggregates of (sheet, block) are ordered in windows. Rows are dealt out by ranges of row_seq, whatever numbers these are
(dense, sparse, negative, or hashes), and sorted inside the ranges; counts of each range and block, added up in
the order of the ranges, say where a range's rows of a block begin. So a block of any size is never in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.functions import fixed_values as V
from stockroom.functions.clean import is_blank_dims, is_header, stripped
from stockroom.operators.summary import sheets
from stockroom.sources.shared import small, stored

#: Rows of a listing to a lane of row_idx.
LANE = 1 << 16


class Laid(NamedTuple):
    """What the places of rows and the listing are made from: ``ranged`` rows and their ``parts_of``, both stored."""

    rows: DataFrame
    parts: DataFrame


def ranged(mapped: DataFrame, lane: int | None = None, *, held: bool = False) -> DataFrame:
    """The rows with _part, the range of row_seq that they are in, and _at, their place in it by sheet, block and row_seq; stored.

    The rows are evaluated once and stored: the ranges' bounds and what follows are read from that. ``lane``: about how many rows
    to a range; by default as Spark sizes its partitions. ``held``: the rows come from a stored table, and aren't stored before they are dealt.
    """
    mapped = mapped if held else stored(mapped, "mapped")
    ranges = () if lane is None else (max(1, -(-mapped.count() // lane)),)
    dealt = mapped.repartitionByRange(*ranges, "row_seq").sortWithinPartitions("sheet", "block", "row_seq").withColumn("_p", F.monotonically_increasing_id())
    return stored(dealt.select(*mapped.columns, F.shiftright("_p", 33).cast("int").alias("_part"), F.col("_p").bitwiseAND((1 << 33) - 1).alias("_at")), "ranged")


def parts_of(rows: DataFrame) -> DataFrame:
    """(sheet, block, _part, n, first_seq, first_at) of ``ranged`` rows, stored: all that the order of blocks and rows needs from them."""
    return stored(rows.groupBy("sheet", "block", "_part").agg(F.count("*").alias("n"), F.min("row_seq").alias("first_seq"), F.min("_at").alias("first_at")), "parts")


def block_order(mapped: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(sheet, block, n, first_seq, block_ord): blocks of a sheet in order of their first row. ``parts``: ``parts_of`` these rows."""
    if parts is None:
        blocks = mapped.groupBy("sheet", "block").agg(F.count("*").alias("n"), F.min("row_seq").alias("first_seq"))
    else:
        blocks = parts.groupBy("sheet", "block").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    return blocks.withColumn("block_ord", F.row_number().over(W.partitionBy("sheet").orderBy("first_seq")).cast("long"))


def order_output(mapped: DataFrame) -> DataFrame:
    """Mapped rows with sheet_ord and block_ord, in output order."""
    keys = block_order(mapped).join(F.broadcast(sheets(mapped.sparkSession)), "sheet").select("sheet", "block", "sheet_ord", "block_ord")
    return mapped.join(keys, ["sheet", "block"]).orderBy("sheet_ord", "block_ord", "row_seq")


def block_starts(mapped: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``block_order`` with start: the row of the block's label. A block takes n + 2 rows and a separator."""
    before = F.sum(F.col("n") + 3).over(W.partitionBy("sheet").orderBy("block_ord").rowsBetween(W.unboundedPreceding, -1))
    return block_order(mapped, parts).withColumn("start", F.coalesce(before, F.lit(0)) + 1)


def placed(rows: DataFrame, parts: DataFrame, starts: DataFrame) -> DataFrame:
    """``ranged`` rows with row_idx, from their ``parts_of`` and ``block_starts``."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("sheet", "block").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # where the first row of a block would be if the range began with it
    offset = F.col("start") + 2 + before - F.col("first_at")
    offsets = parts.join(starts.select("sheet", "block", "start"), ["sheet", "block"]).select("sheet", "block", "_part", offset.alias("_offset"))
    kept = [c for c in rows.columns if c not in ("_part", "_at")]
    return rows.join(small(offsets, counted=parts), ["sheet", "block", "_part"]).select(*kept, (F.col("_offset") + F.col("_at")).cast("long").alias("row_idx"))


def laid_out(mapped: DataFrame, lane: int | None = None, *, held: bool = False) -> Laid:
    """The layout of mapped rows, for ``positions`` and ``grid``: who needs both lays the rows out once. ``lane`` and ``held``: as of ``ranged``."""
    rows = ranged(mapped, lane, held=held)
    return Laid(rows, parts_of(rows))


def positions(laid: Laid) -> DataFrame:
    """The rows with row_idx, their place in the sheet; equal row_seq may take each other's place."""
    return placed(laid.rows, laid.parts, block_starts(laid.rows, laid.parts))


def layout_positions(mapped: DataFrame, lane: int | None = None) -> DataFrame:
    """``positions`` of mapped rows. ``lane``: as of ``ranged``."""
    return positions(laid_out(mapped, lane))


def sheet_grid(mapped: DataFrame) -> DataFrame:
    """``grid`` of mapped rows."""
    return grid(laid_out(mapped))


def grid(laid: Laid) -> DataFrame:
    """(sheet, row_idx, c1..c8): the listing of each sheet, with labels, headers, rows and blank separators."""
    placed_rows, parts = laid
    starts = stored(block_starts(placed_rows, parts), "starts")
    empty = [F.lit("").alias(f"c{i}") for i in range(1, 9)]
    last = F.max("block_ord").over(W.partitionBy("sheet"))
    line = lambda at, cells: starts.select("sheet", at.cast("long").alias("row_idx"), *(F.lit(c).alias(f"c{i}") for i, c in enumerate(cells, 1)))
    labels = starts.select("sheet", F.col("start").cast("long").alias("row_idx"), F.col("block").alias("c1"), *empty[1:])
    heads = line(F.col("start") + 1, [*V.MAPPED_HEADERS, "", ""])
    gaps = starts.withColumn("_last", last).where("block_ord < _last").select("sheet", (F.col("start") + F.col("n") + 2).cast("long").alias("row_idx"), *empty)
    rows = placed(placed_rows, parts, starts).select("sheet", "row_idx", *(F.col(h).alias(f"c{i}") for i, h in enumerate(V.MAPPED_HEADERS, 1)), *empty[6:])
    return labels.unionByName(heads).unionByName(rows).unionByName(gaps)


def known_sheets(df: DataFrame) -> DataFrame:
    """Rows of the six sheets."""
    return df.where(F.col("sheet").isin(V.SHEETS))


def blank_dim_rows(grid: DataFrame, lane: int = LANE) -> DataFrame:
    """(sheet, row_idx, brand, sku, link): rows of a flat listing that are in a block and have no dimensions.

    A header row opens a block; a row whose first two cells are empty closes it. The last such row before a
    row is looked for in its own lane of row_idx, and else among the lanes' last ones.
    """
    rows = known_sheets(grid).withColumns({"_lane": F.floor(F.col("row_idx") / lane), "_b": stripped(F.col("c1")), "_p": stripped(F.col("c2"))})
    opens = F.when(is_header(F.col("c1"), F.col("c2")), 1).when((F.col("_b") == "") & (F.col("_p") == ""), 0)
    marked = rows.withColumn("_mark", opens)
    lanes = marked.groupBy("sheet", "_lane").agg(F.max_by(F.col("_mark"), F.when(F.col("_mark").isNotNull(), F.col("row_idx"))).alias("_last"))
    earlier = lanes.select("sheet", "_lane", F.last("_last", ignorenulls=True).over(W.partitionBy("sheet").orderBy("_lane").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    here = F.last("_mark", ignorenulls=True).over(W.partitionBy("sheet", "_lane").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0))
    state = marked.withColumn("_here", here).join(earlier, ["sheet", "_lane"])
    inside = F.coalesce("_here", "_carried", F.lit(0)) == 1
    wanted = inside & (F.col("_p") != "") & (F.col("_b") != "Brand") & is_blank_dims(F.col("c3"), F.col("c4"), F.col("c5"))
    return state.where(wanted).select("sheet", "row_idx", F.col("_b").alias("brand"), F.col("_p").alias("sku"), stripped(F.col("c6")).alias("link"))


def blank_rows_of(positions: DataFrame) -> DataFrame:
    """The same rows taken straight from ``layout_positions``, without reading a listing back."""
    kept = positions.where(is_blank_dims(F.col("Height"), F.col("Width"), F.col("Depth"))).where(stripped(F.col("Product")) != "")
    return kept.select("sheet", "row_idx", stripped(F.col("Brand")).alias("brand"), stripped(F.col("Product")).alias("sku"), stripped(F.col("Link")).alias("link"))
