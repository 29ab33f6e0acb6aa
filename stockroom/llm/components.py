"""Connected components of links in shared tables, without a hot key in any grouping.

Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling,
and replaces the links by links between those ends. The smallest node of a component never points away,
so it is what remains. Tables are written between grouping and joining: Spark can then split a hub's rows
in the joins, and groupings only ever take minima, which meet on the map side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, long); root: the smallest node reachable.

    Links with a null end, from a node to itself, repeated or given both ways are allowed. Nodes that
    stand in no link are not returned. No links in, no rows out.
    """
    spark = links.sparkSession
    edges = _edges(links.select("a", "b"))
    labels: DataFrame | None = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = stored(ends.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "pointers")
        moved = True
        while moved:
            step = pointers.select(F.col("node").alias("to"), F.col("to").alias("end"))
            further = stored(pointers.join(step, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "pointers")
            moved = not further.where("moved").isEmpty()
            pointers = further.select("node", "to")
        edges = _edges(
            edges.join(pointers.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(pointers.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        if labels is None:
            labels = pointers.select("node", F.col("to").alias("root"))
        else:
            step = pointers.select(F.col("node").alias("root"), F.col("to").alias("end"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return stored(labels, "components")


def _edges(pairs: DataFrame) -> DataFrame:
    return stored(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
