"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NARROW, dropped, stored

def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the least node that can be reached.

    Steps go on until no edge changes: about the square of the logarithm of the nodes at worst. Nodes of
    no edge, and loops, have no row.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 1 + edges.count() // NARROW)
    size = edges.count()
    while True:
        # large star: neighbours above a node hang on the least of its neighbours and itself
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and itself, hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        before, edges = edges, stored(small, 1 + size // NARROW)
        size = edges.count()
        if edges.join(before, ["u", "v"], "left_anti").isEmpty() and size == before.count():
            dropped(before)
            return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        dropped(before)
