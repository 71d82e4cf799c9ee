"""Rivals by name: how many entities share the key of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_rivalry(edges: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """log1p of how many entities (s1, key) have the record's key (r, key), and whether the edge's entity does; an empty key has none."""
    n = entities.where("key != ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sharing = records.join(n, "key", "left").select("r", F.col("key").alias("_rk"), F.coalesce("n", F.lit(0)).alias("n"))
    return edges.select("s1", "r").join(sharing, "r", "left").join(entities.select("s1", "key"), "s1", "left").select("s1", "r", F.round(F.log1p(F.coalesce("n", F.lit(0))), 6).alias("sharing"), F.coalesce(F.col("key") == F.col("_rk"), F.lit(False)).alias("same_key"))
