"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) and the least of u and all its v. The key beside u has both sides dealt out anew, so that Spark can split a hub."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    return pairs.withColumn("k", F.xxhash64("u")).join(least.withColumn("k2", F.xxhash64("hub")), (F.col("k") == F.col("k2")) & (F.col("u") == F.col("hub"))).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    """edges(u, v) with u > v; both stars once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = _with_least(large)
    return small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, root: each node that some edge joins to another, and the least node of its component.

    Ends when a round changes nothing; each round is written to the shared folder. Null ends and loops are dropped."""
    a, b = F.col(left), F.col(right)
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, before = seen, now
        now = materialize(_round(before), "edges")
        discard(before)
