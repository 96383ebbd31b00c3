"""Connected components of a link table by alternating star contractions.

Every round is a pre-aggregated minimum per node and an equi-join (which
adaptive execution splits on hot nodes); rounds end when the links no longer
change.  Links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the
    smallest node reachable.  Null ends and self-links are ignored."""
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"),
                      (F.col(a) != F.col(b)).alias("t")).where("t").drop("t").distinct())
    before = None
    while True:
        e = cut(_small_star(_large_star(e)) if before else e, "links")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or tuple(state) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
