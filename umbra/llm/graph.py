"""Connected components by alternating large-star and small-star steps, each a few joins; no group meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import settled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge except the smallest of its component; label is that smallest node.

    Self-loops and edges with a null end are ignored. Minima are pre-aggregated, and a hub's rows meet its minimum in
    a join that Spark may split. Each round is written to the shared folder; rounds grow with the logarithm of the
    longest chain.
    """
    now = settled(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, seen = seen, _state(now)
        if last == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
