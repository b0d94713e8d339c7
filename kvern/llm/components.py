"""Connected components by alternating large-star and small-star steps.

Every step is one aggregate with map-side combine and one join; nothing is
collected but two counters per round. A hub with a third of all edges is one row
of the aggregate, and a skewed key of the join's larger side, which adaptive
execution splits (an edge is two numbers, so even then a task holds little).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.session import discard, materialize


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge; root is the smallest node of its component.

    Edges may be repeated, point either way or be loops; an edge with a null end
    is left out. A node without an edge to another node has no row.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialize(e)
    before = None
    while True:
        # large star: larger neighbours of u go to the smallest of u and all its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _nearest(both).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = _nearest(large)
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        discard(e)
        e = after
        # one star per component: no node is both a leaf and a centre, no leaf has two centres
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
