"""Connected components of links by alternating stars, on DataFrames.

Each round lets every node point its larger neighbours at its smallest one (large star), then
every node point its smaller neighbours at the smallest (small star). The links that are left
form stars around the smallest node of each component. Minima are aggregated before the
shuffle, so a hub costs one row per task; each round is written, so a lost executor repeats
one round at most. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for each node with a link to another."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, mark = materialize(edges, "links"), None
    while True:
        told = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if told == mark:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        mark = told
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        ends = edges.groupBy("lo").agg(F.lit(1).alias("x")).select("lo")
        # large star: the neighbours above u go to the smallest of u and all its neighbours
        centre = ends.join(least.withColumnRenamed("hi", "lo"), "lo", "left").select("lo", F.coalesce("m", "lo").alias("m"))
        large = edges.join(centre, "lo").select("hi", F.col("m").alias("lo")).distinct()
        large = materialize(large, "large-star")
        # small star: u and its neighbours below go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(
            F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        edges = materialize(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), "small-star")
