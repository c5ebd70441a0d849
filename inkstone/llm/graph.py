"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v); the rows come back with u > v, each once."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").repartition("u", "v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of `edges` (u, v): component is the least node that can be reached.

    Ids may be of any ordered type. Loops and repeated edges do no harm; no edges, no rows. A hub's edges are joined
    with one row and then dealt by both ends, so Spark can split them; nothing is gathered by node but a minimum. The number of steps grows with
    the logarithm of the longest path; each step is written to the shared folder.
    """
    now, seen, step = edges.select("u", "v").where("u <> v"), None, 0
    while True:
        now = scratch.table(f"{name}-{step}", _stars(now))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step:
            scratch.drop(f"{name}-{step - 1}")
        if tuple(mark) == seen:
            break
        seen, step = tuple(mark), step + 1
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
