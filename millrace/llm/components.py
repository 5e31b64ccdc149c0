"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, keep


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Joins each node's neighbours to the least of them and the node: all greater ones, or all lesser ones."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    if both_ways:
        least = least.select("a", F.least("a", "m").alias("m"))
        out = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = around.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of ``edges`` (a, b: bigint, not null) reaches.

    Large-star and small-star steps by turns, which need about as many rounds as the logarithm of the
    longest chain; a step joins each node's neighbours to their least one, so that no node's neighbours
    are gathered in one place. Every step is written to the shared folder with a file per core at most,
    and deleted once the next is there. Repeated edges, loops and both directions are allowed; no edges
    give no rows.
    """
    spark = edges.sparkSession
    width = spark.sparkContext.defaultParallelism
    # each edge runs from its greater node to its lesser one
    now, at = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", width)
    state = None
    while True:
        large, at_large = keep(_star(now, True), "edges", width)
        small, at_small = keep(_star(large, False), "edges", width)
        forget(spark, at, at_large)
        now, at = small, at_small
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
