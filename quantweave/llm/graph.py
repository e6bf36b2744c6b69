"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantweave.llm.base import staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is the smallest node of the component.

    A round points the larger neighbours of each node at its smallest
    neighbour (large star), then each node and its smaller neighbours at the
    smallest of them (small star); this ends, after a number of rounds that
    grows with the logarithm of the component's size, in one star for each component. Each round
    is written to the shared folder, minima fold map-side, and the edges of a
    hub stay single rows that a skewed join may split. An empty table gives an
    empty result; self links and nulls are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
        before = now
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        edges = staged(small.distinct(), "edges")
