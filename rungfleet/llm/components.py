"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_counted


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its
    smallest node.

    Alternates between pointing each node's larger neighbours to its smallest
    one and pointing its smaller neighbours there, until nothing changes; the
    number of rounds grows with the logarithm of a component's size. A round is
    two aggregations to one value per node, with map-side combining, and two
    joins, so a node with very many edges is never gathered in one place. Each
    round is written to the shared folder. Null nodes and loops are passed over.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    e, before = materialize_counted(e, *state)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        # large star: every neighbour above the centre points to the centre's smallest
        large = e.join(low, F.col("v") == F.col("c")).select(F.col("u"), F.col("m").alias("v")).distinct()
        # small star: the centre and its smaller neighbours point to the smallest of these
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        joined = large.join(low, F.col("u") == F.col("c"))
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c"), F.col("m"))).where("u != v").distinct()
        e, now = materialize_counted(e, *state)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
