"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Tables


def connected_components(tables: Tables, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp): comp is the smallest vertex that v reaches over the edges; isolated vertices have no row.

    Alternating large-star and small-star steps, one written table a round, until every edge leads from a vertex to
    the smallest of its component: about log(n) rounds on a path of n vertices in any order.  No step adds edges.
    Hubs cost no more than their edges: minima are combined map-side and the joins are plain sort-merge joins that
    AQE may split.
    """
    # every edge leads from its larger vertex s to its smaller one d
    edges = tables.save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("s"), F.least(a, b).alias("d")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("d").alias("s"), F.col("s").alias("d")))
        least = both.groupBy("s").agg(F.min("d").alias("m")).select("s", F.least("s", "m").alias("m"))
        # large star: the larger neighbours of a vertex move to its smallest one
        large = edges.select(F.col("d").alias("s"), F.col("s").alias("v")).join(least, "s").select(F.col("v").alias("s"), F.col("m").alias("d")).distinct()
        large = tables.save(large, "large")
        # small star: a vertex and its smaller neighbours move to the smallest of them
        lower = large.groupBy("s").agg(F.min("d").alias("m"))
        moved = large.join(lower, "s").where(F.col("d") != F.col("m")).select(F.col("d").alias("s"), F.col("m").alias("d"))
        new = tables.save(moved.unionByName(lower.select("s", F.col("m").alias("d"))).distinct(), "edges")
        tables.drop(edges, large)
        edges = new
        ends = edges.select("s", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("d").alias("s"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("s").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty():
            return edges.toDF("v", "comp").unionByName(edges.select(F.col("d").alias("v"), F.col("d").alias("comp")).distinct())
