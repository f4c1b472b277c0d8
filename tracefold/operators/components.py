"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.runtime import materialize, release, salted_join


def stars(edges: DataFrame) -> DataFrame:
    """x, root for the vertices of ``edges`` (u, v; longs): the smallest vertex each one hangs together with.

    Large-star joins the larger neighbours of a vertex to its smallest one, small-star the smaller ones; after
    O(log n) rounds only stars are left. Neighbours are met by minima with partial aggregation and by salted
    joins, never collected, so a vertex with a third of all edges is no burden. Tables are written each round.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e)
    while True:
        both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n"))
        large = materialize(salted_join(both, low.drop("_n"), ["u"], counts=low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        release(both, low, e)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")))
        small = salted_join(large, low.drop("_n"), ["u"], counts=low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = materialize(small)
        release(low, large)
        e = new
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below > 0 and above > 0").isEmpty():
            return e.select(F.col("u").alias("x"), F.col("v").alias("root"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """x, root of every row of ``vertices`` (x); those without an edge are their own root."""
    return vertices.select("x").distinct().join(stars(edges), "x", "left").select("x", F.coalesce("root", "x").alias("root"))
