"""Connected components by alternating stars: minimums over an end of the edges only, no graph in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parley.llm.store import kept


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), "a"))
    return both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Of edges with a > b; the rows of an ``a`` are in one place by then, so that repeated ones go without another exchange."""
    down = e.withColumn("m", F.min("b").over(Window.partitionBy("a"))).distinct()
    return down.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _stars(e: DataFrame) -> bool:
    """Whether all edges lead from an id to the smallest of its component."""
    ends = e.union(e.select("b", F.lit(None).cast("long"))).groupBy("a").agg(
        F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("aim"))
    return not ends.agg(F.count_if(F.col("low").isNotNull() & (F.col("aim") | (F.col("low") != F.col("high")) | (F.col("high") > F.col("a"))))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to rows (id, component): the smallest id reachable.

    Loops and nulls are left out; an id without edges has no row.  Each round shortens all paths
    and is written to the shared folder; the rounds end when every edge leads to the smallest id.
    """
    e = kept(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b"), "edges")
    while not _stars(e):
        e = kept(_small_star(_large_star(e)), "edges")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
