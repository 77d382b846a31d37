"""Connected components of a graph held as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import staged


def _print(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free hash of the links, to see whether a round changed them."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(u, v)``: every linked node but the smallest of its component, and that smallest node.

    ``links`` has two columns of one type. Rounds grow with the logarithm of the
    longest path; each is written to the shared folder. Node minima are partial
    sums before any shuffle, and a hub's links split like any skewed join.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = staged(edges, "links")
    before = _print(edges)
    while before[0]:
        edges = staged(_small(_large(edges)), "links")
        now = _print(edges)
        if now == before:
            break
        before = now
    return edges
