"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.llm.common import cut_lineage


def _to_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: ``m`` the least of ``u`` and all its ``v``.

    Adaptive execution divides the rows of a common ``u`` only if both sides of
    the join come straight from a shuffle, so the aggregate is cut first, and
    ``edges`` must not be one.
    """
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return edges.join(least.hint("merge"), "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all ends of ``edges`` (``a, b``), the component being its smallest node.

    Loops, repeated and reversed edges do no harm; no edges give no rows. The
    number of rounds grows with the logarithm of a component's size.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut_lineage(now)
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = cut_lineage(large.filter("u <> v").distinct())
        small = _to_least(down)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut_lineage(linked.filter("u <> v").distinct())
        state = _state(now)
        if state == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = state
