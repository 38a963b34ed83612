"""Helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityspark.session import cut_lineage


def number_in_order(df: DataFrame, keys: list[str], ts: str, tie: str, out: str = "row_number") -> DataFrame:
    """``row_number`` per key in (ts, tie) order, however many rows a key or an instant has.

    Rows are laid out in range partitions by key, time, tie and a number of
    their own, so even rows of one key and one second can be divided; a row's
    number is its place in its partition and what its key has in the partitions
    before. That is one number per key and partition, the only thing a window
    sees. Null keys are keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written before the splitters are sampled, so that equal rows keep the numbers that tell them apart.
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    order = [*keys, ts, tie, "_row"]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # Key and partition are one struct, which is never null and so joins null keys too.
    part = F.struct(*keys, F.shiftright("_place", 33).alias("_part"))
    laid = cut_lineage(laid.drop("_row")).withColumn("_of", part)
    held = laid.groupBy("_of").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(F.col("_of").getField(k) for k in keys)).orderBy("_of._part").rowsBetween(Window.unboundedPreceding, -1)
    held = cut_lineage(held.select("_of", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    numbered = laid.join(held, "_of").withColumn(out, F.col("_before") + F.col("_place") - F.col("_first") + 1)
    return numbered.drop("_of", "_place", "_first", "_before")


def join_latest(df: DataFrame, latest: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to one-row-per-key values, nulls matching nulls.

    ``df`` is the streamed side and the other side is unique per key, which is
    the shape adaptive skew-join splitting can divide.
    """
    right = latest.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in latest.columns if c not in keys])
    condition: Column | None = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = test if condition is None else condition & test
    joined = df.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])
