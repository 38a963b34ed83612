"""Stored tables: runs, scores, nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score_scan(
    scores: DataFrame,
    suite_id: str | None = None,
    datasource: str | None = None,
    format_id: str | None = None,
    pids: DataFrame | None = None,
) -> DataFrame:
    """Score rows by predicate. Conditions on columns reach the Parquet scan, and
    ``suite_id`` prunes folders when the table is partitioned by it."""
    for column, value in (("suite_id", suite_id), ("datasource", datasource), ("metadata_format_id", format_id)):
        if value is not None:
            scores = scores.filter(F.col(column) == value)
    if pids is not None:
        scores = scores.join(pids.select(F.col("pid").alias("metadata_id")), "metadata_id", "left_semi")
    return scores


def objects_between(sysmeta: DataFrame, lo, hi) -> DataFrame:
    return sysmeta.filter((F.col("modified") >= lo) & (F.col("modified") <= hi))


def node(nodes: DataFrame, identifier: str) -> DataFrame:
    return nodes.filter(F.col("identifier") == identifier)
