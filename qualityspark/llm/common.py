"""What the operators share: words, cuts and scratch tables."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.session import cut_lineage, cut_of, remove, scratch_path  # noqa: F401

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null text as empty; whatever else the rows carry stays out of the plan."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """A copy of ``df`` in the shared folder that is deleted at the end; results of it must be written before."""
    spark = df.sparkSession
    path = scratch_path(spark, "written")
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes them when the driver collects its garbage, which a driver with
    memory to spare may not do for hours. The last query is still referred to by
    the event that told of its end, so a small one is run after it first.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
