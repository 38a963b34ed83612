"""A training-data pipeline: documents in, packed sequences out.

Quality, exact copies, near copies and secrets are dealt with in turn; what is
left is packed. Every stage but the last takes and returns the columns of
``documents``, works on all that its predecessor kept, and joins ids with texts
by merge at every size, as the ids grow with the texts.

Documents without an id, or with one that another has too, are documents of
their own: every row has a number within a stage. Of copies, one without an id
stays only if it is the longest, or if none has an id; of copies with the same
id one stays, so a file that was loaded twice is deduplicated.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.llm import exact_dedup, ngram_join, packing, quality, secrets
from qualityspark.llm.common import cut_lineage, cut_of, release
from qualityspark.session import configure


#: Name of the stages' own number of a row, which is unique and never null.
_ROW = "pipeline_row"


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_ROW``, written, so that a row's number is the same wherever it is read."""
    return cut_lineage(docs.withColumn(_ROW, F.monotonically_increasing_id()))


def _kept(docs: DataFrame, rows: DataFrame, numbers: DataFrame) -> DataFrame:
    return rows.join(numbers.select(F.col("row").alias(_ROW)).hint("merge"), _ROW, "left_semi").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, net, keep=tuple(docs.columns)).filter("predicted = 1").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then the one with the smallest id; no id comes last."""
    rows, index = _rows(docs), exact_dedup.DigestIndex.scratch(spark)
    kept = cut_of(spark, lambda: exact_dedup.deduplicate(rows, index, row_col=_ROW).filter("kept").select("row"))
    index.drop()
    return _kept(docs, rows, kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links by its shingles, the document with the smallest id stays; no id comes last."""
    rows = _rows(docs)
    release(spark)
    plain = rows.select(F.col(_ROW).alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut_of(spark, lambda: ngram_join.near_components(plain).select("row", "id", "component"))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))
    firsts = found.filter("component IS NOT NULL").groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return _kept(docs, rows, firsts.unionByName(found.filter("component IS NULL").select("row")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, and its count of characters follows its text."""
    # The parts stand for the text from here on, so it is split once for training and masking.
    parts = secrets.dissect(F.col("text"), F.col("source"))
    cut = cut_lineage(docs.select(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("textless"), parts.alias("parts")))
    forest = secrets.grow(secrets.labelled(cut, "parts.found"))
    text = F.when(~F.col("textless"), secrets.masked(F.col("parts"), forest))
    whole = cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return whole.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: The classifier and the packing have no SQL; tests hold the rows against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each one keeps is written before the next reads it, and its scratch goes."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_of(spark, partial(stage, spark, docs, sf_dir))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
