"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per digest. New
rows are reduced to one row per digest, anti-joined with the index bucket by
bucket (sort-merge, the index side is not shuffled), and what is left is
appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.llm.common import SPACES, cut_lineage, remove, scratch_path, texts

SCHEMA = "text_sha256 string, keep_id long, n_points long"


def digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text without its white space, in UTF-8."""
    return F.sha2(F.regexp_replace(text, SPACES + "+", ""), 256)


class DigestIndex:
    """A bucketed table ``text_sha256, keep_id, n_points``, sorted by digest in each bucket.

    ``buckets`` fixes the layout for the table's life. ``path`` lies in a folder
    that all executors share; the same path and name open the index again.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], SCHEMA), "errorifexists")

    @classmethod
    def scratch(cls, spark: SparkSession) -> DigestIndex:
        """An empty index of its own in the shared scratch folder."""
        return cls(
            spark,
            f"digest_index_{uuid.uuid4().hex}",
            scratch_path(spark, "digest-index"),
            int(spark.conf.get("spark.sql.shuffle.partitions")),
        )

    def _write(self, rows: DataFrame, mode: str) -> None:
        # One task per bucket, so each append adds one sorted file to a bucket.
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.mode(mode)
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(self.name)
        )

    def bucketed(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The same rows as a plain scan, for joins whose other side has hot digests to split."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def append_new(self, groups: DataFrame) -> DataFrame:
        """Add the digests of ``groups`` (one row per digest) that the index lacks; returns those groups."""
        fresh = groups.join(self.bucketed().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        # The anti join reads the table that the append extends, so its rows are cut first.
        fresh = cut_lineage(fresh)
        self._write(fresh.select("text_sha256", "keep_id", "n_points"), "append")
        return fresh

    def drop(self) -> None:
        """Delete the index; read or write results of it before that."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def deduplicate(new: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Dedup ``new`` against ``index``, extend the index, and tell each row's fate.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row
    of ``new``. Of equal texts the one with the most code points stays, then one
    with an id rather than without, then the smallest id, then the first row, so
    of rows that repeat an id one stays, and ``keep_id`` is null if the row that
    stays has no id. A digest that the index already has keeps its row there,
    and all new rows of it are dropped. Null text counts as empty; all empty
    texts are one group. ``row_col`` names a column of unique numbers that comes
    along as ``row`` and takes the place of the rows' order. No rows give no rows.
    """
    row = F.monotonically_increasing_id() if row_col is None else F.col("own_row")
    plain = texts(new, id_col, text_col) if row_col is None else new.select(
        new[id_col].alias("doc_id"), F.coalesce(new[text_col], F.lit("")).alias("text"), new[row_col].alias("own_row")
    )
    rows = cut_lineage(
        plain.select(row.alias("row"), "doc_id", digest(F.col("text")).alias("text_sha256"), F.length("text").cast("long").alias("n_points"))
    )
    # The complement falls as a number grows; null is the least of all.
    best = F.max(F.struct(F.col("n_points"), F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row")))
    groups = rows.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    keep = [F.bitwise_not("best.not_id").alias("keep_id"), F.bitwise_not("best.not_row").alias("keep_row"), F.col("best.n_points").alias("n_points")]
    groups = cut_lineage(groups.select("text_sha256", *keep, "group_size"))
    fresh = index.append_new(groups)
    kept = index.rows().select("text_sha256", "keep_id").join(groups.select("text_sha256", "group_size"), "text_sha256")
    kept = kept.join(fresh.select("text_sha256", "keep_row"), "text_sha256", "left")
    # A row per digest against all rows: both sides are shuffled, so a hot digest's rows can be split.
    out = rows.join(cut_lineage(kept), "text_sha256")
    stays = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", stays, "text_sha256", *([] if row_col is None else ["row"]))


OP7_SQL = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
               length(coalesce(text, '')) AS points FROM documents))
"""
