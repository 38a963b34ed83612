"""Line dedup over overlapping windows of three lines.

Consecutive lines are hashed in threes; of each window that occurs more than
once, wherever, the first occurrence stays and the lines covered by any later
one go. Windows overlap, so covered positions are merged before lines are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.functions.scalars import let
from qualityspark.llm.common import cut_lineage, texts

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_hashes(text: Column, size: int = WINDOW) -> Column:
    """128 bits for each window of lines, in order; none for a text of fewer lines."""

    def hashes(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - size)
        # unhex(md5) is half the hex text; the line end keeps windows of other line splits apart.
        key = F.transform(at, lambda i: F.unhex(F.md5(F.concat_ws("\n", *(F.get(lines, i + k) for k in range(size))))))
        return F.when(F.size(lines) >= size, key).otherwise(F.array().cast("array<binary>"))

    # Split once, however many windows there are.
    return let(_lines(text), hashes)


def covered_lines(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``row, spans``: the runs of lines that later occurrences cover, as ``low, high``, in order, for rows with any.

    ``rows``: a written table ``row, doc_id, text`` whose ``row`` is unique.
    """
    # Read for the groups and for the later occurrences, so hashed once and written: some 30 bytes a line.
    windows = cut_lineage(rows.select("row", "doc_id", F.posexplode(window_hashes(F.col("text"), size)).alias("pos", "window")))
    first = F.min(F.struct("doc_id", "row", "pos"))
    groups = windows.groupBy("window").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Cut: one row for each window that repeats, beside which the scan's rows can be split where one window is hot.
    groups = cut_lineage(groups.select("window", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos")))
    later = windows.join(groups.hint("merge"), "window").filter((F.col("row") != F.col("first_row")) | (F.col("pos") != F.col("first_pos")))
    starts = later.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("starts"))
    last = F.size("starts") - 1
    low = F.filter("starts", lambda p, i: (i == 0) | (p - F.get("starts", i - 1) > size))
    high = F.transform(F.filter("starts", lambda p, i: (i == last) | (F.get("starts", i + 1) - p > size)), lambda p: p + size)
    return starts.select("row", F.arrays_zip(low.alias("low"), high.alias("high")).alias("spans"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Remove repeated passages of ``size`` or more lines.

    Returns ``doc_id, text, n_lines, n_removed``, one row per row of ``docs``.
    Occurrences are ordered by document id, a null id first, then by row where
    ids are equal, then by position; a window that repeats within its document
    counts too, and every distinct line stays somewhere. Rows that repeat an id
    are documents of their own. Null text counts as empty: one empty line. Texts
    of fewer than ``size`` lines stay as they are. No rows give no rows.
    """
    rows = cut_lineage(texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    spans = cut_lineage(covered_lines(rows, size))
    # The marks grow with the texts, so they are never sent to every task, whatever their size.
    marked = rows.join(spans.hint("merge"), "row", "left")

    def cut(lines: Column) -> Column:
        none = F.array().cast("array<int>")
        low, high = (F.coalesce(F.col(f"spans.{c}"), none) for c in ("low", "high"))
        kept = F.arrays_zip(F.concat(F.array(F.lit(0)), high).alias("low"), F.concat(low, F.array(F.size(lines))).alias("high"))
        parts = F.flatten(F.transform(kept, lambda k: F.slice(lines, k["low"] + 1, k["high"] - k["low"])))
        text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(parts, "\n"))
        return F.struct(text.alias("text"), F.size(lines).cast("long").alias("n_lines"))

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    done = marked.select("doc_id", let(_lines(F.col("text")), cut).alias("cut"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"))
    return done.select("doc_id", "cut.text", "cut.n_lines", "n_removed")


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, unnest(range(len(l) - 2)) AS pos, l FROM lines WHERE len(l) >= 3),
keyed AS (
  SELECT doc_id, pos, array_to_string(l[pos + 1:pos + 3], chr(10)) AS w FROM windows),
later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM keyed),
covered AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM later, (SELECT unnest(range(3)) AS o) WHERE k > 1),
each_line AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM lines)
SELECT e.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
  sha256(coalesce(string_agg(e.x, chr(10) ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), '')) AS text_sha256
FROM each_line e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.pos = e.pos
GROUP BY e.doc_id
"""
