"""Files written from the tables to the shared folder and read back by the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qualityspark.operators.checks import Check, Registry
from qualityspark.operators.suite import explode_results, run_check
from qualityspark.plans import query
from qualityspark.session import scratch_path
from qualityspark.sources import definitions as D
from qualityspark.sources import documents as S

_TOP = "CASE WHEN s_nationkey % 3 = 0 THEN 'data' WHEN s_nationkey % 3 = 1 THEN 'graph' ELSE 'tmp' END"


def _write(rows: DataFrame, path: str) -> None:
    """One file per row of ``top, pid, value``, below a folder named after each."""
    # So many files are written by all cores, and each is put in its place by the task that wrote it, not one by one in the driver.
    tasks = max(4, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    rows.repartition(tasks).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("top", "pid").text(path)


def _suppliers(t) -> str:
    body = F.to_xml(F.struct(F.col("s_name").alias("title"), F.col("s_acctbal").cast("string").alias("balance")), {"rowTag": "doc"})
    path = scratch_path(t.spark, "files")
    _write(t("supplier").select(F.expr(_TOP).alias("top"), F.col("s_suppkey").alias("pid"), body.alias("value")), path)
    return path


def _pid(path: str = "path"):
    return F.regexp_extract(path, "pid=(\\d+)", 1).cast("bigint").alias("pid")


@query(
    "document_files",
    """SELECT s_suppkey AS pid, CASE WHEN length(s_name) > 17 THEN 'SUCCESS' ELSE 'FAILURE' END AS status FROM supplier""",
)
def document_files(t):
    """A file for each document, scanned whole and assessed."""
    from qualityspark.functions.extract import Selector
    from qualityspark.operators import checks as C

    docs = S.text_documents(t.spark, _suppliers(t), "*.txt").select(_pid(), F.lit("eml").alias("format_id"), "body")
    check = Check("title", C.longer_than("title", 17), selectors=(Selector("title", "/doc/title"),))
    return explode_results(run_check(docs, Registry([check]).get("title"))).select("pid", "status")


@query(
    "record_files",
    """SELECT l_orderkey AS pid, l_linenumber AS no, l_returnflag AS format, CAST(l_quantity AS DOUBLE) AS size, FALSE AS is_corrupt FROM lineitem
        WHERE l_partkey % 50 <> 7 AND l_partkey % 50 <> 9
        UNION ALL SELECT NULL, NULL, NULL, NULL, TRUE FROM lineitem WHERE l_partkey % 50 = 7 OR l_partkey % 50 = 9""",
)
def record_files(t):
    """Files of thousands of records, in one splittable scan; records that are no XML and wrong values keep their text."""
    wrong = F.when(F.col("l_partkey") % 50 == 9, "none").otherwise("")
    text = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    record = F.concat(
        F.lit('<record no="'), F.col("l_linenumber").cast("string"), F.lit('">'), text("pid", F.col("l_orderkey").cast("string")), text("format", F.col("l_returnflag")),
        text("size", F.concat(wrong, F.col("l_quantity").cast("double").cast("string"))), F.lit("</record>"),
    )
    path = scratch_path(t.spark, "records")
    record = F.when(F.col("l_partkey") % 50 == 7, F.concat(F.lit("<record <"), record)).otherwise(record)
    t("lineitem").select(record.alias("value")).coalesce(2).write.text(path)
    rows = S.record_documents(t.spark, path, "record", StructType.fromDDL("_no int, pid long, format string, size double"))
    return rows.select("pid", F.col("_no").alias("no"), "format", "size", F.col("corrupt").isNotNull().alias("is_corrupt"))


@query("staged_files", f"SELECT s_suppkey AS pid FROM supplier WHERE {_TOP} IN ('data', 'graph') AND s_suppkey % 10 <> 7")
def staged_files(t):
    """Included folders, without the files a task's filter list leaves out."""
    found = S.staged_files(t.spark, _suppliers(t), ["top=data", "top=graph"], "*.txt", exclude=["pid=\\d*7/"])
    return found.select(_pid())


@query(
    "media_type_files",
    "SELECT p_type || '/' || p_brand AS name, min(lower(p_brand)) AS extension, count(*) AS n FROM part GROUP BY ALL",
)
def media_type_files(t):
    """The media type table, from CSV."""
    path = scratch_path(t.spark, "media-types")
    t("part").selectExpr("p_type || '/' || p_brand AS name", "lower(p_brand) AS extension").write.option("header", "true").csv(path)
    read = D.read_media_types(t.spark, path)
    return read.groupBy("name").agg(F.min("extension").alias("extension"), F.count(F.lit(1)).alias("n"))


_FORMATS = "'f-' || p_brand || '-' || p_size AS format_id, p_type || ', ' || p_brand AS format_name, CASE WHEN p_size > 25 THEN ' y ' ELSE 'N' END AS proprietary"


@query(
    "format_files",
    f"""WITH formats AS (SELECT DISTINCT format_id, proprietary = ' y ' AS proprietary FROM (SELECT {_FORMATS} FROM part))
        SELECT doc_id AS pid, format_id, proprietary FROM (SELECT doc_id, 'f-Brand#' || (doc_id % 50) || '-' || (doc_id % 53) AS format_id FROM documents)
        LEFT JOIN formats USING (format_id)""",
)
def format_files(t):
    """The format table from CSV, with names that hold commas, joined to documents by format."""
    path = scratch_path(t.spark, "formats")
    rows = t("part").selectExpr(*_FORMATS.replace(", CASE", "; CASE").replace("format_id, p_type", "format_id; p_type").split("; "))
    columns = rows.select("format_name", "format_id", F.lit("text/csv").alias("media_type"), F.lit("csv").alias("extension"), "proprietary")
    columns.write.option("header", "true").option("escape", '"').option("ignoreTrailingWhiteSpace", "false").option("ignoreLeadingWhiteSpace", "false").csv(path)
    formats = D.read_formats(t.spark, path).select("format_id", "proprietary").distinct()
    docs = t("documents").selectExpr("doc_id AS pid", "concat('f-Brand#', doc_id % 50, '-', doc_id % 53) AS format_id")
    return docs.join(formats, "format_id", "left").select("pid", "format_id", "proprietary")


@query(
    "definition_paths",
    """SELECT 'check.' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'check.' || s_suppkey, 'newer ' || s_name FROM supplier WHERE s_suppkey % 2 = 1""",
)
def definition_paths(t):
    """Check definitions of several folders; of one id the file that comes last counts."""
    folders = [scratch_path(t.spark, "checks-a"), scratch_path(t.spark, "checks-b")]
    first, second = sorted(folders)
    check = lambda name: F.to_xml(F.struct(F.concat(F.lit("check."), F.col("s_suppkey")).alias("id"), name.alias("name")), {"rowTag": "check"})
    old = t("supplier").select(F.lit("x").alias("top"), F.col("s_suppkey").alias("pid"), check(F.col("s_name")).alias("value"))
    new = t("supplier").filter("s_suppkey % 2 = 1").select(
        F.lit("x").alias("top"), F.col("s_suppkey").alias("pid"), check(F.concat(F.lit("newer "), F.col("s_name"))).alias("value")
    )
    _write(old, first)
    _write(new, second)
    return D.read_checks(t.spark, [second, first], glob="*.txt").select("id", "name")
