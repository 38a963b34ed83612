"""Lookups that enrich documents, runs and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.operators import lookups as O
from qualityspark.operators.suite import encode_file_outputs
from qualityspark.plans import query
from qualityspark.plans.views import results, runs, scores, with_views
from qualityspark.session import scratch_path
from qualityspark.sinks import writers as W
from qualityspark.sources.definitions import read_results_csv, read_score_csv

_PLACED = """placed AS (SELECT o_orderkey AS pid, CASE WHEN o_orderstatus = 'F' THEN concat('c', CAST(o_custkey AS STRING))
    WHEN o_orderstatus = 'O' THEN concat('g-', c_mktsegment) ELSE 'nobody' END AS rights_holder, 'g-' || c_mktsegment AS segment
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "group_lookup",
    f"WITH {_PLACED} SELECT pid, segment AS group_subject FROM placed WHERE rights_holder <> 'nobody'",
)
def group_lookup(t):
    """Persons give their groups, groups themselves, unknown subjects nothing."""
    docs = t("orders").join(t("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").selectExpr(
        "o_orderkey AS pid",
        """CASE WHEN o_orderstatus = 'F' THEN concat('c', CAST(o_custkey AS STRING))
            WHEN o_orderstatus = 'O' THEN concat('g-', c_mktsegment) ELSE 'nobody' END AS rights_holder""",
    )
    membership = t("customer").selectExpr("concat('c', CAST(c_custkey AS STRING)) AS subject", "concat('g-', c_mktsegment) AS group")
    return O.group_lookup(docs, membership).select("pid", F.col("group").alias("group_subject"))


@query(
    "award_lookup",
    """WITH awards AS (SELECT lpad(CAST(p_partkey AS STRING), 7, '0') AS id, p_name AS title, p_brand AS agency, p_type AS program FROM part WHERE p_size <= 40)
        SELECT l_orderkey AS pid, count(*) FILTER (WHERE o = 'title') AS n_awards, count(*) AS n_outputs, min(v) AS least FROM (
            SELECT l_orderkey, unnest(['line', 'title', 'agency', 'id', 'program', 'primary']) AS o,
                unnest([title || ' (' || agency || ' ' || id || ')', title, agency, id, program, agency || program]) AS v
            FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' AND l_partkey > 0 THEN lpad(CAST(l_partkey AS STRING), 7, '0') ELSE CAST(l_partkey AS STRING) END AS id FROM lineitem)
            JOIN awards USING (id)) GROUP BY l_orderkey
        UNION ALL SELECT doc_id + 1000000000, 0, 1, 'NA' FROM documents WHERE lang <> 'en'""",
)
def award_lookup(t):
    """Award numbers padded only when they are plain numbers; unknown awards give nothing, no list a failure."""
    name = F.when(F.col("l_returnflag") == "A", F.col("l_partkey").cast("string")).otherwise(
        F.concat(F.lit(" NSF Award "), F.col("l_partkey").cast("string"))
    )
    docs = t("lineitem").select(F.col("l_orderkey").alias("pid"), F.array(name).alias("awards"))
    without = t("documents").filter("lang <> 'en'").selectExpr("doc_id + 1000000000 AS pid", "CAST(NULL AS ARRAY<STRING>) AS awards")
    docs = docs.unionByName(without)
    awards = t("part").filter("p_size <= 40").selectExpr(
        "lpad(CAST(p_partkey AS STRING), 7, '0') AS id", "p_name AS title", "p_brand AS agency", "p_type AS fund_program_name",
        "concat(p_brand, p_type) AS primary_program",
    )
    found = O.award_lookup(docs, awards)
    return found.groupBy("pid").agg(
        (F.count_if(F.col("status") == "SUCCESS") / 6).cast("bigint").alias("n_awards"),
        F.count(F.lit(1)).alias("n_outputs"),
        F.min("output").alias("least"),
    )


@query(
    "media_lookup",
    """WITH types AS (SELECT DISTINCT p_type || '/' || p_brand AS name, lower(p_brand) AS extension FROM part WHERE p_size <= 25)
        SELECT p_partkey, extension, name AS media_type FROM part LEFT JOIN types ON lower(name) = lower(p_type || '/' || p_brand)""",
)
def media_lookup(t):
    """Media type to extension, in any case."""
    types = t("part").filter("p_size <= 25").selectExpr("p_type || '/' || p_brand AS name", "lower(p_brand) AS extension").distinct()
    files = t("part").selectExpr("p_partkey", "lower(p_type || '/' || p_brand) AS media_type")
    found = O.extension_of(files, types)
    named = types.selectExpr("name", "lower(name) AS media_type")
    return found.join(named, "media_type", "left").select("p_partkey", "extension", F.col("name").alias("media_type"))


@query(
    "media_types_by_extension",
    """WITH types AS (SELECT lower(p_brand) AS extension, min(p_type || '/' || p_brand) AS media_type FROM part WHERE p_size <= 25 GROUP BY lower(p_brand))
        SELECT p_partkey, p_brand AS extension, media_type FROM part LEFT JOIN types ON types.extension = lower(p_brand)""",
)
def media_types_by_extension(t):
    types = t("part").filter("p_size <= 25").selectExpr("p_type || '/' || p_brand AS name", "lower(p_brand) AS extension")
    return O.media_type_of(t("part").selectExpr("p_partkey", "p_brand AS extension"), types)


@query(
    "file_paths",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'data/' || l_orderkey || '-' || l_linenumber || '.csv'
        WHEN l_returnflag = 'N' THEN 'graph/' || l_orderkey || '-' || l_linenumber || '.png' ELSE 'code/report' END AS path FROM lineitem""",
)
def file_paths(t):
    """Relative paths: the extension is added unless the name has it, and left out when unknown."""
    files = t("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "CASE l_returnflag WHEN 'A' THEN 'data' WHEN 'N' THEN 'graph' ELSE 'code' END AS storage_type",
        "CASE l_returnflag WHEN 'A' THEN concat(l_orderkey, '-', l_linenumber, '.csv') WHEN 'N' THEN '' ELSE 'report' END AS alt_filename",
        "concat(l_orderkey, '-', l_linenumber) AS file_id",
        "CASE l_returnflag WHEN 'A' THEN 'Text/CSV' WHEN 'N' THEN 'image/png' ELSE 'application/none' END AS media_type",
    )
    types = t.spark.createDataFrame([("text/csv", "csv"), ("image/png", "png")], "name string, extension string")
    return O.with_path(files, types).select("l_orderkey", "l_linenumber", "l_partkey", "path")


_ENTRIES = """entries AS (SELECT 'f' || o_orderkey AS file_id, o_orderkey AS pid, 'suite-' || (o_orderkey % 3) AS suite_id,
    CASE WHEN o_orderstatus = 'F' THEN 'data' ELSE 'graph' END AS storage_type, 'text/csv' AS media_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'name-' || o_orderkey ELSE '' END AS alt_filename FROM orders)"""


@query(
    "file_lookup",
    f"""WITH {_ENTRIES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN n.file_id ELSE p.file_id END AS file_id FROM lineitem
        LEFT JOIN entries n ON n.storage_type = 'data' AND n.alt_filename = 'name-' || l_orderkey
        LEFT JOIN entries p ON p.pid = l_orderkey AND p.suite_id = 'suite-' || (l_linenumber % 3) AND p.storage_type = 'data' AND p.media_type = 'text/csv'""",
)
def file_lookup(t):
    files = t("orders").selectExpr(
        "concat('f', o_orderkey) AS file_id", "o_orderkey AS pid", "concat('suite-', o_orderkey % 3) AS suite_id",
        "CASE WHEN o_orderstatus = 'F' THEN 'data' ELSE 'graph' END AS storage_type", "'text/csv' AS media_type",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('name-', o_orderkey) ELSE '' END AS alt_filename",
    )
    requests = t("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_orderkey AS pid", "concat('suite-', l_linenumber % 3) AS suite_id",
        "'data' AS storage_type", "'text/csv' AS media_type",
        "CASE WHEN l_returnflag = 'A' THEN concat('name-', l_orderkey) ELSE '' END AS alt_filename",
    )
    return O.file_lookup(requests, files).select("l_orderkey", "l_linenumber", "l_partkey", "file_id")


@query(
    "fetch_fallback",
    """SELECT coalesce(d.doc_id, p.page_id) AS pid, md5(coalesce(text, html)) AS digest,
        CASE WHEN text IS NOT NULL THEN 'primary' WHEN html IS NOT NULL THEN 'fallback' END AS source
        FROM (SELECT * FROM documents WHERE lang <> 'en') d FULL JOIN pages p ON doc_id = page_id""",
)
def fetch_fallback(t):
    primary = t("documents").filter("lang <> 'en'").selectExpr("doc_id AS pid", "text AS body")
    fallback = t("pages").selectExpr("page_id AS pid", "html AS body")
    return O.fetch_with_fallback(primary, fallback).select("pid", F.md5("body").alias("digest"), "source")


@query(
    "data_objects",
    """SELECT o_orderkey AS pid, l_partkey AS data_pid, count(*) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey <> o_orderkey
        GROUP BY o_orderkey, l_partkey""",
)
def data_objects(t):
    docs = t("orders").selectExpr("o_orderkey AS pid")
    objects = t("lineitem").selectExpr("l_orderkey AS pid", "l_partkey AS data_pid")
    return O.data_objects(docs, objects).groupBy("pid", "data_pid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "data_counts",
    "SELECT o_orderkey AS pid, count(l_partkey) AS n_data FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey <> o_orderkey GROUP BY o_orderkey",
)
def data_counts(t):
    docs = t("orders").selectExpr("o_orderkey AS pid")
    return O.data_counts(docs, t("lineitem").selectExpr("l_orderkey AS pid", "l_partkey AS data_pid"))


@query(
    "sysmeta_join",
    """SELECT doc_id AS pid, md5(text) AS body, quality, CASE WHEN l.doc_id IS NULL THEN 'system metadata not found' END AS sysmeta_error
        FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def sysmeta_join(t):
    """Whole bodies meet their metadata; a document without stays, with the reason."""
    meta = t("labels").selectExpr("doc_id AS identifier", "quality")
    joined = O.with_sysmeta(t("documents").selectExpr("doc_id AS pid", "text AS body"), meta)
    return joined.select("pid", F.md5("body").alias("body"), F.col("sysmeta.quality").alias("quality"), "sysmeta_error")


@query(
    "award_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' AND l_partkey > 0 THEN lpad(CAST(l_partkey AS STRING), 7, '0')
        WHEN l_returnflag = 'A' THEN '0' ELSE CAST(l_partkey AS STRING) END AS key FROM lineitem""",
)
def award_keys(t):
    text = F.when(F.col("l_returnflag") == "A", F.col("l_partkey").cast("string")).otherwise(
        F.concat(F.lit("NSF Award "), F.col("l_partkey").cast("string"), F.lit(" "))
    )
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.award_key(text).alias("key"))


# Files ------------------------------------------------------------------------


@query(
    "score_csv_rows",
    with_views("scored")
    + """SELECT metadata_id AS pid, metadata_format_id AS "formatId", strftime(date_uploaded, '%Y-%m-%dT%H:%M:%S.%gZ') AS "dateUploaded", datasource,
        score_overall AS "scoreOverall", CAST(score_findable AS DOUBLE) AS "scoreFindable", CAST(sequence_id AS STRING) AS "sequenceId" FROM scores_v""",
)
def score_csv_rows(t):
    rows = W.score_csv_rows(_linked_scores(t))
    return rows.select(
        "pid", "formatId", "dateUploaded", "datasource", "scoreOverall",
        F.col("scoreFindable").cast("double").alias("scoreFindable"), F.col("sequenceId").cast("string").alias("sequenceId"),
    )


def _linked_scores(t):
    none = F.lit(None).cast("string")
    return scores(t).withColumns({"obsoletes": none, "obsoleted_by": none})


@query(
    "score_csv_round_trip",
    with_views("scored")
    + """SELECT CAST(metadata_id AS STRING) AS pid, date_uploaded, datasource, round(CAST(score_reusable AS DOUBLE), 2) AS reusable,
        CAST(sequence_id AS STRING) AS sequence_id FROM scores_v""",
)
def score_csv_round_trip(t):
    """The score file written and read back."""
    path = scratch_path(t.spark, "scores-csv")
    W.write_score_csv(_linked_scores(t), path)
    back = read_score_csv(t.spark, path)
    return back.select(
        "pid", F.col("dateUploaded").alias("date_uploaded"), "datasource", F.round("scoreReusable", 2).alias("reusable"),
        F.col("sequenceId").alias("sequence_id"),
    )


@query(
    "results_csv_round_trip",
    with_views("results_v")
    + """SELECT CAST(pid AS STRING) AS pid, CAST(check_no AS STRING) AS check_id, type, level, status, count(*) AS n,
        CAST(list_position(['SUCCESS', 'FAILURE', 'SKIP', 'ERROR'], status) AS BIGINT) AS status_rank
        FROM results_v GROUP BY pid, check_no, type, level, status""",
)
def results_csv_round_trip(t):
    """Results written as CSV and read back with the rank of their status."""
    path = scratch_path(t.spark, "results-csv")
    source = F.lit(None).cast("string")
    rows = results(t).select("pid", source.alias("datasource"), F.col("check_no").alias("check_id"), "type", "level", "status")
    rows.write.option("header", "true").option("escape", '"').csv(path)
    back = read_results_csv(t.spark, path)
    return back.groupBy("pid", "check_id", "type", "level", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("status_rank").alias("status_rank")
    )


@query(
    "encoded_outputs",
    """SELECT doc_id AS pid, CASE WHEN quality = 1 THEN to_base64(encode(text)) WHEN toxic = 1 THEN 'NA' ELSE 'files/' || doc_id || '.txt' END AS value
        FROM documents JOIN labels USING (doc_id)""",
)
def encoded_outputs(t):
    """Outputs that name a file become the base64 text of its bytes."""
    value = "CASE WHEN toxic = 1 AND quality <> 1 THEN 'NA' ELSE concat('files/', doc_id, '.txt') END AS value"
    outputs = t("labels").selectExpr("doc_id AS pid", value)
    good = t("labels").filter("quality = 1").select("doc_id")
    files = t("documents").join(good, "doc_id").selectExpr("concat('files/', doc_id, '.txt') AS path", "CAST(text AS BINARY) AS content")
    encoded = encode_file_outputs(outputs, files)
    return encoded.select("pid", F.regexp_replace("value", "[\r\n]", "").alias("value"))


@query("run_source_join", with_views("runs_v") + "SELECT metadata_id, suite_id, c_mktsegment AS data_source FROM runs_v JOIN customer ON custkey = c_custkey")
def run_source_join(t):
    """Runs with the data source of their document."""
    names = t("customer").selectExpr("c_custkey AS custkey", "c_mktsegment AS data_source")
    return runs(t).join(names, "custkey").select("metadata_id", "suite_id", "data_source")
