"""Scalar functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.plans import query
from qualityspark.sinks.writers import report_file

_WS = r"[ \t\n\r\f\x0B]"
_STRIP = f"regexp_replace(regexp_replace(text, '^{_WS}+', ''), '{_WS}+$', '')"


@query(
    "text_measures",
    f"""SELECT doc_id, CAST(len(string_split_regex({_STRIP}, '{_WS}+')) AS BIGINT) AS words, {_STRIP} = '' AS blank,
        length(text) > 500 AS longer, md5(regexp_replace({_STRIP}, '{_WS}+', ' ', 'g')) AS spaced,
        len(string_split(text, chr(10))) > len(list_distinct(string_split(text, chr(10)))) AS repeated FROM documents""",
)
def text_measures(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id",
        S.word_count(text).cast("bigint").alias("words"),
        S.is_blank(text).alias("blank"),
        S.longer_than(text, 500).alias("longer"),
        F.md5(S.normalize_space(text)).alias("spaced"),
        S.has_duplicates(F.split(text, "\n")).alias("repeated"),
    )


@query("report_files", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha1(text) AS sha1 FROM documents")
def report_files(t):
    return t("documents").select("doc_id", report_file(F.col("text")).alias("f")).select(
        "doc_id", F.col("f.size").cast("bigint").alias("size"), "f.sha1"
    )


@query("url_keys", "SELECT page_id, md5(url) AS key, url_encode(url) AS encoded FROM pages")
def url_keys(t):
    return t("pages").select("page_id", S.url_key(F.col("url")).alias("key"), S.url_encode(F.col("url")).alias("encoded"))


@query(
    "html_unescape",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS digest
       FROM pages""",
)
def html_unescape(t):
    return t("pages").select("page_id", F.md5(S.xml_unescape(F.col("html"))).alias("digest"))


@query(
    "identifier_pattern",
    r"""SELECT doc_id, id, regexp_full_match(id, '[^.]+\.[0-9]+\.[0-9]+') AS ok FROM (SELECT doc_id,
        CASE WHEN lang = 'en' THEN concat(source, '.', doc_id, '.', n_chars) ELSE concat(lang, '.', source, '.', doc_id) END AS id FROM documents)""",
)
def identifier_pattern(t):
    ids = t("documents").selectExpr(
        "doc_id",
        "CASE WHEN lang = 'en' THEN concat(source, '.', doc_id, '.', n_chars) ELSE concat(lang, '.', source, '.', doc_id) END AS id",
    )
    return ids.withColumn("ok", S.is_scoped_identifier(F.col("id")))


@query(
    "event_dates",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CAST(date_trunc('month', ts) AS DATE) AS first_day,
        last_day(ts) AS final_day, date_trunc('millisecond', CAST(ts AS TIMESTAMP)) AS again FROM events""",
)
def event_dates(t):
    ts = F.col("ts").cast("timestamp")
    return t("events").select(
        "event_id",
        S.iso_millis(ts).alias("iso"),
        S.month_start(ts).alias("first_day"),
        S.month_end(ts).alias("final_day"),
        S.parse_iso(S.iso_millis(ts)).alias("again"),
    )


@query(
    "run_keys",
    """SELECT o_orderkey, sha256(concat_ws(',', CAST(o_orderkey AS STRING), concat('suite-', CAST(o_orderkey % 3 AS STRING)),
        CAST(CAST(o_orderdate AS TIMESTAMP) AS STRING))) AS run_id FROM orders""",
)
def run_keys(t):
    suite = F.concat(F.lit("suite-"), (F.col("o_orderkey") % 3).cast("string"))
    return t("orders").select(
        "o_orderkey", S.run_key(F.col("o_orderkey"), suite, F.col("o_orderdate").cast("timestamp")).alias("run_id")
    )
