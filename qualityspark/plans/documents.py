"""Documents built from the text table, and suites run over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark import schemas
from qualityspark.functions import extract as X
from qualityspark.functions import scalars as S
from qualityspark.operators import checks as C
from qualityspark.operators import rollup as U
from qualityspark.operators import scores as O
from qualityspark.operators import sequences as Q
from qualityspark.operators.rosters import FAIR_SUITE
from qualityspark.operators.suite import explode_results, run_check, run_suite
from qualityspark.plans import query
from qualityspark.plans.series import series_sql
from qualityspark.session import cut_lineage, scratch_path
from qualityspark.sinks import writers as W
from qualityspark.sources import definitions as D
from qualityspark.sources.documents import readers, routed, system_metadata

_IS_JSON = "source IN ('src3', 'src7')"
_IS_OTHER = "lang = 'de'"
_IS_BROKEN = "source = 'src5' AND lang = 'en'"

DOCS = f"""docs_v AS (SELECT doc_id AS pid, substring(text, 1, 60) AS title, text AS abstract,
    string_split(text, chr(10)) AS keywords, source, lang, n_chars,
    {_IS_JSON} AS is_json, {_IS_OTHER} AS is_other, {_IS_BROKEN} AS is_broken FROM documents)"""


def documents(t) -> DataFrame:
    """XML and JSON documents: ``pid, format_id, body`` and their system metadata.

    Documents of one source are JSON, of one language in an unsupported
    dialect, and some are cut short and so not well formed.
    """
    title = F.substring("text", 1, 60).alias("title")
    keywords = F.split("text", "\n")
    dataset = F.struct(F.struct(title, F.col("text").alias("abstract"), keywords.alias("keyword")).alias("dataset"))
    eml = F.to_xml(dataset, {"rowTag": "eml"})
    other = F.to_xml(dataset, {"rowTag": "report"})
    as_json = F.to_json(
        F.struct(
            F.array(F.lit("https://schema.org/")).alias("@context"),
            title.alias("name"),
            F.col("text").alias("description"),
            keywords.alias("keywords"),
        )
    )
    is_json, is_other, is_broken = F.expr(_IS_JSON), F.expr(_IS_OTHER), F.expr(_IS_BROKEN)
    texts = t("documents")
    return texts.select(
        F.col("doc_id").alias("pid"),
        F.when(is_json, "application/ld+json").otherwise("eml-2.2").alias("format_id"),
        F.when(is_json, as_json)
        .when(is_broken, F.substr(eml, F.lit(1), F.length(eml) - 4))
        .when(is_other, other)
        .otherwise(eml)
        .alias("body"),
        F.struct(
            F.col("doc_id").cast("string").alias("identifier"),
            F.col("lang").alias("format_id"),
            F.col("source").alias("rights_holder"),
            F.col("source").alias("origin_member_node"),
            F.col("source").alias("authoritative_member_node"),
            F.lit(None).cast("timestamp").alias("date_uploaded"),
            F.lit(None).cast("string").alias("obsoletes"),
            F.lit(None).cast("string").alias("obsoleted_by"),
        ).alias("sysmeta"),
    )


_LINES = "string_split(text, chr(10))"
TITLE = X.Selector("title", "/*/dataset/title", ".name")
ABSTRACT = X.Selector("abstract", "/eml/dataset/abstract", ".description")
KEYWORDS = X.Selector("keywords", "//dataset/keyword", ".keywords[]")
TYPED_ABSTRACT = X.Selector("abstract", "/resource/descriptions/description[@descriptionType='Abstract']")
ATTRIBUTE_NAMES = X.Selector("attributeNames", "//attribute/attributeName", ".attributes[]")
ENTITIES = X.Selector("entities", "count(//dataset/keyword | //dataset/title)")
RESOURCE = (C.Dialect("datacite", "boolean(/*[local-name() = 'resource'])"),)
EML = (
    C.Dialect("eml", "boolean(/*[local-name() = 'eml'])"),
    C.Dialect("schema.org", json_path='.["@context"][0]'),
)

REGISTRY = C.Registry(
    [
        C.Check("title.length", C.longer_than("title", 40), "Title length", "Findable", "OPTIONAL", selectors=(TITLE,)),
        C.Check(
            "abstract.words", C.min_words("abstract", 100), "Abstract length", "Findable", "INFO",
            selectors=(ABSTRACT,), dialects=EML,
        ),
        C.Check("keywords.unique", C.unique_items("keywords"), "Keywords differ", "Interoperable", "REQUIRED", selectors=(KEYWORDS,)),
        C.Check("entities.present", C.positive_count("entities"), "Entities", "Accessible", "INFO", selectors=(ENTITIES,)),
        C.Check("check.echo.funder.title", C.echo("title"), "Echo", None, "METADATA", selectors=(TITLE,)),
        C.Check("format.echo", C.echo_system("format_id"), "Format", None, "METADATA"),
    ]
)
SUITE = C.Suite(
    "documents.suite.1",
    (
        C.CheckRef("title.length"),
        C.CheckRef("abstract.words", level="REQUIRED"),
        C.CheckRef("keywords.unique"),
        C.CheckRef("license.present", "Reusable", "REQUIRED"),
        C.CheckRef("entities.present"),
        C.CheckRef("check.echo.funder.title"),
        C.CheckRef("format.echo"),
    ),
)

_WORDS = r"len(string_split_regex(regexp_replace(regexp_replace(abstract, '^[ \t\n\r\f\x0B]+', ''), '[ \t\n\r\f\x0B]+$', ''), '[ \t\n\r\f\x0B]+'))"
_BLANK = r"regexp_replace(abstract, '^[ \t\n\r\f\x0B]+', '') = ''"

RESULTS = f"""{DOCS}, checked AS (
    SELECT pid, 0 AS position, 'title.length' AS check_id, 'Findable' AS type, 'OPTIONAL' AS level,
        CASE WHEN length(title) > 40 THEN 'SUCCESS' ELSE 'FAILURE' END AS status, NULL AS output
    FROM docs_v WHERE is_json OR NOT is_broken
    UNION ALL
    SELECT pid, 1, 'abstract.words', 'Findable', 'REQUIRED',
        CASE WHEN is_other AND NOT is_json THEN 'SKIP' WHEN {_BLANK} THEN 'FAILURE' WHEN {_WORDS} < 100 THEN 'FAILURE' ELSE 'SUCCESS' END,
        CASE WHEN is_other AND NOT is_json THEN 'Dialect for this check is not supported' WHEN {_BLANK} THEN 'The abstract is blank'
            WHEN {_WORDS} < 100 THEN concat('The abstract word count of ''', {_WORDS}, ''' is less that the recommended minimum of ''100''')
            ELSE concat('The abstract is valid, with a word count of ', {_WORDS}) END
    FROM docs_v WHERE is_json OR NOT is_broken
    UNION ALL
    SELECT pid, 2, 'keywords.unique', 'Interoperable', 'REQUIRED',
        CASE WHEN len(keywords) > len(list_distinct(keywords)) THEN 'FAILURE' ELSE 'SUCCESS' END, NULL
    FROM docs_v WHERE is_json OR NOT is_broken
    UNION ALL
    SELECT pid, 3, 'license.present', 'Reusable', 'REQUIRED', 'SKIP', 'Could not locate referenced check in store: license.present'
    FROM docs_v WHERE is_json OR NOT is_broken
    UNION ALL
    SELECT pid, 4, 'entities.present', 'Accessible', 'INFO', CASE WHEN is_json THEN 'FAILURE' ELSE 'SUCCESS' END, NULL
    FROM docs_v WHERE is_json OR NOT is_broken
    UNION ALL
    SELECT pid, 5, 'check.echo.funder.title', NULL, 'METADATA', CASE WHEN title <> '' THEN 'SUCCESS' ELSE 'FAILURE' END,
        CASE WHEN title <> '' THEN title END
    FROM docs_v WHERE is_json OR NOT is_broken
    UNION ALL
    SELECT pid, 6, 'format.echo', NULL, 'METADATA', 'SUCCESS', lang
    FROM docs_v WHERE is_json OR NOT is_broken)"""

_COUNTS = """SELECT pid,
    count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA')) AS checks_passed,
    count(*) FILTER (WHERE status = 'FAILURE' AND level = 'OPTIONAL') AS checks_warned,
    count(*) FILTER (WHERE status = 'FAILURE' AND level = 'REQUIRED') AS checks_failed,
    count(*) FILTER (WHERE status = 'ERROR') AS checks_errored,
    count(*) FILTER (WHERE status = 'SKIP') + count(*) FILTER (WHERE level = 'INFO') AS checks_info,
    count(*) - count(*) FILTER (WHERE level = 'METADATA') AS check_count,
    CASE WHEN count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA'))
            + count(*) FILTER (WHERE status IN ('FAILURE', 'ERROR') AND level = 'REQUIRED') = 0 THEN 'NaN'::DOUBLE
        ELSE count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA'))
            / (count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA'))
            + count(*) FILTER (WHERE status IN ('FAILURE', 'ERROR') AND level = 'REQUIRED'))::DOUBLE END AS score_overall
    FROM checked GROUP BY pid"""


def suite_runs(t) -> DataFrame:
    return run_suite(documents(t), SUITE, REGISTRY)


def _texts(output: Column) -> Column:
    return F.array_join(F.transform(output, lambda o: o.value), "|")


@query("doc_suite_results", f"WITH {RESULTS} SELECT pid, CAST(position AS INT) AS position, check_id, type, level, status, output FROM checked")
def doc_suite_results(t):
    rows = explode_results(suite_runs(t))
    return rows.select("pid", "position", "check_id", "type", "level", "status", _texts(F.col("output")).alias("output"))


@query("doc_suite_scores", f"WITH {RESULTS} {_COUNTS}")
def doc_suite_scores(t):
    """Suite run and scores of every document: no shuffle from body to score."""
    runs = suite_runs(t).filter("run_status = 'success'").drop("sysmeta")
    return O.score_arrays(runs).drop("suite_id", "run_status", "error_description", "results")


@query(
    "doc_run_status",
    f"WITH {DOCS} SELECT pid, CASE WHEN is_broken AND NOT is_json THEN 'failure' ELSE 'success' END AS run_status FROM docs_v",
)
def doc_run_status(t):
    return suite_runs(t).select("pid", "run_status")


@query("doc_results_grouped", f"WITH {RESULTS} SELECT type, level, status, count(*) AS n FROM checked GROUP BY type, level, status")
def doc_results_grouped(t):
    return explode_results(suite_runs(t)).groupBy("type", "level", "status").agg(F.count(F.lit(1)).alias("n"))


_CLEAN_TITLE = """CASE WHEN title = '' THEN NULL
    ELSE regexp_replace(regexp_replace(regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '^ ', ''), ' $', '') END"""
#: Scores by type of ``SUITE``: what is only informative or skipped scores 0.
_BY_TYPE = """typed AS (SELECT pid, type, CAST(round_even(CASE WHEN p + b = 0 THEN 0.0 ELSE p / (p + b)::DOUBLE END, 2) AS FLOAT) AS score FROM (
        SELECT pid, type, count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA')) AS p,
            count(*) FILTER (WHERE status IN ('FAILURE', 'ERROR') AND level = 'REQUIRED') AS b FROM checked WHERE type IS NOT NULL GROUP BY pid, type)),
    wide AS (SELECT pid, max(score) FILTER (WHERE type = 'Findable') AS score_findable, max(score) FILTER (WHERE type = 'Accessible') AS score_accessible,
        max(score) FILTER (WHERE type = 'Interoperable') AS score_interoperable, max(score) FILTER (WHERE type = 'Reusable') AS score_reusable
        FROM typed GROUP BY pid)"""
_SCORE_NAMES = ["score_findable", "score_accessible", "score_interoperable", "score_reusable"]


@query(
    "score_rows",
    f"""WITH {RESULTS}, counted AS ({_COUNTS}), {_BY_TYPE} SELECT c.pid AS metadata_id, lang AS metadata_format_id, source AS datasource,
        concat('series-', c.pid % 10) AS series_id, concat('seq-', c.pid % 7) AS sequence_id, TIMESTAMP '2024-01-01 00:00:00' AS ts,
        concat('g-', source) AS group_subject, coalesce({_CLEAN_TITLE}, '') AS funder, concat('A ', lang) AS funder_info,
        checks_passed, score_overall, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _SCORE_NAMES)}
        FROM counted c JOIN docs_v d USING (pid) JOIN wide USING (pid)""",
)
def score_rows(t):
    """Index rows with times, ids, groups, all funders, award outputs and scores by type."""
    meta = F.col("sysmeta").withField("series_id", F.concat(F.lit("series-"), (F.col("pid") % 10).cast("string")))
    award = C.Check("check.lookup.award.1", lambda v: C.outcome(F.lit("SUCCESS"), F.concat(F.lit("A "), v["sysmeta"]["format_id"])), level="METADATA")
    registry = C.Registry([*(REGISTRY.get(i) for i in REGISTRY.ids()), award])
    suite = C.Suite(SUITE.id, (*SUITE.checks, C.CheckRef(award.id)))
    runs = run_suite(documents(t), suite, registry).filter("run_status = 'success'").withColumns(
        {
            "run_id": F.col("pid"),
            "sysmeta": meta,
            "ts": F.expr("TIMESTAMP '2024-01-01 00:00:00'"),
            "sequence_id": F.concat(F.lit("seq-"), (F.col("pid") % 7).cast("string")),
            "groups": F.array(F.concat(F.lit("g-"), F.col("sysmeta.origin_member_node"))),
        }
    )
    rows = O.score_rows(runs)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select(
        "metadata_id", "metadata_format_id", "datasource", "series_id", "sequence_id", "ts", F.array_join("groups", "|").alias("group_subject"),
        joined("funder"), joined("funder_info"), "checks_passed", "score_overall", *[F.col(n).cast("double").alias(n) for n in _SCORE_NAMES],
    )


# Versions of documents in threes, uploaded over 700 days; broken documents have no run.
_DATED = f"""stored AS (SELECT DISTINCT pid, TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(pid % 700 AS INT)) AS date_uploaded FROM checked),
    scored AS (SELECT s.pid, date_uploaded, CAST(date_trunc('month', date_uploaded) AS DATE) AS ym,
        CASE WHEN s.pid % 3 = 0 THEN s.pid WHEN s.pid % 3 = 1 AND s.pid - 1 IN (SELECT pid FROM stored) THEN s.pid - 1
            WHEN s.pid % 3 = 2 AND s.pid - 1 IN (SELECT pid FROM stored) AND s.pid - 2 IN (SELECT pid FROM stored) THEN s.pid - 2 END AS sequence_id,
        {', '.join(f'CAST({n} AS DOUBLE) * 100.0 AS {k}' for k, n in zip('fair', _SCORE_NAMES))} FROM stored s JOIN wide USING (pid)),
    latest AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ym, sequence_id ORDER BY date_uploaded DESC) AS rk FROM scored) WHERE rk = 1)"""


@query(
    "report_from_documents",
    f"WITH {RESULTS}, {_BY_TYPE}, {_DATED}" + series_sql() + " SELECT ym, metric, round(mean, 6) AS mean FROM long",
)
def report_from_documents(t):
    """One path from documents to a report: runs, sequences, scores, monthly and cumulative means."""
    uploaded = F.expr("TIMESTAMP '2020-01-01 00:00:00'") + F.make_dt_interval(days=(F.col("pid") % 700).cast("int"))
    obsoletes = F.when(F.col("pid") % 3 != 0, F.col("pid") - 1)
    meta = F.col("sysmeta").withField("date_uploaded", uploaded).withField("obsoletes", obsoletes.cast("string"))
    runs = run_suite(documents(t).withColumn("sysmeta", meta), SUITE, REGISTRY).filter("run_status = 'success'").withColumn("run_id", F.col("pid"))
    rows = cut_lineage(O.score_rows(runs).drop("sequence_id"))
    stored = rows.selectExpr("suite_id", "metadata_id AS pid", "CAST(obsoletes AS BIGINT) AS obsoletes", "CAST(NULL AS BIGINT) AS obsoleted_by", "CAST(NULL AS BIGINT) AS sequence_id")
    ids = Q.assign_sequence(stored).selectExpr("suite_id", "pid AS metadata_id", "sequence_id")
    report = U.collection_report(rows.join(ids, ["suite_id", "metadata_id"]))
    return report.select("ym", "metric", F.round("mean", 6).alias("mean")).orderBy("ym", "metric")


@query("score_from_run_xml", f"WITH {RESULTS} {_COUNTS}")
def score_from_run_xml(t):
    """Runs written as XML and counted by XPath."""
    runs = suite_runs(t).filter("run_status = 'success'").withColumn("run_id", F.col("pid"))
    texts = W.run_xml(runs).select("pid", "run_xml")
    return O.score_run_xml(texts).drop("run_xml")


@query(
    "run_xml_read",
    f"WITH {RESULTS} SELECT pid, count(*) AS n, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, max(type) AS last_type FROM checked GROUP BY pid",
)
def run_xml_read(t):
    runs = suite_runs(t).filter("run_status = 'success'").withColumn("run_id", F.col("pid"))
    back = W.run_xml(runs).select(W.read_run_xml(F.col("run_xml")).alias("r"))
    return back.select(
        F.col("r.objectIdentifier").cast("bigint").alias("pid"),
        F.size("r.result").cast("bigint").alias("n"),
        F.size(F.filter("r.result", lambda x: x.status == "SUCCESS")).cast("bigint").alias("n_success"),
        F.array_max(F.transform("r.result", lambda x: x.check.type)).alias("last_type"),
    )


@query(
    "run_json",
    f"""WITH {RESULTS} SELECT pid, '{{"pid":' || pid || ',"type":' || CASE WHEN type IS NULL THEN 'null' ELSE '"' || type || '"' END
        || ',"status":"' || status || '"}}' AS json, type, status FROM checked""",
)
def run_json(t):
    rows = explode_results(suite_runs(t))
    text = W.to_json_text(F.struct("pid", "type", "status"))
    back = W.from_json_text(text, "pid bigint, type string, status string")
    return rows.select("pid", text.alias("json"), back["type"].alias("type"), back["status"].alias("status"))


@query(
    "single_check",
    f"""WITH {DOCS} SELECT pid, CASE WHEN length(title) > 40 THEN 'SUCCESS' ELSE 'FAILURE' END AS status
        FROM docs_v WHERE is_json OR NOT is_broken""",
)
def single_check(t):
    runs = run_check(documents(t), REGISTRY.get("title.length"))
    return explode_results(runs).select("pid", "status")


@query(
    "strict_dialect",
    f"""WITH {DOCS} SELECT pid, CASE WHEN is_json THEN 'SUCCESS' ELSE 'SKIP' END AS status
        FROM docs_v WHERE is_json OR NOT is_broken""",
)
def strict_dialect(t):
    only = C.Check(
        "json.only",
        lambda v: C.outcome(F.lit("SUCCESS")),
        dialects=(C.Dialect("schema.org", json_path='.["@context"][0]'),),
    )
    suite = C.Suite("strict", (C.CheckRef("json.only"),))
    runs = run_suite(documents(t), suite, C.Registry([only]), strict_json=True)
    return explode_results(runs).select("pid", "status")


@query(
    "data_suite",
    f"""WITH {DOCS} SELECT pid, CASE WHEN is_broken AND NOT is_json THEN 'failure' WHEN quality = 1 THEN 'success' ELSE 'failure' END AS run_status,
        CASE WHEN is_broken AND NOT is_json THEN NULL WHEN quality = 1 THEN NULL ELSE 'Could not retrieve data objects.' END AS error
        FROM docs_v LEFT JOIN labels ON doc_id = pid""",
)
def data_suite(t):
    """A data suite fails on documents without data objects; here the labelled ones have some."""
    n = t("labels").filter("quality = 1").selectExpr("doc_id AS pid", "CAST(quality AS BIGINT) AS n_data")
    docs = documents(t).join(n, "pid", "left")
    suite = C.Suite("data-suite-1", (C.CheckRef("title.length"),))
    runs = run_suite(docs, suite, REGISTRY)
    message = F.when(F.col("error_description").startswith("Could not"), F.col("error_description"))
    return runs.select("pid", "run_status", message.alias("error"))


def _words(abstract):
    n = len(abstract.split(" "))
    if n > 500:
        raise ValueError("too many words")
    return {
        "status": "SUCCESS" if n > 50 else None,
        "output": [n, abstract[:5]],
        "output_identifiers": ["n", "start"],
        "output_type": ["number", "text"],
    }


@query(
    "python_check",
    f"""WITH {DOCS}, w AS (SELECT *, len(string_split(abstract, ' ')) AS n FROM docs_v WHERE is_json OR NOT (is_broken OR is_other))
        SELECT pid, CASE WHEN n > 500 THEN 'ERROR' WHEN n > 50 THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
        CASE WHEN n > 500 THEN 'too many words' ELSE concat(n, '|', substring(abstract, 1, 5)) END AS output,
        CASE WHEN n > 500 THEN NULL ELSE 'start' END AS identifier FROM w""",
)
def python_check(t):
    """Opaque Python code under the status and output contract, in Arrow batches."""
    check = C.Check("py.words", C.python_check(_words), selectors=(ABSTRACT,), dialects=EML)
    rows = explode_results(run_check(documents(t), check)).filter("status <> 'SKIP'")
    return rows.select(
        "pid", "status", _texts(F.col("output")).alias("output"), F.get("output", F.lit(1))["identifier"].alias("identifier")
    )


class LongTitle:
    title = None
    least = 30

    def __call__(self):
        return ("SUCCESS" if len(self.title) > self.least else "FAILURE"), self.title[:3]


@query(
    "class_check",
    f"""WITH {DOCS} SELECT pid, CASE WHEN length(title) > 30 THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
        substring(title, 1, 3) AS output FROM docs_v WHERE is_json OR NOT is_broken""",
)
def class_check(t):
    check = C.Check("class.title", C.class_check(LongTitle, title="title"), selectors=(TITLE,))
    return explode_results(run_check(documents(t), check)).select("pid", "status", _texts(F.col("output")).alias("output"))


@query(
    "presence_check",
    f"""WITH {DOCS} SELECT pid, CASE WHEN len(keywords) = 1 THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
        CASE WHEN len(keywords) = 1 THEN 'Object ''keywords'' was present and was of length one.'
            ELSE concat('Object ''keywords'' was of length ', len(keywords), ' when it was expected to be of length one.') END
        || '|Object ''title'' was present and was of length one.' AS output
        FROM docs_v WHERE is_json OR NOT is_broken""",
)
def presence_check(t):
    check = C.Check("presence", C.all_present("keywords", "title"), selectors=(KEYWORDS, TITLE))
    rows = explode_results(run_check(documents(t), check))
    return rows.select("pid", "status", _texts(F.col("output")).alias("output"))


def _second(v):
    same = F.element_at(v["title"]["items"], 1) == F.element_at(v["keywords"]["items"], 1)
    return C.outcome(C.passed(same & (v["previous_status"] == "SUCCESS")))


@query(
    "inherited_state",
    f"""WITH {DOCS} SELECT pid, CASE WHEN title = keywords[1] AND length(title) > 20 THEN 'SUCCESS' ELSE 'FAILURE' END AS status
        FROM docs_v WHERE is_json OR NOT is_broken""",
)
def inherited_state(t):
    """The second check sees the first one's variables and status."""
    first = C.Check("first", C.longer_than("title", 20), selectors=(TITLE,))
    second = C.Check("second", _second, inherit_state=True, selectors=(KEYWORDS,))
    suite = C.Suite("inherit", (C.CheckRef("first"), C.CheckRef("second")))
    runs = run_suite(documents(t), suite, C.Registry([first, second]))
    return explode_results(runs).filter("check_id = 'second'").select("pid", "status")


def _per_line(words, n_lines):
    return {"status": "SUCCESS", "output": words, "ratio": float(words) / float(n_lines)}


def _judged(v):
    return C.outcome(C.passed(F.round(v["ratio"].cast("double") * v["n_lines"]) == v["words"]), v["ratio"])


@query(
    "computed_state",
    f"""SELECT pid, len(string_split(abstract, ' ')) AS words, len(keywords) AS n_lines, 'SUCCESS' AS status,
        CAST(len(string_split(abstract, ' ')) AS DOUBLE) / len(keywords) AS ratio FROM docs_v WHERE NOT is_json AND NOT is_broken AND NOT is_other""".replace("SELECT", f"WITH {DOCS} SELECT", 1),
)
def computed_state(t):
    """What a Column check and a Python check compute is seen by the checks after them."""
    text = lambda v: F.element_at(v["abstract"]["items"], 1)
    counted = C.computes(
        lambda v: C.outcome(F.lit("SUCCESS")), words=lambda v: F.size(F.split(text(v), " ")), n_lines=lambda v: F.size(v["keywords"]["items"])
    )
    registry = C.Registry(
        [
            C.Check("1.count", counted, selectors=(ABSTRACT, KEYWORDS)),
            C.Check("2.divide", C.python_check(_per_line, state=("ratio",)), inherit_state=True),
            C.Check("3.judge", _judged, inherit_state=True),
            C.Check("4.words", lambda v: C.outcome(C.passed(v["words"] > 0), F.concat_ws(" ", v["words"], v["n_lines"])), inherit_state=True),
        ]
    )
    suite = C.Suite("state", tuple(C.CheckRef(i) for i in registry.ids()))
    docs = documents(t).filter(f"NOT ({_IS_OTHER})".replace("lang", "sysmeta.format_id"))
    runs = run_suite(docs.filter(~X.is_json_format(F.col("format_id"))), suite, registry).filter("run_status = 'success'")
    said = lambda i: F.col("results")[i]["output"][0]["value"]
    return runs.select(
        "pid",
        F.split(said(3), " ")[0].cast("bigint").alias("words"),
        F.split(said(3), " ")[1].cast("bigint").alias("n_lines"),
        F.col("results")[2]["status"].alias("status"),
        said(2).cast("double").alias("ratio"),
    )


@query(
    "document_variables",
    """SELECT doc_id AS pid, CASE WHEN length(text) > 5 AND list_contains(['p-' || doc_id, 'q'], 'p-' || doc_id) AND lang = 'en' THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
        md5(regexp_replace(text, '[<>&]', ' ', 'g')) || ' 2020-01-02T03:04:05.000Z ' || source || ' ' || doc_id || ' 2 ' || lang AS output FROM documents""",
)
def document_variables(t):
    """The whole document, its system metadata, parameters and data objects as variables of a check."""

    def run(v):
        node = F.concat_ws(" ", F.md5(F.regexp_extract(v["document"], "(?s)^<doc>(.*)</doc>$", 1)), v["dateUploaded"], v["datasource"], v["systemMetadataPid"])
        ok = (F.length(v["document"]) > 16) & F.array_contains(v["dataPids"], F.concat(F.lit("p-"), v["pid"].cast("string"))) & (v["params"]["lang"] == v["sysmeta"]["format_id"])
        return C.outcome(C.passed(ok), F.concat_ws(" ", node, F.size(v["dataPids"]), v["sysmeta"]["format_id"]))

    body = F.concat(F.lit("<doc>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</doc>"))
    meta = F.struct(
        F.col("doc_id").cast("string").alias("identifier"), F.col("lang").alias("format_id"), F.col("source").alias("origin_member_node"),
        F.col("source").alias("authoritative_member_node"), F.expr("TIMESTAMP '2020-01-02 03:04:05'").alias("date_uploaded"),
    )
    pids = F.array(F.concat(F.lit("p-"), F.col("doc_id")), F.lit("q"))
    docs = t("documents").select(F.col("doc_id").alias("pid"), F.lit("eml").alias("format_id"), body.alias("body"), meta.alias("sysmeta"), pids.alias("data_pids"))
    rows = explode_results(run_check(docs, C.Check("variables", run), params={"lang": "en"}))
    return rows.select("pid", "status", _texts(F.col("output")).alias("output"))


@query(
    "list_outputs",
    f"WITH {DOCS} SELECT pid, unnest(keywords) AS value, CAST(unnest(range(1, len(keywords) + 1)) AS STRING) AS identifier FROM docs_v WHERE is_json OR NOT is_broken",
)
def list_outputs(t):
    """Every item of a list as an output with its identifier."""
    check = C.Check("lines", C.listed("keywords"), selectors=(KEYWORDS,))
    rows = explode_results(run_check(documents(t), check)).select("pid", F.inline("output"))
    return rows.select("pid", "value", "identifier")


@query(
    "table_outputs",
    f"""WITH {DOCS} SELECT pid, 'SUCCESS' AS status, unnest(keywords) AS value, 'line' AS type, CAST(unnest(range(1, len(keywords) + 1)) AS STRING) AS identifier
        FROM docs_v WHERE NOT is_json AND NOT is_broken""",
)
def table_outputs(t):
    """A check as a table function: each output is a row as it arises, however many a document has."""

    def lines(keywords):
        for number, word in enumerate(keywords, 1):
            yield "SUCCESS", word, "line", number

    reader = X.DocumentReader([KEYWORDS])
    docs = reader.attach(documents(t).filter(~X.is_json_format(F.col("format_id")))).filter(reader.ok)
    return C.outputs(docs, C.table_check(lines), {"keywords": reader.values(KEYWORDS)}, ["pid"])


@query(
    "echo_checks",
    f"""WITH {DOCS} SELECT pid, check_id, status, output FROM (
        SELECT pid, 'echo.value' AS check_id, CASE WHEN title <> '' THEN 'SUCCESS' ELSE 'FAILURE' END AS status, nullif(title, '') AS output
        FROM docs_v WHERE is_json OR NOT is_broken
        UNION ALL SELECT pid, 'echo.format', 'SUCCESS', lang FROM docs_v WHERE is_json OR NOT is_broken
        UNION ALL SELECT pid, 'echo.holder', 'SUCCESS', source FROM docs_v WHERE is_json OR NOT is_broken
        UNION ALL SELECT pid, 'echo.datasource', 'SUCCESS', source FROM docs_v WHERE is_json OR NOT is_broken)""",
)
def echo_checks(t):
    registry = C.Registry(
        [
            C.Check("echo.value", C.echo("title"), selectors=(TITLE,)),
            C.Check("echo.format", C.echo_system("format_id")),
            C.Check("echo.holder", C.echo_system("rights_holder")),
            C.Check("echo.datasource", C.echo_system("origin_member_node")),
        ]
    )
    suite = C.Suite("echo", tuple(C.CheckRef(i) for i in registry.ids()))
    rows = explode_results(run_suite(documents(t), suite, registry))
    return rows.select("pid", "check_id", "status", _texts(F.col("output")).alias("output"))


FAIR_CHECKS = C.Registry(
    [
        C.Check("resource.abstractLength.sufficient-2.0.0", C.min_words("abstract", 100), selectors=(TYPED_ABSTRACT,), dialects=RESOURCE),
        C.Check("resource.titleLength.sufficient.1", C.longer_than("title", 40), selectors=(X.Selector("title", "(//title)[1]"),)),
        C.Check("resource.keywords.present-2.1.0", C.any_present("keywords"), selectors=(X.Selector("keywords", "//subjects/subject"),)),
        C.Check("entity.attributeNames.unique-2.0.0", C.unique_items("attributeNames"), selectors=(ATTRIBUTE_NAMES,)),
        C.Check(
            "resource.publicationDate.timeframe-2.0.0",
            C.in_time_frame("published", "2024-01-01"),
            selectors=(X.Selector("published", "/resource/dates/date[@dateType='Issued']", ".datePublished"),),
        ),
    ]
)


_NAMES = "list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"


@query(
    "suite_roster",
    f"""SELECT doc_id AS pid, CAST(52 AS BIGINT) AS check_count, CAST(47 AS BIGINT) AS checks_skipped,
        CAST(length(substring(text, 1, 60)) > 40 AS BIGINT) + CAST(len(string_split_regex(regexp_replace(regexp_replace(text,
            '^[ \t\n\r\f\x0B]+', ''), '[ \t\n\r\f\x0B]+$', ''), '[ \t\n\r\f\x0B]+')) >= 100 AS BIGINT)
            + CAST(len(list_filter({_LINES}, lambda k: regexp_replace(k, '^[ \t\n\r\f\x0B]+', '') <> '')) > 0 AS BIGINT)
            + CAST(len({_NAMES}) = len(list_distinct({_NAMES})) AS BIGINT) + CAST(source <> 'src1' AS BIGINT) AS n_success
        FROM documents""",
)
def suite_roster(t):
    """The FAIR roster over typed documents with attribute names; checks without a registered function are SKIP."""
    results = explode_results(run_suite(_resources(t), _roster(t), FAIR_CHECKS))
    return results.groupBy("pid").agg(
        F.count(F.lit(1)).alias("check_count"),
        F.count_if(F.col("status") == "SKIP").alias("checks_skipped"),
        F.count_if(F.col("status") == "SUCCESS").alias("n_success"),
    )


def _roster(t) -> C.Suite:
    """The roster, written as a suite definition file and read back."""
    check = lambda r: F.struct(F.lit(r.check_id).alias("id"), F.lit(r.type).alias("type"), F.lit(r.level).alias("level"))
    body = F.struct(F.lit(FAIR_SUITE.id).alias("id"), F.lit(FAIR_SUITE.name).alias("name"), F.array(*map(check, FAIR_SUITE.checks)).alias("check"))
    path = scratch_path(t.spark, "suites")
    t.spark.range(1).select(F.to_xml(body, {"rowTag": "suite"})).coalesce(1).write.text(path)
    return D.suite_objects(D.read_suites(t.spark, [path], glob="*.txt"))[0]


@query("format_routing", f"WITH {DOCS} SELECT pid, CASE WHEN is_json THEN 'json' ELSE 'xml' END AS dialect FROM docs_v")
def format_routing(t):
    return routed(documents(t)).select("pid", "dialect")


# Extraction -------------------------------------------------------------------


@query(
    "xml_select",
    f"""WITH {DOCS} SELECT pid, title, len(keywords) AS n_keywords, CAST(len(keywords) + 1 AS DOUBLE) AS entities,
        CASE WHEN is_other THEN 'report' ELSE 'eml' END AS root FROM docs_v WHERE NOT is_json AND NOT is_broken""",
)
def xml_select(t):
    """Element paths, a scalar XPath and a name test, from one parse per document."""
    name = X.Selector("root", "local-name(/*)")
    reader = X.DocumentReader([TITLE, KEYWORDS, ENTITIES, name])
    docs = reader.attach(documents(t).filter(~X.is_json_format(F.col("format_id")))).filter(reader.ok)
    return docs.select(
        "pid",
        F.element_at(reader.values(TITLE), 1).alias("title"),
        F.size(reader.values(KEYWORDS)).cast("bigint").alias("n_keywords"),
        F.element_at(reader.values(ENTITIES), 1).cast("double").alias("entities"),
        F.element_at(reader.values(name), 1).alias("root"),
    )


@query("well_formed", f"WITH {DOCS} SELECT pid, NOT is_broken AS ok, is_broken AS has_error FROM docs_v WHERE NOT is_json")
def well_formed(t):
    """Malformed documents are told apart by the reader, with the parser's message."""
    docs = documents(t).filter(~X.is_json_format(F.col("format_id")))
    reader = X.DocumentReader([TITLE])
    return reader.attach(docs).select("pid", reader.ok.alias("ok"), reader.error.isNotNull().alias("has_error"))


def _element(name: str, text: Column) -> Column:
    """Element of a prefixed name, which ``to_xml`` does not write."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def _prefixed(t) -> DataFrame:
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda line: _element("a:line", line)), "")
    body = F.concat(
        F.lit('<a:doc xmlns:a="urn:one" xmlns:b="urn:two" b:lang="'),
        F.col("lang"),
        F.lit('"><a:part>'),
        _element("b:title", F.substring("text", 1, 60)),
        lines,
        F.lit("</a:part></a:doc>"),
    )
    return t("documents").select(F.col("doc_id").alias("pid"), body.alias("body"))


@query(
    "namespace_select",
    """SELECT doc_id AS pid, substring(text, 1, 60) AS title, substring(text, 1, 60) AS plain, len(string_split(text, chr(10))) AS n_lines,
        CAST(0 AS BIGINT) AS n_wrong, lang FROM documents""",
)
def namespace_select(t):
    """Prefixes bound by the selector, by the document, or to another uri."""
    mine = {"p": "urn:one", "q": "urn:two"}
    title = X.Selector("title", "/p:doc/p:part/q:title", namespace_aware=True, namespaces=mine)
    plain = X.Selector("plain", "/doc/part/title")
    lines = X.Selector("lines", "//a:line", namespace_aware=True)
    wrong = X.Selector("wrong", "//a:line", namespace_aware=True, namespaces={"a": "urn:other"})
    lang = X.Selector("lang", "/doc/@lang")
    reader = X.DocumentReader([title, plain, lines, wrong, lang])
    docs = reader.attach(_prefixed(t))
    size = lambda s: F.size(reader.values(s)).cast("bigint")
    return docs.select(
        "pid",
        F.element_at(reader.values(title), 1).alias("title"),
        F.element_at(reader.values(plain), 1).alias("plain"),
        size(lines).alias("n_lines"),
        size(wrong).alias("n_wrong"),
        F.element_at(reader.values(lang), 1).alias("lang"),
    )


@query(
    "namespace_predicates",
    """SELECT doc_id AS pid, string_split(text, chr(10))[2] AS second, string_split(text, chr(10))[-1] AS last_one,
        len(string_split(text, chr(10))) - 1 AS n_behind, CASE WHEN lang = 'en' THEN substring(text, 1, 60) END AS english,
        CAST(0 AS BIGINT) AS n_unbound FROM documents""",
)
def namespace_predicates(t):
    """Predicates in namespace-aware paths; an unbound prefix matches nothing."""
    aware = lambda name, xpath, **bound: X.Selector(name, xpath, namespace_aware=True, namespaces=bound)
    second = aware("second", "//a:line[2]")
    last = aware("last", "//p:part[q:title]/p:line[last()]", p="urn:one", q="urn:two")
    behind = aware("behind", "//a:line/following-sibling::a:line")
    english = aware("english", "/a:doc[@b:lang = 'en']/a:part/b:title[1]")
    unbound = aware("unbound", "//c:line[1]")
    reader = X.DocumentReader([second, last, behind, english, unbound])
    docs = reader.attach(_prefixed(t))
    size = lambda s: F.size(reader.values(s)).cast("bigint")
    return docs.select(
        "pid",
        F.get(reader.values(second), F.lit(0)).alias("second"),
        F.get(reader.values(last), F.lit(0)).alias("last_one"),
        size(behind).alias("n_behind"),
        F.get(reader.values(english), F.lit(0)).alias("english"),
        size(unbound).alias("n_unbound"),
    )


def _resources(t) -> DataFrame:
    """Documents with typed descriptions, subjects with attributes, and a table with attribute names."""
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(line.alias("_VALUE"), F.when(i % 2 == 0, "even").otherwise("odd").alias("_scheme"))
    )
    described = lambda text, kind: F.struct(text.alias("_VALUE"), F.lit(kind).alias("_descriptionType"))
    words = F.filter(F.split("text", "[ \t\n\r\f\x0B]+"), lambda w: w != "")
    names = F.transform(words, lambda w: F.struct(w.alias("attributeName")))
    body = F.to_xml(
        F.struct(
            F.struct(F.array(F.substring("text", 1, 60), F.col("source")).alias("title")).alias("titles"),
            F.struct(F.array(described(F.col("lang"), "Methods"), described(F.col("text"), "Abstract")).alias("description")).alias("descriptions"),
            F.struct(lines.alias("subject")).alias("subjects"),
            F.struct(F.struct(names.alias("attribute")).alias("attributeList")).alias("dataTable"),
            F.col("n_chars").alias("size"),
            F.struct(F.struct(F.when(F.col("source") == "src1", "2025-01-01").otherwise("2020-05-17").alias("_VALUE"), F.lit("Issued").alias("_dateType")).alias("date")).alias("dates"),
        ),
        {"rowTag": "resource"},
    )
    return t("documents").select(F.col("doc_id").alias("pid"), F.lit("datacite").alias("format_id"), body.alias("body"))




@query(
    "xpath_predicates",
    f"""SELECT doc_id AS pid, md5(text) AS abstract, source AS second_title, {_LINES}[-1] AS last_one, {_LINES}[2] AS second,
        CAST((len({_LINES}) + 1) // 2 AS BIGINT) AS n_even, CAST(len({_LINES}) // 2 AS BIGINT) AS n_not_even, len({_LINES}) - 1 AS n_behind,
        'Methods,Abstract' AS kinds, CASE WHEN n_chars > 500 THEN lang END AS of_long FROM documents""",
)
def xpath_predicates(t):
    """Attribute, position, child-value and negated predicates, other axes, and sub-selectors with them."""
    S_ = X.Selector
    one = {
        "second_title": S_("second_title", "(//title)[2]"),
        "last_one": S_("last_one", "/resource/subjects/subject[last()]"),
        "second": S_("second", "//subject[position() = 2 and @scheme]"),
        "of_long": S_("of_long", "/resource[size > 500]/descriptions/./description[@descriptionType != 'Abstract'][1]"),
    }
    many = {
        "n_even": S_("n_even", "//subject[@scheme='even' or @scheme='none']"),
        "n_not_even": S_("n_not_even", "//subject[not(@scheme='even')]"),
        "n_behind": S_("n_behind", "//subject/following-sibling::subject"),
    }
    kinds = S_("kinds", "//descriptions/description[@descriptionType]", sub=X.SubSelector("kind", "@descriptionType"))
    reader = X.DocumentReader([TYPED_ABSTRACT, kinds, *one.values(), *many.values()])
    docs = reader.attach(_resources(t))
    return docs.select(
        "pid",
        F.md5(F.coalesce(F.get(reader.values(TYPED_ABSTRACT), F.lit(0)), F.lit(""))).alias("abstract"),
        *[F.get(reader.values(s), F.lit(0)).alias(n) for n, s in one.items()],
        *[F.size(reader.values(s)).cast("bigint").alias(n) for n, s in many.items()],
        F.array_join(F.flatten(reader.nested(kinds)), ",").alias("kinds"),
    )


@query(
    "xpath_scalars",
    f"""SELECT doc_id AS pid, CASE WHEN len({_LINES}) > 1 THEN 'true' ELSE 'false' END AS several, CASE WHEN source = 'src1' THEN 'true' ELSE 'false' END AS same,
        CAST(2 * n_chars + 3 AS STRING) AS sum, CAST(n_chars // 2 AS STRING) AS half, concat(lang, '-', source) AS joined, CAST(length(lang) AS STRING) AS n_lang FROM documents""",
)
def xpath_scalars(t):
    """Comparisons, arithmetic and functions give their text."""
    exprs = {
        "several": "count(//subject) > 1",
        "same": "//title = 'src1'",
        "sum": "2 * /resource/size + 3",
        "half": "floor(/resource/size div 2)",
        "joined": "concat(//description[@descriptionType='Methods'], '-', //title[2])",
        "n_lang": "string-length(//description[1])",
    }
    selectors = {n: X.Selector(n, x) for n, x in exprs.items()}
    reader = X.DocumentReader(list(selectors.values()))
    docs = reader.attach(_resources(t))
    return docs.select("pid", *[F.get(reader.values(s), F.lit(0)).alias(n) for n, s in selectors.items()])


@query(
    "xpath_errors",
    f"""SELECT doc_id AS pid, c AS check_id, CASE c WHEN 'abstract' THEN CASE WHEN length(text) > 100 THEN 'SUCCESS' ELSE 'FAILURE' END
        WHEN 'names' THEN CASE WHEN len({_NAMES}) > len(list_distinct({_NAMES}))
            THEN 'FAILURE' ELSE 'SUCCESS' END ELSE 'ERROR' END AS status
        FROM documents, (SELECT unnest(['abstract', 'names', 'bad.path', 'bad.function', 'bad.json']) AS c)""",
)
def xpath_errors(t):
    """A selector that cannot be read is an ERROR of its own check and leaves the others alone."""
    bad = lambda i, **how: C.Check(i, C.unique_items("x"), selectors=(X.Selector("x", **how),))
    registry = C.Registry(
        [
            C.Check("abstract", C.longer_than("abstract", 100), selectors=(TYPED_ABSTRACT,)),
            C.Check("names", C.unique_items("attributeNames"), selectors=(ATTRIBUTE_NAMES,)),
            bad("bad.path", xpath="//subject["),
            bad("bad.function", xpath="nosuch(//subject) > 2"),
            bad("bad.json", xpath="//subject", json_path=".a | map(.b)"),
        ]
    )
    suite = C.Suite("errors", tuple(C.CheckRef(i) for i in registry.ids()))
    return explode_results(run_suite(_resources(t), suite, registry)).select("pid", "check_id", "status")


@query("namespaces_used", "SELECT doc_id AS pid, u AS ns_uri, p AS prefix FROM documents, (VALUES ('urn:one', 'a'), ('urn:two', 'b')) v(u, p)")
def namespaces_used(t):
    return X.namespaces_of(_prefixed(t))


@query("root_namespace", "SELECT doc_id AS pid, 'doc' AS local, 'urn:one' AS ns_uri FROM documents")
def root_namespace(t):
    return X.root_namespace(_prefixed(t))


@query(
    "subselector_nested",
    """SELECT doc_id AS pid, len(string_split(text, chr(10))) AS n_outer,
        list_sum(list_transform(string_split(text, chr(10)), lambda l: len(string_split(l, ' '))))::BIGINT AS n_inner, md5(text) AS digest
        FROM documents""",
)
def subselector_nested(t):
    """Lists of inner values per outer node, in document order."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(F.split(line, " ").alias("word")))
    body = F.to_xml(F.struct(lines.alias("line")), {"rowTag": "doc"})
    words = X.Selector("words", "/doc/line", sub=X.SubSelector("word", "word"))
    reader = X.DocumentReader([words])
    docs = reader.attach(t("documents").select(F.col("doc_id").alias("pid"), body.alias("body")))
    nested = docs.select("pid", reader.nested(words).alias("v"))
    return nested.select(
        "pid",
        F.size("v").cast("bigint").alias("n_outer"),
        F.size(F.flatten("v")).cast("bigint").alias("n_inner"),
        F.md5(F.array_join(F.transform("v", lambda w: F.array_join(w, " ")), "\n")).alias("digest"),
    )


@query(
    "xml_nodes",
    f"""WITH {DOCS}, d AS (SELECT *, CASE WHEN is_other THEN '/report' ELSE '/eml' END AS root FROM docs_v WHERE NOT is_json AND NOT is_broken)
        SELECT path, sum(n)::BIGINT AS n FROM (
        SELECT root AS path, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT root || '/dataset', count(*) FROM d GROUP BY ALL
        UNION ALL SELECT root || '/dataset/title', count(*) FROM d GROUP BY ALL UNION ALL SELECT root || '/dataset/abstract', count(*) FROM d GROUP BY ALL
        UNION ALL SELECT root || '/dataset/keyword', sum(len(keywords)) FROM d GROUP BY root) GROUP BY path""",
)
def xml_nodes(t):
    """Node table of every document."""
    docs = documents(t).filter(~X.is_json_format(F.col("format_id")))
    return X.shred(docs).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_select",
    """SELECT event_id AS pid, CAST(NULL AS STRING) AS kind, CASE WHEN json_extract_string(props, '$.k') <> '0' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events""",
)
def json_select(t):
    """A lone JSON number selects null, unless scalars are asked for; a zero stays a string."""
    events = t("events").withColumnRenamed("event_id", "pid")
    read = X.with_json_values(events, "props", {"plain": ".k"})
    read = X.with_json_values(read, "props", {"scalar": ".k"}, scalars=True)
    return read.select("pid", F.col("plain.kind").alias("kind"), F.col("scalar.num").alias("k"))


@query(
    "json_lists",
    f"""WITH {DOCS} SELECT pid, title AS name, CASE WHEN len(keywords) > 1 THEN 'list' ELSE 'string' END AS kind, len(keywords) AS n,
        keywords[len(keywords)] AS last_one, 'https://schema.org/' AS context, 'list' AS missing FROM docs_v WHERE is_json""",
)
def json_lists(t):
    docs = documents(t).filter(X.is_json_format(F.col("format_id")))
    paths = {"title": ".name", "words": ".keywords[]", "ctx": '.["@context"] | .[0]', "none": ".nothing[]"}
    return X.with_json_values(docs, "body", paths).select(
        "pid",
        F.get("title.items", F.lit(0)).alias("name"),
        F.col("words.kind").alias("kind"),
        F.size("words.items").cast("bigint").alias("n"),
        F.element_at("words.items", -1).alias("last_one"),
        F.col("ctx.str").alias("context"),
        F.col("none.kind").alias("missing"),
    )


@query(
    "json_queries",
    f"""WITH {DOCS} SELECT pid, len(keywords) AS n_words, list_filter(keywords, lambda k: k <> '')[-1] AS last_full,
        CASE WHEN title <> '' THEN title ELSE 'none' END AS named, 'fallback' AS missing, CAST(length(title) AS BIGINT) AS n_title,
        len(list_filter(keywords, lambda k: k = keywords[1])) AS n_first, 1 AS n_object FROM docs_v WHERE is_json""",
)
def json_queries(t):
    """``length``, ``select``, optional steps and alternatives, over the whole documents."""
    docs = documents(t).filter(X.is_json_format(F.col("format_id")))
    body, node = F.col("body"), F.try_parse_json("body")
    one = lambda path, scalars=False: F.get(X.json_texts(body, path, scalars, node), F.lit(0))
    same = F.filter(X.json_texts(body, ".keywords[]", node=node), lambda k: k == one(".keywords[0]"))
    return docs.select(
        "pid",
        one(".keywords | length", True).cast("bigint").alias("n_words"),
        F.element_at(X.json_texts(body, '.keywords[] | select(. != "")', node=node), -1).alias("last_full"),
        F.coalesce(F.nullif(one('.name? // "none"'), F.lit("")), F.lit("none")).alias("named"),
        one('.nothing[]? | select(.x == 1) // .neither // "fallback"').alias("missing"),
        one(".name | length", True).cast("bigint").alias("n_title"),
        F.size(same).cast("bigint").alias("n_first"),
        F.size(X.json_texts(F.to_json(F.struct(F.struct("pid").alias("a"))), ".a", node=None)).cast("bigint").alias("n_object"),
    )


_RAW = """(SELECT p_partkey, unnest([p_name, CAST(p_size AS STRING), concat('0', p_size), concat(p_size, '.5'),
    CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'OFF' END, concat('-', p_size, 'e2'), p_brand, '', '1.2.3']) AS v FROM part)"""


@query(
    "retype_values",
    f"""SELECT p_partkey, v,
        CASE WHEN num THEN 'number' WHEN lower(v) IN ('true', 'on', 'yes', 'false', 'off', 'no') THEN 'boolean' ELSE 'string' END AS kind,
        CASE WHEN num THEN CAST(v AS DOUBLE) END AS num,
        CASE WHEN lower(v) IN ('true', 'on', 'yes') THEN true WHEN lower(v) IN ('false', 'off', 'no') THEN false END AS bool
        FROM (SELECT *, regexp_full_match(v, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND NOT regexp_full_match(v, '0[0-9]*') AS num FROM {_RAW})""",
)
def retype_values(t):
    size = F.col("p_size").cast("string")
    values = F.array(
        F.col("p_name"), size, F.concat(F.lit("0"), size), F.concat(size, F.lit(".5")),
        F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("OFF"),
        F.concat(F.lit("-"), size, F.lit("e2")), F.col("p_brand"), F.lit(""), F.lit("1.2.3"),
    )
    typed = t("part").select("p_partkey", F.explode(values).alias("v")).withColumn("x", F.expr(S.retype_sql("v")))
    return typed.select("p_partkey", "v", "x.kind", "x.num", "x.bool")


@query(
    "schema_valid",
    """SELECT doc_id AS pid, CASE WHEN lang = 'fr' THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
        CASE WHEN lang = 'fr' THEN 'Document is not schema valid' ELSE 'Document is schema valid' END AS output FROM documents""",
)
def schema_valid(t):
    size = F.when(F.col("lang") == "fr", F.lit("many")).otherwise(F.col("n_chars").cast("string"))
    body = F.to_xml(F.struct(F.col("text").alias("title"), size.alias("size")), {"rowTag": "doc"})
    checked = X.schema_check(F.col("body"), "title string, size bigint, _corrupt string")
    docs = t("documents").select(F.col("doc_id").alias("pid"), body.alias("body"))
    return docs.select("pid", checked.alias("c")).select("pid", "c.status", "c.output")


_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="doc"><xs:complexType><xs:sequence>
<xs:element name="title" type="xs:string"/><xs:element name="size" type="xs:nonNegativeInteger"/>
<xs:element name="lang"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="en"/><xs:enumeration value="de"/><xs:enumeration value="es"/>
</xs:restriction></xs:simpleType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query(
    "schema_valid_xsd",
    """SELECT doc_id AS pid, CASE WHEN lang = 'fr' OR source = 'src2' THEN 'FAILURE' ELSE 'SUCCESS' END AS status FROM documents""",
)
def schema_valid_xsd(t):
    """Validity against an XSD that is sent to every task: a value outside of an enumeration, a negative size."""
    import os
    import tempfile

    # Only the driver reads this file; executors get it as one of the job's files.
    folder = tempfile.mkdtemp(prefix="qualityspark-xsd-")
    path = os.path.join(folder, f"{os.path.basename(folder)}.xsd")
    with open(path, "w") as file:
        file.write(_XSD)
    t.spark.sparkContext.addFile(path)
    size = F.when(F.col("source") == "src2", -F.col("n_chars") - 1).otherwise(F.col("n_chars"))
    body = F.to_xml(F.struct(F.col("text").alias("title"), size.alias("size"), F.col("lang").alias("lang")), {"rowTag": "doc"})
    docs = t("documents").select(F.col("doc_id").alias("pid"), body.alias("body"))
    checked = X.schema_check(F.col("body"), "title string, size bigint, lang string, _corrupt string", os.path.basename(path))
    return docs.select("pid", checked.alias("c")).select("pid", "c.status")


@query(
    "xml_to_json",
    f"SELECT doc_id AS pid, md5(text) AS body, n_chars, len({_LINES}) AS n_lines, lang, source AS other FROM documents",
)
def xml_to_json(t):
    """Whole documents, whatever their elements: attributes, repeated elements and those no schema names."""
    lines = F.split("text", "\n")
    body = F.to_xml(
        F.struct(
            F.col("lang").alias("_lang"),
            F.struct(F.col("text").alias("title"), F.col("n_chars").alias("size")).alias("head"),
            F.when(F.size(lines) > 1, lines).alias("line"),
            F.struct(F.col("source").alias("_VALUE"), F.lit("x").alias("_kind")).alias("other"),
        ),
        {"rowTag": "doc"},
    )
    at = lambda path: F.get_json_object("j", "$.doc." + path)
    return t("documents").select(F.col("doc_id").alias("pid"), W.xml_to_json(body).alias("j")).select(
        "pid",
        F.md5(F.coalesce(at("head.title"), F.lit(""))).alias("body"),
        at("head.size").cast("bigint").alias("n_chars"),
        F.coalesce(F.json_array_length(at("line")), F.lit(1)).cast("bigint").alias("n_lines"),
        at("_lang").alias("lang"),
        at("other._VALUE").alias("other"),
    )


@query(
    "sysmeta_scan",
    """SELECT CAST(o_orderkey AS STRING) AS identifier, concat('eml-', o_orderstatus) AS format_id, o_custkey AS size,
        concat('uid=', o_custkey) AS rights_holder, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey - 1 AS STRING) END AS obsoletes,
        CAST(o_orderdate AS TIMESTAMP) AS date_uploaded, concat('public,uid=', o_custkey) AS readers, 'MD5' AS algorithm,
        o_orderkey AS pid, NULL AS error FROM orders WHERE o_orderpriority <> '5-LOW'
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderkey, 'system metadata cannot be read' FROM orders WHERE o_orderpriority = '5-LOW'""",
)
def sysmeta_scan(t):
    """System metadata documents with a prefixed root and a nested access policy; unreadable ones keep a row."""
    uid = F.concat(F.lit("uid="), F.col("o_custkey").cast("string"))
    allow = lambda who, *what: F.struct(F.array(who).alias("subject"), F.array(*[F.lit(w) for w in what]).alias("permission"))
    body = F.to_xml(
        F.struct(
            F.col("o_orderkey").alias("identifier"),
            F.concat(F.lit("eml-"), F.col("o_orderstatus")).alias("formatId"),
            F.col("o_custkey").alias("size"),
            F.struct(F.lit("abc").alias("_VALUE"), F.lit("MD5").alias("_algorithm")).alias("checksum"),
            uid.alias("rightsHolder"),
            F.struct(F.array(allow(F.lit("public"), "read"), allow(F.lit("admins"), "write"), allow(uid, "read", "write")).alias("allow")).alias("accessPolicy"),
            F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") - 1).alias("obsoletes"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'").alias("dateUploaded"),
        ),
        {"rowTag": "systemMetadata"},
    )
    prefixed = F.concat(
        F.lit('<v2:systemMetadata xmlns:v2="urn:v2">'),
        F.regexp_replace(F.regexp_replace(body, "^<systemMetadata>", ""), "</systemMetadata>$", "</v2:systemMetadata>"),
    )
    cut_short = F.when(F.col("o_orderpriority") == "5-LOW", F.substr(prefixed, F.lit(1), F.length(prefixed) - 9)).otherwise(prefixed)
    meta = system_metadata(t("orders").select(F.col("o_orderkey").alias("pid"), cut_short.alias("body")), keep=["pid"])
    return meta.select(
        "pid", "error",
        "identifier", "format_id", "size", "rights_holder", "obsoletes", "date_uploaded",
        F.array_join(readers(F.col("access")), ",").alias("readers"), F.col("checksum.algorithm").alias("algorithm"),
    )


@query(
    "definition_scan",
    """SELECT id, arg_max(p_name, p_partkey) AS name, arg_max(CASE WHEN p_size % 2 = 0 THEN 'REQUIRED' ELSE 'OPTIONAL' END, p_partkey) AS level,
        CAST(2 AS BIGINT) AS n_selectors, '/a/b' AS xpath, 'json-path' AS syntax
        FROM (SELECT *, concat(p_brand, '.', p_type) AS id FROM part) WHERE p_size <> 13 GROUP BY id""",
)
def definition_scan(t):
    """Check definitions of older versions: normalised, read, bad ones dropped, last of an id kept."""
    old = F.when(F.col("p_size") > 25, "urn:checks/v1").otherwise("urn:checks/v1.1")
    selector = lambda *fields: F.struct(F.lit("s").alias("name"), *fields)
    none = F.lit(None).cast("string")
    xml = F.to_xml(
        F.struct(
            F.concat_ws(".", "p_brand", "p_type").alias("id"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_size") % 2 == 0, "REQUIRED").otherwise("OPTIONAL").alias("level"),
            F.array(
                selector(F.lit("/a/b").alias("xpath"), F.struct(none.alias("_VALUE"), none.alias("_syntax")).alias("expression")),
                selector(none.alias("xpath"), F.struct(F.lit(".b").alias("_VALUE"), F.lit("json-path").alias("_syntax")).alias("expression")),
            ).alias("selector"),
        ),
        {"rowTag": "check"},
    )
    xml = F.concat(
        F.lit('<m:check xmlns:m="'),
        old,
        F.lit('">'),
        F.regexp_replace(F.regexp_replace(xml, "^<check>", ""), "</check>$", "</m:check>"),
    )
    broken = F.when(F.col("p_size") == 13, F.substr(xml, F.lit(1), F.length(xml) - 6)).otherwise(xml)
    texts = t("part").select(F.lpad("p_partkey", 12, "0").alias("path"), D.normalize_version(broken, "urn:checks").alias("value"))
    texts = texts.filter(F.col("value").contains('"urn:checks/v1.2"'))
    read = D.definitions(texts, schemas.CHECK_XML)
    return read.select(
        "id", "name", "level",
        F.size("selector").cast("bigint").alias("n_selectors"),
        F.col("selector")[0]["xpath"][0].alias("xpath"),
        F.col("selector")[1]["expression"][0]["_syntax"].alias("syntax"),
    )


@query(
    "suite_scan",
    """SELECT concat('suite-', p_brand) AS suite_id, CAST(0 AS INT) AS position, concat('check.', max(p_partkey)) AS check_id,
        'Findable' AS type_override, CAST(NULL AS STRING) AS level_override FROM part GROUP BY p_brand""",
)
def suite_scan(t):
    """Suite definitions and their references; of one suite id the last text wins."""
    xml = F.to_xml(
        F.struct(
            F.concat(F.lit("suite-"), F.col("p_brand")).alias("id"),
            F.col("p_brand").alias("name"),
            F.array(F.struct(F.concat(F.lit("check."), F.col("p_partkey").cast("string")).alias("id"), F.lit("Findable").alias("type"))).alias("check"),
        ),
        {"rowTag": "suite"},
    )
    texts = t("part").select(F.lpad("p_partkey", 12, "0").alias("path"), xml.alias("value"))
    return D.suite_references(D.definitions(texts, schemas.SUITE_XML))
