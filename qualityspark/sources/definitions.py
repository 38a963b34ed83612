"""Definition scans: checks, suites, and the tables that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark import schemas
from qualityspark.functions.extract import Selector, SubSelector
from qualityspark.operators.checks import Check, CheckRef, Dialect, Suite

_XML = {"columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}


def normalize_version(xml: Column, base: str) -> Column:
    """Definition texts of versions 1 and 1.1 as version 1.2.

    ``base`` is the schema address up to the version. Only whole version
    numbers are replaced, so a text of version 1.2 stays as it is.
    """
    literal = "\\Q" + base.rstrip("/") + "\\E"
    return F.regexp_replace(xml, rf"({literal}/v1)(\.1)?(?=[\"'\s])", "$1.2")


def _texts(spark: SparkSession, paths: list[str], base: str | None, glob: str = "*.xml") -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths, wholetext=True)
    out = files.select("value", F.col("_metadata.file_path").alias("path"))
    return out.withColumn("value", normalize_version(F.col("value"), base)) if base else out


def definitions(texts: DataFrame, schema: str) -> DataFrame:
    """Readable definitions of ``texts(path, value)``; of one id the last in path order wins."""
    # A generator, so that the filter is not pushed below it, where every condition would read the text again.
    read = texts.select("path", F.explode_outer(F.array(F.from_xml("value", schema, _XML))).alias("d")).filter(
        "d IS NOT NULL AND d._corrupt IS NULL AND d.id IS NOT NULL"
    )
    return read.groupBy("d.id").agg(F.max_by("d", "path").alias("d")).select("d.*").drop("_corrupt")


def corrupt_definitions(spark: SparkSession, paths: list[str], base: str | None = None) -> DataFrame:
    """Files that hold no readable check."""
    texts = _texts(spark, paths, base)
    return texts.select("path", F.from_xml("value", schemas.CHECK_XML, _XML).alias("d")).filter(
        "d IS NULL OR d._corrupt IS NOT NULL"
    ).select("path")


def read_checks(spark: SparkSession, paths: list[str], base: str | None = None, glob: str = "*.xml") -> DataFrame:
    return definitions(_texts(spark, paths, base, glob), schemas.CHECK_XML)


def read_suites(spark: SparkSession, paths: list[str], base: str | None = None, glob: str = "*.xml") -> DataFrame:
    return definitions(_texts(spark, paths, base, glob), schemas.SUITE_XML)


def suite_references(suites: DataFrame) -> DataFrame:
    """``suite_id, position, check_id, type_override, level_override``"""
    return suites.select(F.col("id").alias("suite_id"), F.posexplode("check").alias("position", "c")).select(
        "suite_id",
        "position",
        F.col("c.id").alias("check_id"),
        F.col("c.type").alias("type_override"),
        F.col("c.level").alias("level_override"),
    )


def suite_objects(suites: DataFrame) -> list[Suite]:
    """Suites as plan-time objects. Definitions are configuration: filter to the suites a run needs."""
    out = []
    for row in suites.select("id", "name", "namespaces", "check").collect():
        spaces = row["namespaces"]["namespace"] if row["namespaces"] else None
        out.append(
            Suite(
                row["id"],
                tuple(CheckRef(c["id"], c["type"], c["level"]) for c in row["check"] or []),
                row["name"],
                {n["_prefix"]: n["_VALUE"] for n in spaces or []},
            )
        )
    return out


def _by_syntax(expressions, syntax: str) -> str | None:
    for e in expressions or []:
        if (e["_syntax"] or "xpath") == syntax:
            return e["_VALUE"]
    return None


def check_objects(checks: DataFrame, code: dict) -> list[Check]:
    """Checks as plan-time objects, each with the registered function of its id.

    Code texts of definition files are not run; a check without a registered
    function is left out, so that suites report it as SKIP.
    """
    out = []
    columns = ["id", "name", "type", "level", "description", "environment", "inheritState", "selector", "dialect"]
    # Code texts stay where they are; only checks with a function come to the driver.
    for row in checks.filter(F.col("id").isin(list(code))).select(*columns).collect():
        merged: dict[str, dict] = {}
        for s in row["selector"] or []:
            spaces = s["namespaces"]["namespace"] if s["namespaces"] else None
            sub = s["subSelector"]
            entry = merged.setdefault(s["name"], {"namespaces": {}, "aware": False, "xpath": None, "json": None, "sub": None})
            path = (s["xpath"] or [None])[0] or _by_syntax(s["expression"], "xpath")
            entry["xpath"] = entry["xpath"] or (path.strip() if path else None)
            entry["json"] = entry["json"] or _by_syntax(s["expression"], "json-path")
            # The flag belongs to the XML reading of a selector.
            entry["aware"] = entry["aware"] or bool(s["_namespaceAware"] and path)
            entry["namespaces"].update({n["_prefix"]: n["_VALUE"] for n in spaces or []})
            if sub:
                entry["sub"] = SubSelector(sub["name"], (sub["xpath"] or [None])[0] or _by_syntax(sub["expression"], "xpath"))
        selectors = tuple(
            Selector(name, e["xpath"], e["json"], e["aware"], e["namespaces"], e["sub"]) for name, e in merged.items()
        )
        dialects = None
        if row["dialect"]:
            dialects = tuple(
                Dialect(
                    d["name"],
                    d["xpath"] or _by_syntax(d["expression"], "xpath"),
                    _by_syntax(d["expression"], "json-path"),
                )
                for d in row["dialect"]
            )
        out.append(
            Check(
                row["id"], code[row["id"]], row["name"], row["type"], row["level"], row["description"],
                row["environment"] or "spark", bool(row["inheritState"]), selectors, dialects,
            )
        )
    return out


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task table: CSV with a header, quotes, and ``#`` comment lines."""
    schema = "task_type string, task_name string, task_group string, cron_schedule string, params string"
    return spark.read.schema(schema).option("header", "true").option("comment", "#").option("enforceSchema", "true").csv(path)


def read_media_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, extension string").option("header", "true").csv(path)


def read_formats(spark: SparkSession, path: str) -> DataFrame:
    schema = "format_name string, format_id string, media_type string, extension string, proprietary string"
    rows = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .csv(path)
    )
    return rows.withColumn("proprietary", F.upper("proprietary") == "Y")


def read_score_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.SCORE_CSV)
        .option("header", "true")
        .option("escape", '"')
        .option("multiLine", "true")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        .csv(path)
    )


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results with the rank of their level, status and type, for ordered output."""
    from qualityspark.functions import scalars as S

    schema = "pid string, datasource string, check_id string, type string, level string, status string"
    rows = spark.read.schema(schema).option("header", "true").option("escape", '"').csv(path)
    return rows.withColumns(
        {
            "type_rank": S.rank_in(F.col("type"), S.PLOT_TYPES),
            "level_rank": S.rank_in(F.col("level"), S.PLOT_LEVELS),
            "status_rank": S.rank_in(F.col("status"), S.STATUSES),
        }
    )
