"""Incremental selection of documents to assess."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.operators.runs import existing_success
from qualityspark.session import cut_lineage

# Ids of coordinating nodes, and the start of their service URLs.
COORDINATING = r"^\s*urn:node:(CN|cn).*$"
SERVICE_URL = r"^\s*https*://cn.*?\."


def format_matches(format_id: Column, patterns: Column | str) -> Column:
    """Whole-text match against any of the patterns, which the pipe sign divides."""
    if isinstance(patterns, str):
        return format_id.rlike("|".join(f"^(?:{p})$" for p in patterns.split("|") if p))
    each = F.filter(F.split(patterns, r"\|"), lambda p: p != "")
    return F.exists(each, lambda p: F.regexp_like(format_id, F.concat(F.lit("^(?:"), p, F.lit(")$"))))


def coordinating_pattern(domain: str | None = None) -> str:
    """Pattern of coordinating node ids, and of service URLs under ``domain``."""
    if domain is None:
        return COORDINATING
    return f"{COORDINATING}|{SERVICE_URL}{re.escape(domain)}.*$"


def is_coordinating(node: Column, domain: str | None = None) -> Column:
    return node.rlike(coordinating_pattern(domain))


def harvest_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes harvested from a coordinating source: members, synchronised and up."""
    return nodes.filter((F.upper("type") != "CN") & F.col("synchronize") & (F.upper("state") == "UP"))


def member_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("synchronize") & (F.upper("type") == "MN"))


def windows(nodes: DataFrame, marks: DataFrame, start: Column, now: Column) -> DataFrame:
    """Harvest window per node: from the last mark, or the configured start, to now.

    A mark in the future counts as now; an empty window is opened by a minute.
    """
    stored = marks.select("node_id", "last_harvest_datetime")
    since = F.least(F.coalesce("last_harvest_datetime", start), now)
    return (
        nodes.join(stored, "node_id", "left")
        .withColumn("_since", since)
        .select(
            "node_id",
            F.when(F.col("_since") == now, F.col("_since") - F.expr("INTERVAL 1 MINUTE"))
            .otherwise(F.col("_since"))
            .alias("since"),
            now.alias("until"),
        )
    )


def listed(sysmeta: DataFrame, spans: DataFrame, formats: DataFrame, patterns: str) -> DataFrame:
    """Objects of a wanted format, modified inside their node's window.

    ``spans`` has one row per node and ``formats`` one per format id. Both are
    written first: with their sizes known, Spark broadcasts them if they are
    small, and objects of a node with very many are not gathered by node.
    """
    wanted = formats.filter(format_matches(F.col("format_id"), patterns)).select("format_id").distinct()
    return (
        sysmeta.join(cut_lineage(wanted), "format_id", "left_semi")
        .join(cut_lineage(spans), "node_id")
        .filter((F.col("modified") >= F.col("since")) & (F.col("modified") <= F.col("until")))
    )


def candidates(objects: DataFrame, runs: DataFrame, suite_id: str) -> DataFrame:
    """Listed objects without a successful run of the suite."""
    ok = existing_success(runs.filter(F.col("suite_id") == suite_id)).select(F.col("metadata_id").alias("pid"))
    return objects.join(ok, "pid", "left_anti")


def next_marks(selected: DataFrame, spans: DataFrame) -> DataFrame:
    """New mark per node: 2 ms after the last modification that lies after the
    window start, 1 ms after the start if none does; no row for a node without
    objects, whose mark stays."""
    newest = selected.groupBy("node_id").agg(F.max("modified").alias("_newest"), F.count(F.lit(1)).alias("n_pids"))
    ms = lambda n: F.expr(f"INTERVAL {n} MILLISECOND")
    mark = F.when(F.col("_newest") > F.col("since"), F.col("_newest") + ms(2)).otherwise(F.col("since") + ms(1))
    return newest.join(spans, "node_id").select("node_id", "n_pids", mark.alias("last_harvest_datetime"))


def pid_counts(objects: DataFrame, selected: DataFrame) -> DataFrame:
    """Objects listed and objects left to process, per node."""
    flagged = objects.select("node_id", F.lit(0).alias("_s")).unionByName(selected.select("node_id", F.lit(1).alias("_s")))
    return flagged.groupBy("node_id").agg(
        F.count_if(F.col("_s") == 0).alias("total"), F.count_if(F.col("_s") == 1).alias("filtered")
    )


def collection_listing(collections: DataFrame, patterns: str, since: Column, until: Column) -> DataFrame:
    """Newest collection documents of a format, changed within a date range."""
    return collections.filter(
        format_matches(F.col("format_id"), patterns)
        & F.col("obsoleted_by").isNull()
        & F.col("modified").between(since, until)
    )


def task_params(tasks: DataFrame) -> DataFrame:
    """Task rows with their ``;``-divided parameters as columns, by task type."""
    part = lambda i: F.trim(F.get(F.split("params", ";"), F.lit(i)))
    kind = F.trim("task_type")
    harvest = kind.isin("quality", "score")
    return tasks.select(
        kind.alias("task_type"),
        F.trim("task_name").alias("task_name"),
        F.trim("task_group").alias("task_group"),
        F.trim("cron_schedule").alias("cron_schedule"),
        F.when(harvest, part(0)).alias("format_filter"),
        F.when(harvest, part(1)).alias("suite_id"),
        F.when(harvest, part(2)).when(kind == "nodelist", part(0)).alias("node_id"),
        F.when(harvest, part(3)).alias("start_datetime"),
        F.when(harvest, part(4).try_cast("int")).alias("increment_days"),
        F.when(harvest, part(5).try_cast("int")).alias("count_requested"),
        F.when(kind == "score", part(6)).alias("request_type"),
        F.when(kind == "filestore", part(0)).alias("dir_include"),
        F.when(kind == "filestore", part(1)).alias("dir_exclude"),
        F.when(kind == "filestore", part(2)).alias("file_include"),
        F.when(kind == "filestore", part(3)).alias("file_exclude"),
    )


def harvest_tasks(
    tasks: DataFrame, nodes: DataFrame, marks: DataFrame, sysmeta: DataFrame, runs: DataFrame, now: Column
) -> DataFrame:
    """Documents every quality task still has to assess, for all tasks in one job.

    A task on a coordinating node covers all harvested member nodes.
    """
    # Every node is found under its own id and under one name for all nodes.
    everywhere = F.lit("*")
    scope = F.when(is_coordinating(F.col("node_id")), everywhere).otherwise(F.col("node_id"))
    wanted = tasks.filter("task_type = 'quality'").select(
        "task_name", "suite_id", "format_filter", "start_datetime", scope.alias("scope")
    )
    members = harvest_nodes(nodes).select("node_id", F.explode(F.array("node_id", everywhere)).alias("scope"))
    spans = wanted.join(members, "scope").join(
        marks.select("task_name", "node_id", "last_harvest_datetime"), ["task_name", "node_id"], "left"
    )
    since = F.least(F.coalesce("last_harvest_datetime", F.to_timestamp("start_datetime")), now)
    # The task table is configuration. Its patterns are matched once for each format, not for each document.
    filters = [r[0] for r in wanted.filter("format_filter IS NOT NULL").select("format_filter").distinct().collect()]
    fits = F.array(*[F.when(format_matches(F.col("format_id"), f), F.lit(f)) for f in filters]).cast("array<string>")
    formats = sysmeta.select("format_id").distinct().select("format_id", F.explode(fits).alias("format_filter"))
    formats = formats.filter("format_filter IS NOT NULL")
    ok = existing_success(runs).select(F.col("metadata_id").alias("pid"), "suite_id")
    return (
        sysmeta.join(cut_lineage(spans), "node_id")
        .filter((F.col("modified") >= since) & (F.col("modified") <= now))
        .join(cut_lineage(formats), ["format_id", "format_filter"], "left_semi")
        .select("task_name", "suite_id", "node_id", "pid", "modified")
        .join(ok, ["pid", "suite_id"], "left_anti")
    )
