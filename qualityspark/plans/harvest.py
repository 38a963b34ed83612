"""Selection of documents to assess."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.operators import harvest as O
from qualityspark.plans import query
from qualityspark.plans.views import nodes, repositories, runs, sysmeta, with_views
from qualityspark.session import scratch_path
from qualityspark.sources import definitions as D

_NOW = "TIMESTAMP '1999-06-01 00:00:00'"
_START = "TIMESTAMP '1995-01-01 00:00:00'"
_PATTERNS = "eml-2.[12]|.*3$|xml"

# Marks: the last order date of each node's automobile customers, some in the future.
_MARKS = f""", marks AS (SELECT node_id, max(modified) AS last_harvest_datetime FROM sysmeta_v JOIN customer ON rights_holder = c_custkey
        WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal < -900 GROUP BY node_id),
    spans AS (SELECT node_id, CASE WHEN least(coalesce(last_harvest_datetime, {_START}), {_NOW}) = {_NOW} THEN {_NOW} - INTERVAL 1 MINUTE
        ELSE coalesce(last_harvest_datetime, {_START}) END AS since, {_NOW} AS until
        FROM nodes_v LEFT JOIN marks USING (node_id) WHERE type <> 'CN' AND synchronize AND state = 'UP'),
    formats AS (SELECT DISTINCT format_id FROM sysmeta_v WHERE regexp_full_match(format_id, 'eml-2.[12]') OR regexp_full_match(format_id, '.*3$')
        OR regexp_full_match(format_id, 'xml')),
    listed AS (SELECT s.* , since, until FROM sysmeta_v s JOIN spans USING (node_id) WHERE format_id IN (SELECT format_id FROM formats)
        AND modified >= since AND modified <= until),
    chosen AS (SELECT * FROM listed WHERE pid NOT IN (SELECT metadata_id FROM runs_v WHERE suite_id = 'suite-1' AND status = 'success')) """
_SQL = with_views("sysmeta_v", "nodes_v", "runs_v").rstrip() + _MARKS


def _spans(t):
    owners = t("customer").filter("c_mktsegment = 'AUTOMOBILE' AND c_acctbal < -900").selectExpr("c_custkey AS rights_holder")
    marks = sysmeta(t).join(owners, "rights_holder").groupBy("node_id").agg(F.max("modified").alias("last_harvest_datetime"))
    return O.windows(O.harvest_nodes(nodes(t)).select("node_id"), marks, F.expr(_START), F.expr(_NOW))


def _listed(t, spans):
    formats = t("orders").selectExpr("concat('eml-2.', substring(o_orderpriority, 1, 1)) AS format_id").distinct()
    return O.listed(sysmeta(t), spans, formats, _PATTERNS)


def _chosen(t, listed):
    return O.candidates(listed, runs(t), "suite-1")


@query(
    "node_filter",
    with_views("repositories_v") + "SELECT identifier, state FROM repositories_v WHERE type <> 'CN' AND synchronize AND state = 'UP'",
)
def node_filter(t):
    return O.harvest_nodes(repositories(t)).select("identifier", "state")


@query("member_nodes", with_views("repositories_v") + "SELECT identifier, state FROM repositories_v WHERE synchronize AND type = 'MN'")
def member_nodes(t):
    return O.member_nodes(repositories(t)).select("identifier", "state")


@query(
    "node_names",
    with_views("repositories_v")
    + """SELECT identifier, replace(identifier, 'urn:node:', '') AS short,
        regexp_matches(identifier, '^\\s*urn:node:(CN|cn).*$') AS coordinating FROM repositories_v""",
)
def node_names(t):
    return repositories(t).select(
        "identifier",
        S.strip_node_prefix(F.col("identifier")).alias("short"),
        O.is_coordinating(F.col("identifier")).alias("coordinating"),
    )


@query("harvest_windows", _SQL + "SELECT node_id, since, until FROM spans")
def harvest_windows(t):
    return _spans(t)


@query("harvest_listing", _SQL + "SELECT pid, node_id, format_id, modified FROM listed")
def harvest_listing(t):
    return _listed(t, _spans(t)).select("pid", "node_id", "format_id", "modified")


@query("harvest_candidates", _SQL + "SELECT pid, node_id, modified FROM chosen")
def harvest_candidates(t):
    return _chosen(t, _listed(t, _spans(t))).select("pid", "node_id", "modified")


@query(
    "harvest_marks",
    _SQL
    + """SELECT node_id, count(*) AS n_pids, CASE WHEN max(modified) > any_value(since) THEN max(modified) + INTERVAL 2 MILLISECOND
        ELSE any_value(since) + INTERVAL 1 MILLISECOND END AS last_harvest_datetime FROM chosen GROUP BY node_id""",
)
def harvest_marks(t):
    spans = _spans(t)
    return O.next_marks(_chosen(t, _listed(t, spans)), spans)


@query(
    "harvest_counts",
    _SQL
    + """SELECT node_id, total, coalesce(filtered, 0) AS filtered FROM (SELECT node_id, count(*) AS total FROM listed GROUP BY node_id)
        LEFT JOIN (SELECT node_id, count(*) AS filtered FROM chosen GROUP BY node_id) USING (node_id)""",
)
def harvest_counts(t):
    listed = _listed(t, _spans(t))
    return O.pid_counts(listed, _chosen(t, listed))


@query(
    "format_filter",
    """SELECT DISTINCT p_type, p_brand, regexp_full_match(p_type, 'ECO.*') OR regexp_full_match(p_type, 'STANDARD') AS fits FROM part""",
)
def format_filter(t):
    return t("part").select("p_type", "p_brand", O.format_matches(F.col("p_type"), "ECO.*|STANDARD").alias("fits")).distinct()


@query(
    "rewound_harvest",
    with_views("sysmeta_v") + f"SELECT pid, node_id FROM sysmeta_v WHERE modified >= TIMESTAMP '1997-01-01' AND modified <= {_NOW}",
)
def rewound_harvest(t):
    """A mark set back by hand: everything since is listed again."""
    from qualityspark.sources.tables import objects_between

    return objects_between(sysmeta(t), F.expr("TIMESTAMP '1997-01-01'"), F.expr(_NOW)).select("pid", "node_id")


@query(
    "harvest_tasks",
    with_views("sysmeta_v", "nodes_v", "runs_v").rstrip()
    + f""", tasks AS (SELECT concat('quality-', n_name) AS task_name, concat('suite-', n_nationkey % 3) AS suite_id, concat('urn:node:', n_name) AS node_id
        FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'quality-CN', 'suite-2', NULL)
    SELECT task_name, t.suite_id, s.node_id, pid FROM sysmeta_v s JOIN nodes_v n ON n.node_id = s.node_id AND type <> 'CN' AND synchronize AND state = 'UP'
        JOIN tasks t ON t.node_id IS NULL OR t.node_id = s.node_id
        WHERE modified >= CASE WHEN n.nationkey % 2 = 0 AND t.node_id IS NULL THEN TIMESTAMP '1997-03-01' ELSE TIMESTAMP '1996-01-01' END AND modified <= {_NOW} AND (regexp_full_match(format_id, 'eml-2.[12]') OR format_id = 'eml-2.5')
        AND NOT EXISTS (SELECT 1 FROM runs_v r WHERE r.metadata_id = pid AND r.suite_id = t.suite_id AND status = 'success')""",
)
def harvest_tasks(t):
    """Task table written as CSV, read back, and run for all tasks at once."""
    params = lambda suite, node: F.concat_ws(";", F.lit("eml-2.[12]|eml-2.5"), suite, node, F.lit("1996-01-01T00:00:00Z"), F.lit("1"), F.lit("1000"))
    row = lambda name, p: [F.lit("quality").alias("task-type"), name.alias("task-name"), F.lit("group").alias("task-group"), F.lit("0 0/1 * * * ?").alias("cron-schedule"), p.alias("params")]
    suite = F.concat(F.lit("suite-"), (F.col("n_nationkey") % 3).cast("string"))
    rows = t("nation").filter("n_regionkey = 1").select(
        *row(F.concat(F.lit("quality-"), F.col("n_name")), params(suite, F.concat(F.lit("urn:node:"), F.col("n_name"))))
    )
    rows = rows.unionByName(
        t("region").filter("r_regionkey = 0").select(*row(F.lit("quality-CN"), params(F.lit("suite-2"), F.lit("urn:node:CN"))))
    )
    path = scratch_path(t.spark, "tasks")
    rows.write.option("header", "true").csv(path)
    tasks = O.task_params(D.read_tasks(t.spark, path))
    marks = nodes(t).filter("nationkey % 2 = 0").selectExpr("'quality-CN' AS task_name", "node_id", "TIMESTAMP '1997-03-01' AS last_harvest_datetime")
    found = O.harvest_tasks(tasks, nodes(t), marks, sysmeta(t), runs(t), F.expr(_NOW))
    return found.select("task_name", "suite_id", "node_id", "pid")
