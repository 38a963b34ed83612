"""Stored runs and definitions: merges, lookups, states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.operators import merge as M
from qualityspark.operators import runs as O
from qualityspark.operators.scores import score_runs
from qualityspark.operators.suite import resolve_references
from qualityspark.plans import ORACLES, query
from qualityspark.plans.views import REQUESTS, requests, results, runs, with_views
from qualityspark.session import cut_lineage, scratch_path
from qualityspark.sinks import writers as W
from qualityspark.sources.tables import score_scan

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_COLUMNS = ["metadata_id", "suite_id", "ts", "status", "error", "sequence_id", "is_latest", "run_count"]

# Stored runs are the finished ones; the saved ones are all but the least urgent.
_STORED = "status <> 'processing'"
_SAVED = "o_orderpriority <> '5-LOW'"
_SAVED_CTE = f""", stored AS (SELECT {', '.join(_COLUMNS)} FROM runs_v WHERE {_STORED}),
    saved AS (SELECT o_orderkey AS metadata_id, concat('suite-', CAST(o_orderkey % 3 AS STRING)) AS suite_id,
        CAST(o_orderdate AS TIMESTAMP) AS ts, lower(o_orderpriority) AS status, CAST(NULL AS STRING) AS error, o_custkey AS sequence_id,
        FALSE AS is_latest, CAST(floor(o_totalprice / 20000) AS INT) AS run_count FROM orders WHERE {_SAVED}) """


def _saved(t):
    return t("orders").filter(_SAVED).selectExpr(
        "o_orderkey AS metadata_id",
        "concat('suite-', CAST(o_orderkey % 3 AS STRING)) AS suite_id",
        "CAST(o_orderdate AS TIMESTAMP) AS ts",
        "lower(o_orderpriority) AS status",
        "CAST(NULL AS STRING) AS error",
        "o_custkey AS sequence_id",
        "FALSE AS is_latest",
        "CAST(floor(o_totalprice / 20000) AS INT) AS run_count",
    )


def _stored(t):
    return runs(t).filter(_STORED).select(*_COLUMNS)


@query(
    "merge_runs",
    with_views("runs_v").rstrip()
    + _SAVED_CTE
    + f"""SELECT coalesce(n.metadata_id, s.metadata_id) AS metadata_id, coalesce(n.suite_id, s.suite_id) AS suite_id,
        CASE WHEN n.metadata_id IS NULL THEN s.ts ELSE {_NOW} END AS ts, coalesce(n.status, s.status) AS status,
        CAST(CASE WHEN n.metadata_id IS NULL THEN s.run_count WHEN s.metadata_id IS NULL THEN 1 ELSE n.run_count END AS INT) AS run_count
        FROM stored s FULL JOIN saved n ON s.metadata_id = n.metadata_id AND s.suite_id = n.suite_id""",
)
def merge_runs(t):
    merged = M.merge_runs(_stored(t), _saved(t), F.expr(_NOW))
    return merged.select("metadata_id", "suite_id", "ts", "status", "run_count")


@query("merge_runs_bucketed", ORACLES["merge_runs"])
def merge_runs_bucketed(t):
    """Stored runs kept in buckets of their keys: a merge moves the changes only, and leaves the layout as it was."""
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    kept = W.BucketedTable(t.spark, f"runs_{uuid.uuid4().hex}", scratch_path(t.spark, "runs"), ("metadata_id", "suite_id"), buckets)
    kept.create(_stored(t))
    kept.merge(lambda stored: M.merge_runs(stored, _saved(t), F.expr(_NOW)))
    merged = cut_lineage(kept.read().select("metadata_id", "suite_id", "ts", "status", "run_count"))
    kept.drop()
    return merged


@query(
    "merge_insert_absent",
    with_views("runs_v").rstrip()
    + _SAVED_CTE
    + """SELECT metadata_id, suite_id, status FROM stored UNION ALL SELECT metadata_id, suite_id, status FROM saved
        WHERE metadata_id NOT IN (SELECT metadata_id FROM stored)""",
)
def merge_insert_absent(t):
    return M.insert_absent(_stored(t), _saved(t), ["metadata_id", "suite_id"], ["ts"]).select("metadata_id", "suite_id", "status")


@query(
    "merge_identifiers",
    with_views("requests_v")
    + """SELECT pid AS metadata_id, arg_max(status, (ts, event_id)) AS data_source FROM requests_v GROUP BY pid
        UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT pid FROM requests_v)""",
)
def merge_identifiers(t):
    """Last writer wins, however often a key was written."""
    table = t("customer").selectExpr(
        "c_custkey AS metadata_id", "c_mktsegment AS data_source", "TIMESTAMP '2000-01-01' AS ts", "CAST(-1 AS BIGINT) AS event_id"
    )
    saved = requests(t).selectExpr("pid AS metadata_id", "status AS data_source", "ts", "event_id")
    return M.upsert(table, saved, ["metadata_id"], ["ts", "event_id"]).select("metadata_id", "data_source")


@query(
    "merge_nodes",
    """SELECT concat('urn:node:', s_name) AS identifier, CASE WHEN s_acctbal < 3000 THEN 'DOWN' ELSE 'UP' END AS state FROM supplier
       UNION ALL SELECT concat('urn:node:', c_name), 'UP' FROM customer WHERE c_acctbal < 3000""",
)
def merge_nodes(t):
    """Harvested nodes replace stored ones; customers stand for nodes that are new."""
    name = "concat('urn:node:', {}) AS identifier"
    table = t("supplier").selectExpr(name.format("s_name"), "'UP' AS state", "0 AS last_harvest")
    saved = t("supplier").filter("s_acctbal < 3000").selectExpr(name.format("s_name"), "'DOWN' AS state", "1 AS last_harvest")
    new = t("customer").filter("c_acctbal < 3000").selectExpr(name.format("c_name"), "'UP' AS state", "1 AS last_harvest")
    return M.merge_nodes(table, saved.unionByName(new)).select("identifier", "state")


@query(
    "merge_marks",
    with_views("requests_v").rstrip()
    + """, stored AS (SELECT suite_id AS task_name, pid AS node_id, max(ts) AS mark FROM requests_v WHERE event_id % 2 = 0 GROUP BY suite_id, pid),
        saved AS (SELECT suite_id AS task_name, pid AS node_id, min(ts) AS mark FROM requests_v WHERE event_id % 3 = 0 GROUP BY suite_id, pid)
        SELECT coalesce(n.task_name, s.task_name) AS task_name, 'quality' AS task_type, coalesce(n.node_id, s.node_id) AS node_id,
            coalesce(n.mark, s.mark) AS last_harvest_datetime
        FROM stored s FULL JOIN saved n ON n.task_name = s.task_name AND n.node_id = s.node_id""",
)
def merge_marks(t):
    """Marks set replace stored ones, earlier ones too; the others stay."""
    keyed = lambda rows, mark: rows.groupBy("suite_id", "pid").agg(mark.alias("mark")).selectExpr(
        "suite_id AS task_name", "'quality' AS task_type", "pid AS node_id", "mark AS last_harvest_datetime"
    )
    stored = keyed(requests(t).filter("event_id % 2 = 0"), F.max("ts"))
    return M.merge_marks(stored, keyed(requests(t).filter("event_id % 3 = 0"), F.min("ts")))


@query(
    "merge_scores",
    with_views("results_v", "counts_v", "overall_v")
    + """SELECT run_id, coalesce(score_overall, -1.0) AS score_overall FROM (SELECT o_orderkey AS run_id FROM orders UNION SELECT run_id FROM overall_v)
        LEFT JOIN overall_v USING (run_id)""",
)
def merge_scores(t):
    """Score rows inserted or replaced by run id."""
    index = t("orders").selectExpr("o_orderkey AS run_id", "-1.0D AS score_overall", "TIMESTAMP '2000-01-01' AS ts")
    fresh = score_runs(results(t)).selectExpr("run_id", "score_overall", f"{_NOW} AS ts")
    return M.merge_scores(index, fresh).select("run_id", "score_overall")


_FILES = [
    "concat('f', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS file_id",
    "l_orderkey AS pid",
    "CASE WHEN l_returnflag = 'A' THEN 'data' ELSE 'graph' END AS storage_type",
    "CASE WHEN l_linestatus = 'F' THEN 'text/csv' ELSE 'image/png' END AS media_type",
    "'' AS alt_filename",
    "CAST(l_shipdate AS TIMESTAMP) AS creation_datetime",
]


@query(
    "merge_files",
    f"""WITH files AS (SELECT {', '.join(_FILES)} FROM lineitem), newest AS (
            SELECT pid, storage_type, media_type, arg_max(file_id, (creation_datetime, file_id)) AS file_id FROM files GROUP BY pid, storage_type, media_type),
        stored AS (SELECT o_orderkey AS pid, 'data' AS storage_type, 'text/csv' AS media_type, concat('old', CAST(o_orderkey AS STRING)) AS file_id FROM orders)
        SELECT coalesce(n.pid, s.pid) AS pid, coalesce(n.storage_type, s.storage_type) AS storage_type, coalesce(n.media_type, s.media_type) AS media_type,
            coalesce(n.file_id, s.file_id) AS file_id
        FROM stored s FULL JOIN newest n ON n.pid = s.pid AND n.storage_type = s.storage_type AND n.media_type = s.media_type""",
)
def merge_files(t):
    """Entries of new files replace stored ones of the same document, storage and type."""
    stored = t("orders").selectExpr(
        "concat('old', CAST(o_orderkey AS STRING)) AS file_id", "o_orderkey AS pid", "'data' AS storage_type", "'text/csv' AS media_type",
        "'' AS alt_filename", "TIMESTAMP '1990-01-01' AS creation_datetime",
    )
    return M.merge_files(stored, t("lineitem").selectExpr(*_FILES)).select("pid", "storage_type", "media_type", "file_id")


@query(
    "delete_files",
    f"SELECT file_id, pid FROM (SELECT {', '.join(_FILES)} FROM lineitem) WHERE pid NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)
def delete_files(t):
    files = t("lineitem").selectExpr(*_FILES)
    gone = t("orders").filter("o_orderstatus = 'P'").selectExpr("o_orderkey AS pid")
    return M.delete_keys(files, gone, ["pid"]).select("file_id", "pid")


_FIELDS = """, fields AS (SELECT metadata_id, suite_id, CASE WHEN sequence_id < 700 THEN sequence_id ELSE metadata_id END AS sequence_id,
    status <> 'failure' AS is_latest FROM runs_v WHERE status <> 'success') """


def _fields(t):
    return runs(t).filter("status <> 'success'").selectExpr(
        "metadata_id", "suite_id", "CASE WHEN sequence_id < 700 THEN sequence_id ELSE metadata_id END AS sequence_id",
        "status <> 'failure' AS is_latest",
    )


@query(
    "changed_rows",
    with_views("runs_v").rstrip()
    + _FIELDS
    + """SELECT r.metadata_id, f.sequence_id, f.is_latest, r.run_count FROM runs_v r JOIN fields f USING (metadata_id, suite_id)
        WHERE r.sequence_id <> f.sequence_id OR r.is_latest <> f.is_latest""",
)
def changed_rows(t):
    rows = M.changed_rows(runs(t).select(*_COLUMNS), _fields(t), ["metadata_id", "suite_id"], ["sequence_id", "is_latest"])
    return rows.select("metadata_id", "sequence_id", "is_latest", "run_count")


@query(
    "partial_update",
    with_views("runs_v").rstrip()
    + _FIELDS
    + """SELECT r.metadata_id, coalesce(f.sequence_id, r.sequence_id) AS sequence_id, coalesce(f.is_latest, r.is_latest) AS is_latest
        FROM runs_v r LEFT JOIN fields f USING (metadata_id, suite_id)""",
)
def partial_update(t):
    table = M.partial_update(runs(t).select(*_COLUMNS), _fields(t), ["metadata_id", "suite_id"], ["sequence_id", "is_latest"])
    return table.select("metadata_id", "sequence_id", "is_latest")


# Definitions ------------------------------------------------------------------

_CHECKS = [
    "p_partkey AS check_id",
    "p_type AS type",
    "CASE WHEN p_size % 2 = 0 THEN 'REQUIRED' ELSE 'OPTIONAL' END AS level",
]
_CHECK_WHERE = "p_size > 5"
_SUITES = [
    "concat('suite-', CAST(l_orderkey AS STRING)) AS suite_id",
    "l_linenumber AS position",
    "l_partkey AS check_id",
    "CASE WHEN l_returnflag = 'A' THEN 'Findable' END AS type_override",
    "CASE WHEN l_returnflag = 'R' THEN 'INFO' END AS level_override",
]


@query(
    "check_refs",
    f"""WITH checks AS (SELECT {', '.join(_CHECKS)} FROM part WHERE {_CHECK_WHERE}), suites AS (SELECT {', '.join(_SUITES)} FROM lineitem)
        SELECT suite_id, position, check_id, coalesce(type_override, type) AS type, coalesce(level_override, level) AS level,
        CASE WHEN level IS NULL THEN 'SKIP' END AS status,
        CASE WHEN level IS NULL THEN 'Could not locate referenced check in store: ' || check_id END AS output
        FROM suites LEFT JOIN checks USING (check_id)""",
)
def check_refs(t):
    checks = t("part").filter(_CHECK_WHERE).selectExpr(*_CHECKS)
    return resolve_references(t("lineitem").selectExpr(*_SUITES), checks)


@query(
    "definition_update",
    f"""SELECT check_id, type, level FROM (SELECT {', '.join(_CHECKS)} FROM part WHERE {_CHECK_WHERE})
        WHERE check_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)
        UNION ALL SELECT DISTINCT l_partkey, 'updated', 'INFO' FROM lineitem WHERE l_quantity = 50""",
)
def definition_update(t):
    """Checks created, updated and deleted by id."""
    checks = t("part").filter(_CHECK_WHERE).selectExpr(*_CHECKS)
    new = t("lineitem").filter("l_quantity = 50").selectExpr("l_partkey AS check_id", "'updated' AS type", "'INFO' AS level")
    gone = t("lineitem").filter("l_quantity = 49").selectExpr("l_partkey AS check_id")
    kept = M.delete_keys(checks, gone, ["check_id"])
    return M.upsert(kept, new, ["check_id"], ["level"])


# Runs -------------------------------------------------------------------------


@query(
    "stuck_runs",
    with_views("requests_v")
    + """SELECT r.pid AS metadata_id, event_id, c_mktsegment AS data_source FROM requests_v r JOIN customer ON c_custkey = r.pid
        WHERE status = 'processing' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 12 HOUR""",
)
def stuck_runs(t):
    table = requests(t).withColumnRenamed("pid", "metadata_id")
    names = t("customer").selectExpr("c_custkey AS metadata_id", "c_mktsegment AS data_source")
    stuck = O.in_process(table, names, F.expr("TIMESTAMP '2024-01-30 12:00:00'"), 12)
    return stuck.select("metadata_id", "event_id", "data_source")


@query(
    "run_limit",
    with_views("runs_v")
    + """SELECT metadata_id, CASE WHEN run_count > 10 THEN 'failure' ELSE status END AS status,
        CASE WHEN run_count > 10 THEN 'Run has been attempted 10 times, aborting.' END AS error FROM runs_v""",
)
def run_limit(t):
    return O.limit_runs(runs(t)).select("metadata_id", "status", "error")


@query(
    "attempt_no",
    with_views("requests_v")
    + "SELECT event_id, pid, suite_id, row_number() OVER (PARTITION BY pid, suite_id ORDER BY ts, event_id) AS attempt FROM requests_v",
)
def attempt_no(t):
    numbered = O.attempts(requests(t), ["pid", "suite_id"])
    return numbered.select("event_id", "pid", "suite_id", F.col("attempt").cast("bigint").alias("attempt"))


RUN_STATES = """SELECT pid, suite_id, run_count, events, CASE WHEN run_count > 10 THEN 'failure' ELSE last END AS status,
    CASE WHEN run_count > 10 THEN 'Run has been attempted 10 times, aborting.' END AS error, ts FROM (
    SELECT pid, suite_id, count(*) FILTER (WHERE status = 'processing') AS run_count, count(*) AS events,
        arg_max(status, (ts, event_id)) AS last, max(ts) AS ts FROM requests_v GROUP BY pid, suite_id)"""


@query("run_states", with_views("requests_v") + RUN_STATES)
def run_states(t):
    return O.run_states(requests(t), ["pid", "suite_id"])


@query("suite_last_run", with_views("runs_v") + "SELECT suite_id, max(ts) AS last_run FROM runs_v GROUP BY suite_id")
def suite_last_run(t):
    return O.suite_last_run(runs(t))


@query("top_recent", with_views("runs_v") + "SELECT metadata_id, ts FROM runs_v ORDER BY ts DESC, metadata_id DESC LIMIT 100")
def top_recent(t):
    return O.top_recent(runs(t), 100, "metadata_id").select("metadata_id", "ts")


@query("page", with_views("runs_v") + "SELECT metadata_id, suite_id, ts FROM runs_v ORDER BY ts, metadata_id LIMIT 100 OFFSET 1000")
def page(t):
    return O.page(runs(t).select("metadata_id", "suite_id", "ts"), ["ts", "metadata_id"], 1000, 100)


@query("first_row", with_views("runs_v") + "SELECT metadata_id, ts FROM runs_v ORDER BY ts DESC, metadata_id DESC LIMIT 1")
def first_row(t):
    return O.top_recent(runs(t), 1, "metadata_id").select("metadata_id", "ts")


@query(
    "run_lookup",
    with_views("runs_v") + "SELECT metadata_id, suite_id, status FROM runs_v WHERE metadata_id = 3001 AND suite_id = 'suite-1'",
)
def run_lookup(t):
    return O.find_run(runs(t), 3001, "suite-1").select("metadata_id", "suite_id", "status")


@query(
    "month_runs",
    with_views("runs_v")
    + "SELECT metadata_id, ts FROM runs_v WHERE date_trunc('month', ts) = date_trunc('month', TIMESTAMP '1996-02-17 10:30:00')",
)
def month_runs(t):
    """Runs of the calendar month around a date, whatever its time of day."""
    target = F.expr("TIMESTAMP '1996-02-17 10:30:00'")
    return runs(t).filter(S.in_month(F.col("ts"), target)).select("metadata_id", "ts")


@query("list_suites", with_views("runs_v") + "SELECT DISTINCT suite_id FROM runs_v")
def list_suites(t):
    return O.list_ids(runs(t), "suite_id")


@query("list_checks", "SELECT DISTINCT l_partkey AS check_id FROM lineitem")
def list_checks(t):
    return O.list_ids(t("lineitem").selectExpr(*_SUITES), "check_id")


@query(
    "score_scan",
    with_views("runs_v")
    + """SELECT metadata_id, suite_id FROM runs_v WHERE suite_id = 'suite-1' AND status = 'success'
        AND metadata_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def scores_by_predicate(t):
    """Score rows by suite, source and ids."""
    pids = t("events").filter("event_type = 'purchase'").selectExpr("user_id AS pid")
    table = runs(t).withColumnRenamed("status", "datasource")
    return score_scan(table, "suite-1", "success", pids=pids).select("metadata_id", "suite_id")


@query(
    "elapsed_totals",
    f"""WITH r AS (SELECT {', '.join(REQUESTS)} FROM events) SELECT suite_id, count(*) AS n, round(sum(elapsed), 4) AS elapsed
        FROM r WHERE status = 'success' GROUP BY suite_id""",
)
def elapsed_totals(t):
    done = O.existing_success(requests(t))
    return O.elapsed_totals(done, ["suite_id"]).withColumn("elapsed", F.round("elapsed", 4))


@query(
    "congruence_rows",
    """SELECT o_orderkey AS pid, CAST(floor(o_totalprice / 60000) AS BIGINT) AS n_declared, coalesce(n, 0) AS n_found,
        CASE WHEN coalesce(n, 0) = CAST(floor(o_totalprice / 60000) AS BIGINT) THEN 'SUCCESS' ELSE 'FAILURE' END AS status
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def congruence_rows(t):
    declared = t("orders").selectExpr("o_orderkey AS pid", "CAST(floor(o_totalprice / 60000) AS BIGINT) AS n_declared")
    return O.congruence(declared, t("lineitem").selectExpr("l_orderkey AS pid"), "pid")
