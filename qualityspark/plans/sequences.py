"""Version sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualityspark.operators import sequences as O
from qualityspark.plans import query
from qualityspark.plans.views import CTE, chain, runs, with_views
from qualityspark.session import cut_lineage
from qualityspark.streaming import requests as R

_WALK = (
    "WITH RECURSIVE "
    + CTE["chain_v"]
    + """, named AS (SELECT obsoleted_by AS pid, min(pid) AS by FROM chain_v WHERE obsoleted_by <> pid GROUP BY obsoleted_by),
    linked AS (SELECT c.*, coalesce(CASE WHEN c.obsoletes <> c.pid THEN p.pid END, named.by) AS back
        FROM chain_v c LEFT JOIN chain_v p ON p.pid = c.obsoletes LEFT JOIN named ON named.pid = c.pid),
    walk AS (
        SELECT pid, pid AS head, CAST(0 AS BIGINT) AS position, obsoletes IS NULL AS head_is_first FROM linked WHERE back IS NULL
        UNION ALL SELECT n.pid, w.head, w.position + 1, w.head_is_first FROM walk w JOIN linked n ON n.back = w.pid),
    chains AS (SELECT head, arg_min(sequence_id, position) AS found, bool_or(head_is_first) AS reached, min(sequence_id) AS least,
        max(sequence_id) AS greatest, count(*) AS versions FROM walk JOIN chain_v USING (pid) GROUP BY head),
    ids AS (SELECT head, coalesce(found, CASE WHEN reached THEN head END) AS chain_id, least, greatest, versions FROM chains) """
)


@query(
    "sequence_root",
    _WALK + "SELECT pid, head, position, coalesce(head_is_first, FALSE) AS head_is_first, head IS NULL AS in_cycle FROM chain_v LEFT JOIN walk USING (pid)",
)
def sequence_root(t):
    """Chains over one-sided links, branches, self links and rings."""
    return O.walk_back(chain(t)).select("pid", "head", "position", "head_is_first", "in_cycle")


@query(
    "sequence_assign",
    _WALK
    + """SELECT pid, head, position, coalesce(chain_id, c.sequence_id) AS sequence_id,
        chain_id IS NOT NULL AND c.sequence_id IS DISTINCT FROM chain_id AS modified
        FROM chain_v c LEFT JOIN walk USING (pid) LEFT JOIN ids USING (head)""",
)
def sequence_assign(t):
    return O.assign_sequence(chain(t)).select("pid", "head", "position", "sequence_id", "modified")


@query(
    "sequence_modified",
    _WALK
    + """SELECT pid, chain_id AS sequence_id FROM walk JOIN ids USING (head) JOIN chain_v c USING (pid)
        WHERE chain_id IS NOT NULL AND c.sequence_id IS DISTINCT FROM chain_id""",
)
def sequence_modified(t):
    return O.modified_runs(O.assign_sequence(chain(t))).select("pid", "sequence_id")


@query("sequence_conflicts", _WALK + "SELECT head, chain_id, versions FROM ids WHERE least <> greatest")
def sequence_conflicts(t):
    return O.sequence_conflicts(chain(t)).select("head", "chain_id", "versions")



@query(
    "sequence_relink",
    _WALK
    + """, arrived AS (SELECT o_orderkey AS pid FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
        touched AS (SELECT DISTINCT head FROM walk WHERE pid IN (SELECT pid FROM arrived))
        SELECT pid, coalesce(chain_id, c.sequence_id) AS sequence_id FROM chain_v c JOIN arrived USING (pid) LEFT JOIN walk USING (pid) LEFT JOIN ids USING (head)""",
)
def sequence_relink(t):
    """Arrivals fill gaps: only the chains they touch are walked, with the ids of a walk over all."""
    everything = chain(t)
    late = t("orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").selectExpr("o_orderkey AS pid")
    arrived = cut_lineage(everything.join(late, "pid", "left_semi"))
    before = cut_lineage(everything.join(late, "pid", "left_anti"))
    stored = R.with_heads(before)
    return R.relink(stored, arrived).join(late, "pid", "left_semi").select("pid", "sequence_id")


_LATEST = """, dated AS (SELECT metadata_id AS pid, sequence_id, ts AS date_uploaded, is_latest, date_trunc('month', ts) AS month,
    row_number() OVER (PARTITION BY sequence_id, date_trunc('month', ts) ORDER BY ts DESC, metadata_id DESC) = 1 AS top FROM runs_v) """


def _dated(t):
    return runs(t).selectExpr("metadata_id AS pid", "sequence_id", "ts AS date_uploaded", "is_latest")


@query(
    "latest_run_in_month",
    with_views("runs_v").rstrip()
    + _LATEST
    + "SELECT sequence_id, CAST(month AS TIMESTAMP) AS month, pid, date_uploaded FROM dated WHERE top",
)
def latest_run_in_month(t):
    return O.latest_in_month(_dated(t))


@query(
    "mark_latest_modified",
    with_views("runs_v").rstrip() + _LATEST + "SELECT pid, top AS is_latest, is_latest <> top AS modified FROM dated",
)
def mark_latest_modified(t):
    return O.mark_latest(_dated(t)).select("pid", "is_latest", "modified")
