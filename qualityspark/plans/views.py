"""Views of the given tables in the shapes the operators take.

The column expressions are plain SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from qualityspark.operators.scores import score_by_type_wide
from qualityspark.plans import Tables

RESULTS = [
    "l_orderkey AS run_id",
    "l_orderkey AS pid",
    "l_linenumber AS check_no",
    """CASE WHEN l_returnflag = 'N' THEN 'SUCCESS' WHEN l_returnflag = 'R' THEN 'FAILURE'
            WHEN l_linestatus = 'F' THEN 'ERROR' ELSE 'SKIP' END AS status""",
    """CASE WHEN l_quantity = 13 THEN NULL WHEN l_partkey % 4 = 0 THEN 'INFO' WHEN l_partkey % 4 = 1 THEN 'METADATA'
            WHEN l_partkey % 4 = 2 THEN 'OPTIONAL' ELSE 'REQUIRED' END AS level""",
    """CASE WHEN l_suppkey % 4 = 0 THEN 'Findable' WHEN l_suppkey % 4 = 1 THEN 'Accessible'
            WHEN l_suppkey % 4 = 2 THEN 'Interoperable' ELSE 'Reusable' END AS type""",
]
RUNS = [
    "o_orderkey AS metadata_id",
    "concat('suite-', CAST(o_orderkey % 3 AS STRING)) AS suite_id",
    "CAST(o_orderdate AS TIMESTAMP) AS ts",
    "CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'success' ELSE 'failure' END AS status",
    "CAST(NULL AS STRING) AS error",
    "o_custkey AS sequence_id",
    "o_orderpriority = '1-URGENT' AS is_latest",
    "CAST(floor(o_totalprice / 35000) AS INT) AS run_count",
    "o_custkey AS custkey",
]
# Versions of documents: the orders of a customer by date, of which some are not
# stored. Links are one-sided, to oneself, past a version, or in a ring for some.
CHAIN = [
    "'suite-1' AS suite_id",
    "o_orderkey AS pid",
    """CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice < 20000 THEN o_orderkey WHEN o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderkey % 13 = 5 THEN prev2 WHEN prev IS NULL AND o_custkey % 50 = 3 THEN nxt ELSE prev END AS obsoletes""",
    "CASE WHEN o_orderkey % 11 = 3 THEN o_orderkey WHEN o_orderkey % 3 <> 0 THEN nxt END AS obsoleted_by",
    "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 400000 THEN o_orderkey + 100000000 END AS sequence_id",
]
CHAIN_ORDER = [
    "*",
    *(f"{f} OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS {n}" for f, n in (("lag(o_orderkey)", "prev"), ("lag(o_orderkey, 2)", "prev2"), ("lead(o_orderkey)", "nxt"))),
]
CHAIN_STORED = "NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"
REQUESTS = [
    "event_id",
    "user_id AS pid",
    "concat('suite-', CAST(event_id % 3 AS STRING)) AS suite_id",
    "CAST(ts AS TIMESTAMP) AS ts",
    "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'processing' END AS status",
    "value AS elapsed",
]
SYSMETA = [
    "o_orderkey AS pid",
    "o_orderkey AS identifier",
    "concat('eml-2.', substring(o_orderpriority, 1, 1)) AS format_id",
    "CAST(o_orderdate AS TIMESTAMP) AS modified",
    "o_custkey AS rights_holder",
]
NODES = [
    "concat('urn:node:', n_name) AS node_id",
    "concat('urn:node:', n_name) AS identifier",
    "CASE WHEN n_regionkey = 4 THEN 'CN' ELSE 'MN' END AS type",
    "CASE WHEN n_nationkey = 7 THEN 'DOWN' ELSE 'UP' END AS state",
    "n_nationkey <> 11 AS synchronize",
    "n_nationkey AS nationkey",
]

# Repositories: suppliers, every tenth of them a coordinating node.
REPOSITORIES = [
    "concat('urn:node:', CASE WHEN s_suppkey % 10 = 0 THEN 'CN' ELSE '' END, s_name) AS identifier",
    "CASE WHEN s_suppkey % 10 = 0 THEN 'CN' ELSE 'MN' END AS type",
    "CASE WHEN s_acctbal < 0 THEN 'DOWN' ELSE 'UP' END AS state",
    "s_nationkey <> 11 AS synchronize",
]


def _cte(name: str, columns: list[str], source: str, where: str | None = None) -> str:
    tail = f" WHERE {where}" if where else ""
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source}{tail})"


CTE = {
    "results_v": _cte("results_v", RESULTS, "lineitem"),
    "runs_v": _cte("runs_v", RUNS, "orders"),
    "chain_v": _cte("chain_v", CHAIN, f"(SELECT {', '.join(CHAIN_ORDER)} FROM orders)", CHAIN_STORED),
    "requests_v": _cte("requests_v", REQUESTS, "events"),
    "repositories_v": _cte("repositories_v", REPOSITORIES, "supplier"),
    "nodes_v": _cte("nodes_v", NODES, "nation"),
    "sysmeta_v": _cte(
        "sysmeta_v",
        [*SYSMETA, "concat('urn:node:', n_name) AS node_id"],
        "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "counts_v": """counts_v AS (
        SELECT run_id,
            count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA')) AS checks_passed,
            count(*) FILTER (WHERE status = 'FAILURE' AND level = 'OPTIONAL') AS checks_warned,
            count(*) FILTER (WHERE status = 'FAILURE' AND level = 'REQUIRED') AS checks_failed,
            count(*) FILTER (WHERE status = 'ERROR') AS checks_errored,
            count(*) FILTER (WHERE status = 'SKIP') + count(*) FILTER (WHERE level = 'INFO') AS checks_info,
            count(*) - count(*) FILTER (WHERE level = 'METADATA') AS check_count,
            count(*) FILTER (WHERE status IN ('FAILURE', 'ERROR') AND level = 'REQUIRED') AS blocking
        FROM results_v GROUP BY run_id)""",
    "overall_v": """overall_v AS (
        SELECT run_id, CASE WHEN checks_passed + blocking = 0 THEN 'NaN'::DOUBLE
            ELSE checks_passed / (checks_passed + blocking)::DOUBLE END AS score_overall FROM counts_v)""",
    "types_v": """types_v AS (
        SELECT run_id, type,
            CAST(round_even(CASE WHEN p + b = 0 THEN 0.0 ELSE p / (p + b)::DOUBLE END, 2) AS FLOAT) AS score
        FROM (SELECT run_id, type,
                count(*) FILTER (WHERE status = 'SUCCESS' AND level NOT IN ('INFO', 'METADATA')) AS p,
                count(*) FILTER (WHERE status IN ('FAILURE', 'ERROR') AND level = 'REQUIRED') AS b
              FROM results_v GROUP BY run_id, type))""",
    "wide_v": """wide_v AS (
        SELECT run_id,
            max(score) FILTER (WHERE type = 'Findable') AS score_findable,
            max(score) FILTER (WHERE type = 'Accessible') AS score_accessible,
            max(score) FILTER (WHERE type = 'Interoperable') AS score_interoperable,
            max(score) FILTER (WHERE type = 'Reusable') AS score_reusable
        FROM types_v GROUP BY run_id)""",
    "scores_v": """scores_v AS (
        SELECT o_orderkey AS metadata_id, concat('suite-', CAST(o_orderkey % 3 AS STRING)) AS suite_id,
            CAST(o_orderdate AS TIMESTAMP) AS date_uploaded, concat('urn:node:', n_name) AS datasource,
            concat('eml-2.', substring(o_orderpriority, 1, 1)) AS metadata_format_id,
            CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_custkey END AS sequence_id,
            score_overall, COALESCE(score_findable, 0) AS score_findable, COALESCE(score_accessible, 0) AS score_accessible,
            COALESCE(score_interoperable, 0) AS score_interoperable, score_reusable
        FROM wide_v JOIN overall_v USING (run_id) JOIN orders ON o_orderkey = run_id
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
}
CTE["scored"] = ", ".join(CTE[n] for n in ("results_v", "counts_v", "overall_v", "types_v", "wide_v", "scores_v"))


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names) + " "


def results(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr(*RESULTS)


def runs(t: Tables) -> DataFrame:
    return t("orders").selectExpr(*RUNS)


def chain(t: Tables) -> DataFrame:
    return t("orders").selectExpr(*CHAIN_ORDER).filter(CHAIN_STORED).selectExpr(*CHAIN)


def requests(t: Tables) -> DataFrame:
    return t("events").selectExpr(*REQUESTS)


def nodes(t: Tables) -> DataFrame:
    return t("nation").selectExpr(*NODES)


def repositories(t: Tables) -> DataFrame:
    return t("supplier").selectExpr(*REPOSITORIES)


def places(t: Tables) -> DataFrame:
    """Node of each customer."""
    nation = t("nation").selectExpr("n_nationkey AS c_nationkey", "concat('urn:node:', n_name) AS node_id")
    return t("customer").join(nation, "c_nationkey").selectExpr("c_custkey AS o_custkey", "node_id")


def sysmeta(t: Tables) -> DataFrame:
    return t("orders").join(places(t), "o_custkey").selectExpr(*SYSMETA, "node_id")


def scores(t: Tables) -> DataFrame:
    """Score records: one aggregation over the results, joined to the runs' metadata."""
    scored = score_by_type_wide(results(t), overall=True)
    meta = t("orders").join(places(t), "o_custkey")
    return scored.join(meta, scored.run_id == meta.o_orderkey).selectExpr(
        "o_orderkey AS metadata_id",
        "concat('suite-', CAST(o_orderkey % 3 AS STRING)) AS suite_id",
        "CAST(o_orderdate AS TIMESTAMP) AS date_uploaded",
        "node_id AS datasource",
        "concat('eml-2.', substring(o_orderpriority, 1, 1)) AS metadata_format_id",
        "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_custkey END AS sequence_id",
        "score_overall",
        "COALESCE(score_findable, CAST(0 AS FLOAT)) AS score_findable",
        "COALESCE(score_accessible, CAST(0 AS FLOAT)) AS score_accessible",
        "COALESCE(score_interoperable, CAST(0 AS FLOAT)) AS score_interoperable",
        "score_reusable",
    )
