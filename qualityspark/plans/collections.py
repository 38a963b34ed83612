"""Collections: customers as owners, orders as documents."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from qualityspark.operators import collections as O
from qualityspark.operators import harvest as H
from qualityspark.operators import rollup
from qualityspark.plans import query
from qualityspark.plans.views import CTE, scores, with_views

# Documents: an order is public, or readable by its customer's market segment.
_DOCS = [
    "o_orderkey AS pid",
    "concat('c', CAST(o_custkey AS STRING)) AS rights_holder",
    "o_orderstatus AS status",
    "o_totalprice AS size",
    "o_orderpriority AS priority",
    "c_mktsegment AS segment",
    "o_orderdate AS ordered",
]
# Collections by predicate; owners are a segment or a single customer.
_PREDICATES = {
    "big": "size > 250000",
    "urgent": "priority = '1-URGENT' OR priority = '2-HIGH'",
    "open": "status = 'O' AND size < 100000",
}
_RULES = [
    O.Rule("big", (O.Between("size", low=250000, open=True),)),
    O.Rule("urgent", (O.OneOf("priority", ("1-URGENT", "2-HIGH")),)),
    O.Rule("open", (O.Between("size", high=100000, open=True), O.OneOf("status", ("O",)))),
]
_OWNERS = {"big": "g-BUILDING", "urgent": "c17", "open": "g-MACHINERY"}
_DOCS_CTE = f"""docs AS (SELECT {', '.join(_DOCS)}, CASE WHEN o_orderstatus = 'F' THEN ['public'] ELSE ['g-' || c_mktsegment] END AS read_subjects
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
_MEMBERS = (
    f"WITH {_DOCS_CTE}, subjects AS (SELECT 'big' AS collection_id, 'g-BUILDING' AS subject UNION ALL SELECT 'open', 'g-MACHINERY'"
    " UNION ALL SELECT 'urgent', 'c17' UNION ALL SELECT 'urgent', 'g-' || c_mktsegment FROM customer WHERE c_custkey = 17),"
    " matched AS (" + " UNION ALL ".join(f"SELECT *, '{c}' AS collection_id FROM docs WHERE {p}" for c, p in _PREDICATES.items()) + "),"
    """ members AS (SELECT collection_id, pid FROM matched m WHERE list_contains(read_subjects, 'public')
        OR EXISTS (SELECT 1 FROM subjects s WHERE s.collection_id = m.collection_id
            AND (list_contains(read_subjects, s.subject) OR rights_holder = s.subject))) """
)


def _docs(t):
    docs = t("orders").join(t("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return docs.selectExpr(
        *_DOCS, "CASE WHEN o_orderstatus = 'F' THEN array('public') ELSE array(concat('g-', c_mktsegment)) END AS read_subjects"
    )


def _membership(t):
    return t("customer").selectExpr("concat('c', CAST(c_custkey AS STRING)) AS subject", "concat('g-', c_mktsegment) AS group")


def _collections(t):
    rows = [(c, c.title(), _OWNERS[c], None) for c in _PREDICATES] + [("big", "Old", "g-NONE", "big.2")]
    return t.spark.createDataFrame(rows, "collection_id string, label string, rights_holder string, obsoleted_by string")


def _members(t):
    current = O.current_collections(_collections(t))
    subjects = O.owner_subjects(current, _membership(t))
    return O.members(O.matching(_docs(t), _RULES), subjects)


@query("collection_members", _MEMBERS + "SELECT collection_id, pid FROM members")
def collection_members(t):
    return _members(t)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_MANY = 300


def many_rules() -> list[O.Rule]:
    """Collections by a range of sizes, by priority and size, and by status and a range of dates."""
    rules = []
    for i in range(_MANY):
        day = date(1992, 1, 1) + timedelta(days=8 * i)
        by = (
            (O.Between("size", 1500 * i, 1500 * i + 900 * (i % 7 + 1)),),
            (O.OneOf("priority", (_PRIORITIES[i % 5],)), O.Between("size", high=2000 + 100 * i, open=True)),
            (O.OneOf("status", ("FOP"[i % 3], "F")), O.Between("ordered", str(day), str(day + timedelta(days=20)))),
        )
        rules.append(O.Rule(f"rule-{i}", by[i // 3 % 3]))
    return rules


@query(
    "collection_rules",
    f"""WITH {_DOCS_CTE}, rules AS (SELECT i, i // 3 % 3 AS kind FROM range({_MANY}) r(i))
    SELECT 'rule-' || i AS collection_id, pid FROM docs JOIN rules ON CASE kind
        WHEN 0 THEN size >= 1500 * i AND size <= 1500 * i + 900 * (i % 7 + 1)
        WHEN 1 THEN priority = list_extract({list(_PRIORITIES)}, i % 5 + 1) AND size < 2000 + 100 * i
        ELSE status IN (substring('FOP', i % 3 + 1, 1), 'F') AND CAST(ordered AS DATE) BETWEEN DATE '1992-01-01' + CAST(8 * i AS INT) AND DATE '1992-01-01' + CAST(8 * i + 20 AS INT) END""",
)
def collection_rules(t):
    """Hundreds of collections in one join: rules are rows of an index, not expressions of the plan."""
    return O.matching(_docs(t), many_rules()).select("collection_id", "pid")


@query(
    "readable_documents",
    f"""WITH {_DOCS_CTE} SELECT pid, list_contains(read_subjects, 'public') OR list_contains(read_subjects, 'g-BUILDING') OR rights_holder = 'c17' AS readable FROM docs""",
)
def readable_documents(t):
    subjects = F.array(F.lit("c17"), F.lit("g-BUILDING"))
    return _docs(t).select("pid", O.readable_by(F.col("read_subjects"), F.col("rights_holder"), subjects).alias("readable"))


@query(
    "active_collections",
    "SELECT c_custkey AS collection_id FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')",
)
def active_collections(t):
    """Collections whose usage is active."""
    usage = t("events").selectExpr("user_id AS collection_id", "CASE WHEN event_type = 'signup' THEN 'Active' ELSE 'inactive' END AS status")
    return O.active_collections(t("customer").selectExpr("c_custkey AS collection_id"), usage)


@query(
    "collection_queries",
    """SELECT c_custkey, concat('(((project:"', c_name, '")))') AS query FROM customer""",
)
def collection_queries(t):
    """Stored queries lose the clause that keeps only newest versions."""
    stored = F.concat(F.lit('(((project:"'), F.col("c_name"), F.lit('") AND (-obsoletedBy:* AND formatType:METADATA)))'))
    return t("customer").select("c_custkey", O.all_versions(stored).alias("query"))


@query(
    "collection_listing",
    """SELECT o_orderkey AS pid FROM orders WHERE regexp_full_match(o_orderpriority, '.*-(URGENT|HIGH)') AND o_orderstatus <> 'P'
        AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'""",
)
def collection_listing(t):
    rows = t("orders").selectExpr(
        "o_orderkey AS pid", "o_orderpriority AS format_id", "CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 END AS obsoleted_by",
        "CAST(o_orderdate AS TIMESTAMP) AS modified",
    )
    listed = H.collection_listing(rows, ".*-URGENT|.*-HIGH", F.expr("TIMESTAMP '1996-01-01'"), F.expr("TIMESTAMP '1997-01-01'"))
    return listed.select("pid")


@query(
    "node_scores",
    with_views("scored")
    + """SELECT metadata_id, datasource, score_overall FROM scores_v WHERE suite_id = 'suite-1' AND datasource = 'urn:node:NATION_3'""",
)
def node_scores(t):
    """The format family is left out of node collections."""
    found = O.node_scores(scores(t), "urn:node:NATION_3", "suite-1", families="none")
    return found.select("metadata_id", "datasource", "score_overall")


@query(
    "all_node_scores",
    with_views("scored") + "SELECT metadata_id, datasource FROM scores_v WHERE suite_id = 'suite-1' AND (metadata_format_id LIKE '%-2.1%' OR metadata_format_id LIKE '%.5%')",
)
def all_node_scores(t):
    """A coordinating node stands for all; here with the format families applied."""
    found = O.node_scores(scores(t), "urn:node:CN", "suite-1", families="-2.1,.5", apply_format=True)
    return found.select("metadata_id", "datasource")


_COLLECTION = _MEMBERS.rstrip() + ", " + CTE["scored"]


@query(
    "collection_scores",
    _COLLECTION
    + """ SELECT collection_id, metadata_id, score_overall FROM scores_v JOIN members ON pid = metadata_id
        WHERE suite_id = 'suite-1' AND (metadata_format_id LIKE '%2.1%' OR metadata_format_id LIKE '%2.4%')""",
)
def collection_scores(t):
    found = O.member_scores(scores(t), _members(t), "suite-1", "2.1,2.4")
    return found.select("collection_id", "metadata_id", "score_overall")


_MONTHLY = ", ".join(
    f"round(CASE WHEN count({c}) = count(*) THEN sum(CAST({c} AS DOUBLE) * 100.0) / count(*) END, 8) AS {m}"
    for m, c in rollup.METRICS.items()
)


@query(
    "collection_monthly",
    _COLLECTION
    + f""", ranked AS (SELECT *, CAST(date_trunc('month', date_uploaded) AS DATE) AS ym, rank() OVER (PARTITION BY collection_id,
        date_trunc('month', date_uploaded), sequence_id ORDER BY date_uploaded DESC) AS rk FROM scores_v JOIN members ON pid = metadata_id)
        SELECT collection_id, ym, {_MONTHLY} FROM ranked WHERE rk = 1 GROUP BY collection_id, ym""",
)
def collection_monthly(t):
    """Monthly means of every collection in one job."""
    found = O.member_scores(scores(t), _members(t))
    monthly = rollup.monthly_means(rollup.with_month(found), ["collection_id"])
    return monthly.select("collection_id", "ym", *[F.round(m, 8).alias(m) for m in rollup.METRICS])
