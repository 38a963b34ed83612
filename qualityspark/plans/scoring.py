"""Counts, scores and proportions of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.operators import scores as O
from qualityspark.plans import query
from qualityspark.plans.views import results, with_views

_RESULTS = with_views("results_v")
_SOURCED = """sourced AS (SELECT r.*, concat('urn:node:', n_name) AS datasource FROM results_v r
    JOIN orders ON o_orderkey = run_id JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _sourced(t):
    from qualityspark.plans.views import places

    where = t("orders").join(places(t), "o_custkey").selectExpr("o_orderkey AS run_id", "node_id AS datasource")
    return results(t).join(where, "run_id")


@query(
    "score_counts",
    with_views("results_v", "counts_v") + "SELECT * EXCLUDE (blocking) FROM counts_v",
)
def score_counts(t):
    return O.score_runs(results(t)).drop("score_overall")


@query("score_overall", with_views("results_v", "counts_v", "overall_v") + "SELECT * FROM overall_v")
def score_overall(t):
    return O.score_runs(results(t)).select("run_id", "score_overall")


@query(
    "score_overall_null",
    with_views("results_v", "counts_v", "overall_v")
    + "SELECT count(*) AS runs, count(*) FILTER (WHERE isnan(score_overall)) AS without_score FROM overall_v",
)
def score_overall_null(t):
    scored = O.score_runs(results(t), nan_to_null=True)
    return scored.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("score_overall").isNull()).alias("without_score")
    )


@query(
    "score_by_type",
    with_views("results_v", "types_v") + "SELECT run_id, type, CAST(score AS DOUBLE) AS score FROM types_v",
)
def score_by_type(t):
    return O.score_by_type(results(t)).withColumn("score", F.col("score").cast("double"))


@query(
    "score_by_type_wide",
    with_views("results_v", "types_v", "wide_v")
    + """SELECT run_id, CAST(score_findable AS DOUBLE) AS score_findable, CAST(score_accessible AS DOUBLE) AS score_accessible,
        CAST(score_interoperable AS DOUBLE) AS score_interoperable, CAST(score_reusable AS DOUBLE) AS score_reusable FROM wide_v""",
)
def score_by_type_wide(t):
    wide = O.score_by_type_wide(results(t))
    return wide.select("run_id", *[F.col(c).cast("double").alias(c) for c in wide.columns[1:]])


@query(
    "score_map",
    with_views("results_v", "types_v")
    + """SELECT run_id, string_agg('scoreByType_' || type || '_f=' || CAST(CAST(score AS DECIMAL(5, 2)) AS STRING), ',' ORDER BY type) AS scores
        FROM types_v GROUP BY run_id""",
)
def score_map(t):
    entries = F.array_sort(F.map_entries("scores"))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(5,2)").cast("string")))
    return O.score_map(results(t)).select("run_id", F.array_join(text, ",").alias("scores"))


@query("distinct_types", _RESULTS + "SELECT DISTINCT run_id, type FROM results_v")
def distinct_types(t):
    return O.distinct_types(results(t))


@query(
    "errored_runs",
    with_views("results_v", "counts_v")
    + "SELECT run_id, checks_errored FROM counts_v WHERE checks_errored >= 1",
)
def errored_runs(t):
    return O.runs_with_status(O.score_runs(results(t)), errored=True).select("run_id", "checks_errored")


@query(
    "clean_runs",
    with_views("results_v", "counts_v", "overall_v")
    + "SELECT run_id, check_count, score_overall FROM counts_v JOIN overall_v USING (run_id) WHERE checks_errored = 0",
)
def clean_runs(t):
    return O.runs_with_status(O.score_runs(results(t)), errored=False).select("run_id", "check_count", "score_overall")


@query(
    "proportions_single",
    _RESULTS
    + """SELECT pid, type, status, level, count(*) AS n, count(*) / (SELECT count(*) FROM results_v)::DOUBLE AS proportion,
        CASE WHEN level = 'INFO' THEN 'BLUE' WHEN status = 'SKIP' THEN 'BLUE' WHEN status = 'SUCCESS' THEN 'GREEN'
            WHEN status = 'FAILURE' THEN CASE WHEN level = 'OPTIONAL' THEN 'ORANGE' ELSE 'RED' END
            WHEN status = 'ERROR' THEN CASE WHEN level = 'REQUIRED' THEN 'RED' ELSE 'ORANGE' END END AS color
        FROM results_v GROUP BY pid, type, status, level""",
)
def proportions_single(t):
    return O.proportions_single(results(t))


@query(
    "proportions_multi",
    with_views("results_v").rstrip()
    + f", {_SOURCED} "
    + """SELECT datasource, status, level, count(*) AS n, count(*) / (SELECT count(*) FROM sourced)::DOUBLE AS proportion
        FROM sourced GROUP BY datasource, status, level""",
)
def proportions_multi(t):
    return O.proportions_multi(_sourced(t))


_BOX = f"""{with_views('results_v').rstrip()}, {_SOURCED}, box AS (
    SELECT datasource, pid, count(*) FILTER (WHERE status = 'SUCCESS') / count(*)::DOUBLE AS score
    FROM sourced WHERE level <> 'INFO' GROUP BY datasource, pid) """


@query("box_scores", _BOX + "SELECT * FROM box")
def box_scores(t):
    return O.box_scores(_sourced(t))


@query(
    "box_summary",
    _BOX
    + """SELECT datasource, count(*) AS n, round(min(score), 9) AS low, round(quantile_cont(score, 0.25), 9) AS q1,
        round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.75), 9) AS q3,
        round(max(score), 9) AS high FROM box GROUP BY datasource""",
)
def box_summary(t):
    s = O.box_summary(O.box_scores(_sourced(t)))
    return s.select("datasource", "n", *[F.round(c, 9).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(
    "summary_kind",
    _RESULTS + "SELECT CASE WHEN count(DISTINCT pid) = 1 THEN 'single' ELSE 'multi' END AS summary FROM results_v",
)
def summary_kind(t):
    return O.summary_kind(results(t))


@query(
    "result_order",
    _RESULTS
    + """SELECT level, status, count(*) AS n,
        CAST(coalesce(list_position(['INFO', 'OPTIONAL', 'REQUIRED'], level), 0) AS BIGINT) AS level_rank,
        CAST(list_position(['SUCCESS', 'FAILURE', 'SKIP', 'ERROR'], status) AS BIGINT) AS status_rank
        FROM results_v WHERE level IS NOT NULL GROUP BY level, status""",
)
def result_order(t):
    counted = results(t).filter("level IS NOT NULL").groupBy("level", "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns(
        {
            "level_rank": S.rank_in(F.col("level"), S.PLOT_LEVELS),
            "status_rank": S.rank_in(F.col("status"), S.STATUSES),
        }
    ).orderBy("level_rank", "status_rank")


@query(
    "presence_fold",
    _RESULTS
    + """SELECT run_id, CASE WHEN bool_and(status <> 'FAILURE') THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
        string_agg(type || ': ' || status, '; ' ORDER BY check_no, type || ': ' || status) AS messages FROM results_v GROUP BY run_id""",
)
def presence_fold(t):
    told = results(t).withColumn("message", F.concat_ws(": ", "type", "status"))
    return O.fold_statuses(told, "run_id").withColumn("messages", F.array_join("messages", "; "))


@query(
    "corpus_results",
    with_views("results_v").rstrip()
    + f", {_SOURCED} "
    + """SELECT datasource, type, level, count(*) AS n, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success
        FROM sourced WHERE pid IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
        GROUP BY datasource, type, level""",
)
def corpus_results(t):
    """Results of a suite over the documents a query selects."""
    chosen = t("orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS pid")
    return O.corpus_results(_sourced(t), chosen, ["datasource", "type", "level"])
