"""Monthly and cumulative score series."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualityspark.operators import report as P
from qualityspark.operators import rollup as O
from qualityspark.plans import query
from qualityspark.plans.views import scores, with_views
from qualityspark.session import cut_lineage, scratch_path

_LATEST = (
    with_views("scored").rstrip()
    + """, dated AS (SELECT *, CAST(date_trunc('month', date_uploaded) AS DATE) AS ym,
        CAST(score_findable AS DOUBLE) * 100.0 AS f, CAST(score_accessible AS DOUBLE) * 100.0 AS a,
        CAST(score_interoperable AS DOUBLE) * 100.0 AS i, CAST(score_reusable AS DOUBLE) * 100.0 AS r FROM scores_v),
    latest AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ym, sequence_id ORDER BY date_uploaded DESC) AS rk
        FROM dated) WHERE rk = 1)"""
)


def _means(by: str) -> str:
    key = f"{by}, ym" if by else "ym"
    one = ", ".join(
        f"CASE WHEN count({m}) = count(*) THEN sum({m}) / count(*) END AS {m}" for m in ("f", "a", "i", "r")
    )
    part = f"PARTITION BY {by} " if by else ""
    run = ", ".join(
        f"CASE WHEN count({m}) OVER w = count(*) OVER w THEN avg({m}) OVER w END AS {m}c" for m in ("f", "a", "i", "r")
    )
    return (
        f", monthly AS (SELECT {key}, count(*) AS n, {one} FROM latest GROUP BY {key}),"
        f" series AS (SELECT *, {run} FROM monthly WINDOW w AS ({part}ORDER BY ym ROWS UNBOUNDED PRECEDING))"
    )


_LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in O.LABELS.items()) + "}"


def _long(by: str) -> str:
    keep = f"{by}, ym" if by else "ym"
    return (
        f", long AS (SELECT {keep}, {_LABELS}[m] AS metric, mean FROM "
        f"(SELECT * EXCLUDE (n) FROM series) UNPIVOT INCLUDE NULLS (mean FOR m IN (f, a, i, r, fc, ac, ic, rc)))"
    )


def series_sql() -> str:
    """Monthly and cumulative means in long form, over a CTE ``latest(ym, f, a, i, r)``."""
    return _means("") + _long("")


_SERIES = _LATEST + _means("")
_LONG = _SERIES + _long("")


def _rounded(df, *columns):
    return df.select(*[F.round(c, 8).alias(c) if c in columns else c for c in df.columns])


def _monthly(t):
    return O.monthly_means(O.with_month(scores(t)))


def _long_series(t):
    return O.scores_long(O.cumulative_means(_monthly(t)))


@query(
    "score_records",
    with_views("scored")
    + """SELECT metadata_id, suite_id, date_uploaded, datasource, metadata_format_id, sequence_id, score_overall,
        CAST(score_findable AS DOUBLE) AS score_findable, CAST(score_reusable AS DOUBLE) AS score_reusable FROM scores_v""",
)
def score_records(t):
    return scores(t).select(
        *["metadata_id", "suite_id", "date_uploaded", "datasource", "metadata_format_id", "sequence_id", "score_overall"],
        F.col("score_findable").cast("double").alias("score_findable"),
        F.col("score_reusable").cast("double").alias("score_reusable"),
    )


@query("latest_in_month", _LATEST + " SELECT ym, sequence_id, metadata_id, date_uploaded FROM latest")
def latest_in_month(t):
    return O.in_order(O.latest_versions(O.with_month(scores(t))).select("ym", "sequence_id", "metadata_id", "date_uploaded"))


@query(
    "monthly_scores",
    _SERIES + " SELECT ym, n, round(f, 8) AS f, round(a, 8) AS a, round(i, 8) AS i, round(r, 8) AS r FROM monthly",
)
def monthly_scores(t):
    m = _monthly(t)
    return _rounded(m.withColumn("n", F.col("n").cast("bigint")), "f", "a", "i", "r")


@query(
    "cumulative_scores",
    _SERIES + " SELECT ym, round(fc, 8) AS fc, round(ac, 8) AS ac, round(ic, 8) AS ic, round(rc, 8) AS rc FROM series",
)
def cumulative_scores(t):
    c = O.cumulative_means(_monthly(t)).select("ym", "fc", "ac", "ic", "rc")
    return _rounded(c, "fc", "ac", "ic", "rc")


@query("scores_long", _LONG + " SELECT ym, metric, round(mean, 8) AS mean FROM long")
def scores_long(t):
    return _rounded(_long_series(t), "mean")


@query("monthly_series", _LONG + " SELECT ym, metric, round(mean, 8) AS mean FROM long WHERE metric NOT LIKE 'Cum.%'")
def monthly_series(t):
    return _rounded(O.monthly_series(_long_series(t)), "mean")


@query("cumulative_series", _LONG + " SELECT ym, metric, round(mean, 8) AS mean FROM long WHERE metric LIKE 'Cum.%'")
def cumulative_series(t):
    return _rounded(O.cumulative_series(_long_series(t)), "mean")


@query(
    "overall_means",
    _LONG
    + """ SELECT metric, round(avg(mean), 8) AS mean,
        metric || ' (' || CAST(CAST(round_even(avg(mean), 0) AS BIGINT) AS STRING) || '%)' AS label
        FROM long WHERE metric NOT LIKE 'Cum.%' GROUP BY metric""",
)
def overall_means(t):
    return _rounded(O.overall_means(_long_series(t)), "mean")


@query(
    "last_cumulative",
    _LONG
    + """ SELECT metric, max(ym) AS ym, round(arg_max_null(mean, ym), 8) AS mean FROM long
        WHERE metric LIKE 'Cum.%' GROUP BY metric""",
)
def last_cumulative(t):
    return _rounded(O.last_cumulative(_long_series(t)), "mean")


@query(
    "axis_unit",
    _LATEST
    + """ SELECT CAST(year(min(ym)) AS INT) AS min_year, CAST(year(max(ym)) AS INT) AS max_year,
        CASE WHEN year(min(ym)) = year(max(ym)) THEN 'Month' ELSE 'Year' END AS axis FROM latest""",
)
def axis_unit(t):
    return O.axis_unit(_long_series(t))


@query(
    "node_report",
    _LATEST.replace("PARTITION BY ym, sequence_id", "PARTITION BY datasource, ym, sequence_id")
    + _means("datasource")
    + _long("datasource")
    + " SELECT datasource, ym, metric, round(mean, 8) AS mean FROM long",
)
def node_report(t):
    """Monthly and cumulative series of every node in one job."""
    return _rounded(O.collection_report(scores(t), ["datasource"]), "mean")


def report_batches(rows) -> list:
    """Score rows in three batches; a fourth of them come first with other scores and an earlier date, and change later."""
    third = F.pmod(F.xxhash64("metadata_id"), F.lit(3))
    early = (third > 0) & (F.pmod(F.xxhash64("metadata_id", "suite_id"), F.lit(4)) == 0)
    other = {m: F.when(F.col(m) > 50, F.col(m) - 30) for m in O.METRICS}
    first = rows.filter(early).withColumns({**other, "date_uploaded": F.col("date_uploaded") - F.expr("INTERVAL 20 DAY")})
    first = first.withColumn("ym", F.trunc("date_uploaded", "month"))
    return [rows.filter(third == 0).unionByName(first.select(*rows.columns)), rows.filter(third == 1), rows.filter(third == 2)]


@query(
    "report_incremental",
    _SERIES + " SELECT ym, n, " + ", ".join(f"round({m}, 6) AS {m}" for m in (*O.METRICS, *(f"{m}c" for m in O.METRICS))) + " FROM series",
)
def report_incremental(t):
    """Monthly and cumulative means after three batches of changed scores, from stored totals only."""
    keys = ["metadata_id", "suite_id"]
    rows = cut_lineage(P.months_of(scores(t), keys))
    report = P.Report.at(t.spark, scratch_path(t.spark, "report"), rows.schema, keys)
    for number, batch in enumerate(report_batches(rows)):
        report.apply(batch, number)
    names = [*O.METRICS, *(f"{m}c" for m in O.METRICS)]
    return report.series().select("ym", "n", *(F.round(m, 6).alias(m) for m in names))
