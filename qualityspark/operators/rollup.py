"""Monthly and cumulative score series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.operators.skew import join_latest

# Metric columns and their labels.
METRICS = {"f": "score_findable", "a": "score_accessible", "i": "score_interoperable", "r": "score_reusable"}
LABELS = {
    "f": "Findable",
    "a": "Accessible",
    "i": "Interoperable",
    "r": "Reusable",
    "fc": "Cum. Findable",
    "ac": "Cum. Accessible",
    "ic": "Cum. Interoperable",
    "rc": "Cum. Reusable",
}
MONTHLY = ["Findable", "Accessible", "Interoperable", "Reusable"]
CUMULATIVE = ["Cum. Findable", "Cum. Accessible", "Cum. Interoperable", "Cum. Reusable"]


def with_month(scores: DataFrame) -> DataFrame:
    """Month start, and each score as a percentage."""
    return scores.withColumn("ym", S.month_start(F.col("date_uploaded"))).withColumns(
        {k: S.percent(F.col(c).cast("double")) for k, c in METRICS.items()}
    )


def latest_versions(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of the latest version(s) per month and sequence.

    Ties stay, and rows without a sequence id form one group per month. The
    newest date is found by a combining aggregation rather than a window, so a
    large group is never sorted in one task.
    """
    keys = [*(by or []), "ym", "sequence_id"]
    newest = scores.groupBy(*keys).agg(F.max("date_uploaded").alias("_newest"))
    joined = join_latest(scores, newest, keys)
    return joined.filter("date_uploaded = _newest").drop("_newest")


def in_order(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows as a series reads them: by month, sequence and date, ids last for a total order."""
    ids = [c for c in ("metadata_id", "pid") if c in scores.columns]
    return scores.orderBy(*(by or []), "ym", "sequence_id", "date_uploaded", *ids)


def monthly_means(scores: DataFrame, by: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Mean of each metric over the latest versions of every month.

    A null value makes its month's mean null. Same rows as ``latest_versions``,
    folded in three combining aggregations: totals per version date, the newest
    date's totals per sequence, and their sum per month.
    """
    by = by or []
    metrics = metrics or list(METRICS)
    per_date = scores.groupBy(*by, "ym", "sequence_id", "date_uploaded").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(f"s_{m}") for m in metrics],
        *[F.count(m).alias(f"n_{m}") for m in metrics],
    )
    totals = ["n", *[f"s_{m}" for m in metrics], *[f"n_{m}" for m in metrics]]
    # date_uploaded leads the struct, so its maximum is the newest date's totals.
    newest = per_date.groupBy(*by, "ym", "sequence_id").agg(
        F.max(F.struct("date_uploaded", *totals)).alias("t")
    )
    return newest.groupBy(*by, "ym").agg(
        F.sum("t.n").alias("n"),
        *[
            F.when(F.sum(f"t.n_{m}") == F.sum("t.n"), F.sum(f"t.s_{m}") / F.sum("t.n")).alias(m)
            for m in metrics
        ],
    )


def cumulative_means(monthly: DataFrame, by: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Running mean of the monthly means; a null month makes all later months null.

    The input is one row per month (and ``by`` key), so the window is small.
    """
    metrics = metrics or list(METRICS)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)

    def running(m: str) -> Column:
        return F.when(F.count(m).over(w) == F.count(F.lit(1)).over(w), F.avg(m).over(w))

    return monthly.withColumns({f"{m}c": running(m) for m in metrics})


def scores_long(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per month and metric, with the metric's label."""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    long = series.unpivot([*(by or []), "ym"], list(LABELS), "metric", "mean")
    return long.withColumn("metric", names[F.col("metric")])


def monthly_series(long: DataFrame) -> DataFrame:
    return long.filter(F.col("metric").isin(MONTHLY))


def cumulative_series(long: DataFrame) -> DataFrame:
    return long.filter(F.col("metric").isin(CUMULATIVE))


def overall_means(long: DataFrame) -> DataFrame:
    """Mean of the monthly means, nulls left out, with its legend label."""
    means = monthly_series(long).groupBy("metric").agg(F.avg("mean").alias("mean"))
    return means.withColumn("label", S.percent_label(F.col("metric"), F.col("mean")))


def last_cumulative(long: DataFrame) -> DataFrame:
    """Value of the latest month per cumulative metric."""
    return (
        cumulative_series(long)
        .groupBy("metric")
        .agg(F.max("ym").alias("ym"), F.max_by("mean", "ym").alias("mean"))
    )


def axis_unit(long: DataFrame) -> DataFrame:
    """Year span of a series and the unit of its time axis."""
    lo, hi = F.year(F.min("ym")), F.year(F.max("ym"))
    return monthly_series(long).agg(
        lo.alias("min_year"), hi.alias("max_year"), F.when(lo == hi, "Month").otherwise("Year").alias("axis")
    )


def collection_report(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Score rows to the long monthly and cumulative series."""
    monthly = monthly_means(with_month(scores), by)
    return scores_long(cumulative_means(monthly, by), by)
