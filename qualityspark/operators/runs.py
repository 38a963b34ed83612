"""Stored runs: lookups, stuck runs, attempts, elapsed times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.operators.skew import number_in_order

# Default age of a stuck run, default attempt limit and its message.
STUCK_HOURS = 12
RUN_LIMIT = 10
LIMIT_MESSAGE = "Run has been attempted {limit} times, aborting."


def find_run(runs: DataFrame, metadata_id, suite_id) -> DataFrame:
    return runs.filter((F.col("suite_id") == suite_id) & (F.col("metadata_id") == metadata_id))


def list_ids(table: DataFrame, id_column: str) -> DataFrame:
    return table.select(id_column).distinct()


def in_process(runs: DataFrame, identifiers: DataFrame, now: Column, hours: int = STUCK_HOURS) -> DataFrame:
    """Runs that have been processing for longer than ``hours``, with their data source."""
    stuck = runs.filter(
        (F.lower("status") == "processing") & (F.col("ts") < now - F.make_dt_interval(hours=F.lit(hours)))
    )
    return stuck.join(identifiers, "metadata_id")


def over_limit(run_count: Column, limit: int = RUN_LIMIT) -> Column:
    return run_count > limit


def limit_runs(runs: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """Runs tried more often than the limit become failures with a message."""
    over = over_limit(F.col("run_count"), limit)
    return runs.withColumns(
        {
            "status": F.when(over, "failure").otherwise(F.col("status")),
            "error": F.when(over, LIMIT_MESSAGE.format(limit=limit)).otherwise(F.col("error")),
        }
    )


def attempts(requests: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Attempt number of every request of a document and suite, by time."""
    return number_in_order(requests, keys, ts, tie, "attempt")


def state_parts(events: DataFrame, keys: list[str], merged: bool = False) -> DataFrame:
    """What the state of a run is made of: counts, and its last event.

    From request events, or (``merged``) from several such rows of a key: both
    are sums and a maximum, so parts of any batches add up to the same.
    """
    last = "ts", "event_id", "status"
    started = F.sum("run_count") if merged else F.count_if(F.col("status") == "processing")
    folded = events.groupBy(*keys).agg(
        started.alias("run_count"),
        (F.sum("events") if merged else F.count(F.lit(1))).alias("events"),
        F.max(F.struct(*last)).alias("_last"),
    )
    return folded.select(*keys, "run_count", "events", *[F.col(f"_last.{c}").alias(c) for c in last])


def state_columns(parts: DataFrame, keys: list[str], limit: int = RUN_LIMIT) -> DataFrame:
    limited = limit_runs(parts.withColumn("error", F.lit(None).cast("string")), limit)
    return limited.select(*keys, "status", "error", "run_count", "events", "ts")


def run_states(requests: DataFrame, keys: list[str], limit: int = RUN_LIMIT) -> DataFrame:
    """State of every run after its request events.

    An event starts an attempt (``processing``) or ends one (``success`` or
    ``failure``). The attempt beyond the limit fails the run for good, so the
    state is a fold over a count and a last event, which combines before the
    shuffle whatever the number of events per key.
    """
    return state_columns(state_parts(requests, keys), keys, limit)


def suite_last_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("suite_id").agg(F.max("ts").alias("last_run"))


def elapsed_totals(completed: DataFrame, by: list[Column | str] | None = None) -> DataFrame:
    """Number of completed runs and their total processing seconds."""
    return completed.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("elapsed"))


def top_recent(runs: DataFrame, n: int, tie: str) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def page(df: DataFrame, order: list[str], start: int, rows: int) -> DataFrame:
    """Rows ``start`` to ``start + rows`` in a total order, for a reader's screen."""
    return df.orderBy(*order).offset(start).limit(rows)


def existing_success(runs: DataFrame) -> DataFrame:
    return runs.filter(F.lower("status") == "success")


def congruence(declared: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows found for each data object against the number it declares."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_found"))
    n = F.coalesce("n_found", F.lit(0).cast("bigint"))
    return declared.join(found, key, "left").select(
        key,
        "n_declared",
        n.alias("n_found"),
        F.when(n == F.col("n_declared"), "SUCCESS").otherwise("FAILURE").alias("status"),
    )
