"""Streams over the tables' files, read to their end in several batches.

Each table is first dealt over files by a hash, so every batch holds rows of all
times and each next one comes late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qualityspark.operators import scores as O
from qualityspark.operators import sequences as Q
from qualityspark.plans import documents as D
from qualityspark.plans import query
from qualityspark.plans.sequences import _WALK
from qualityspark.plans.stores import RUN_STATES
from qualityspark.plans.views import REQUESTS, chain, requests, with_views
from qualityspark.session import scratch_path
from qualityspark.sinks.batches import BATCH, BatchTable
from qualityspark.streaming import requests as R
from qualityspark.streaming import states as S

_KEYS = ["pid", "suite_id"]
_BATCHES = 4


def _stream(t, name: str, key: str, copies: int = 1):
    """A table as a stream of ``_BATCHES`` batches, rows dealt by a hash; with ``copies``, each row in several of them.

    A batch is as many files as a shuffle has partitions for it, so no task writes or reads a whole batch.
    """
    files = max(1, int(t.spark.conf.get("spark.sql.shuffle.partitions")) // _BATCHES)
    rows = t(name).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    batch = F.pmod(F.xxhash64(key) + F.col("_copy"), F.lit(_BATCHES))
    dealt = rows.withColumn("_file", batch * files + F.pmod(F.hash(key), F.lit(files)))
    folder = scratch_path(t.spark, f"{name}-files")
    dealt.repartitionByRange(_BATCHES * files, "_file").drop("_copy", "_file").write.parquet(folder)
    return R.file_stream(t.spark, folder, t(name).schema, per_batch=files)


def _requests(t, copies: int = 1):
    return _stream(t, "events", "event_id", copies).selectExpr(*REQUESTS)


def _table(t, name: str, schema: StructType, fold) -> BatchTable:
    return BatchTable(t.spark, scratch_path(t.spark, f"{name}-table"), schema, fold)


def _finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def _changes(t, now: int | None = None) -> DataFrame:
    """All changes of the run states; the store of states lies outside the heap."""
    events = _requests(t)
    keys = [events.schema[k] for k in _KEYS]
    shape = StructType([*keys, *StructType.fromDDL("kind string, status string, error string, run_count long, events long, ts timestamp").fields])
    table = _table(t, "run-state", shape, None)
    _finish(R.state_stream(events, table, scratch_path(t.spark, "run-state"), now=now))
    return table.rows()


@query("stream_run_state", with_views("requests_v") + RUN_STATES)
def stream_run_state(t):
    """State of every run after all batches."""
    return S.newest(_changes(t), "state")


_NOW = "TIMESTAMP '2024-01-30 20:00:00'"


@query(
    "stream_monitor",
    with_views("requests_v")
    + f"""SELECT pid, suite_id, run_count + 1 AS run_count, CASE WHEN run_count + 1 > 10 THEN 'failure' ELSE 'processing' END AS status, {_NOW} AS ts
        FROM ({RUN_STATES}) WHERE status = 'processing' AND ts < {_NOW} - INTERVAL 12 HOUR""",
)
def stream_monitor(t):
    """Timers of runs that are stuck at a time of the clock give new requests with their count."""
    now = t.spark.range(1).select(S.micros(F.expr(_NOW))).first()[0]
    return S.newest(_changes(t, now), "request").select("pid", "suite_id", "run_count", "status", "ts")


@query(
    "stream_hourly",
    with_views("requests_v")
    + "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(elapsed), 4) AS total FROM requests_v WHERE status = 'success' GROUP BY ALL",
)
def stream_hourly(t):
    """Hours that several batches add to."""
    done = requests(t).filter("status = 'success'")
    table = _table(t, "hourly", R.hourly_totals(done).schema, R.hourly_fold)
    _finish(R.hourly_stream(_requests(t).filter("status = 'success'"), table, scratch_path(t.spark, "hourly")))
    return table.read().withColumn("total", F.round("total", 4))


@query("stream_redelivery", with_views("requests_v") + "SELECT event_id, pid, suite_id, ts FROM requests_v")
def stream_redelivery(t):
    """Every request delivered in two batches is taken once, the oldest too."""
    columns = ["event_id", "pid", "suite_id", "ts"]
    table = _table(t, "requests", requests(t).select(*columns).schema, R.first_per_key(["event_id"], ["ts"]))
    _finish(R.store(_requests(t, copies=2).select(*columns), table, scratch_path(t.spark, "requests")))
    return table.read()


@query("stream_assess", f"WITH {D.RESULTS} {D._COUNTS}")
def stream_assess(t):
    """Documents streamed to runs, some of them twice; one run each, with the scores of the batch run."""
    files = _stream(t, "documents", "doc_id", copies=2)

    class Streamed:
        spark = t.spark

        def __call__(self, name):
            return files

    docs = D.documents(Streamed()).withColumn("requested", F.current_timestamp())
    runs = D.suite_runs(t).withColumn("requested", F.current_timestamp())
    table = _table(t, "runs", runs.schema, R.last_row(_KEYS, ["requested"]))
    _finish(R.assess_stream(docs, D.SUITE, D.REGISTRY, table, scratch_path(t.spark, "runs")))
    done = table.read().filter("run_status = 'success'").drop("sysmeta", "requested")
    return O.score_arrays(done).drop("suite_id", "run_status", "error_description", "results")


@query(
    "stream_merge",
    with_views("requests_v").rstrip()
    + """, stored AS (SELECT user_id AS pid, 'suite-1' AS suite_id, 'stored' AS status, TIMESTAMP '2024-01-15 00:00:00' AS ts, CAST(-1 AS BIGINT) AS event_id
            FROM events GROUP BY user_id)
        SELECT pid, suite_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM (
            SELECT pid, suite_id, status, ts, event_id FROM requests_v UNION ALL SELECT * FROM stored) GROUP BY pid, suite_id""",
)
def stream_merge(t):
    """Batches merged into a filled table, in which rows older than the stored ones change nothing."""
    columns = [*_KEYS, "status", "ts", "event_id"]
    table = _table(t, "merge", requests(t).select(*columns).schema, R.last_row(_KEYS, ["ts", "event_id"]))
    first = requests(t).select("pid").distinct().selectExpr(
        "pid", "'suite-1' AS suite_id", "'stored' AS status", "TIMESTAMP '2024-01-15 00:00:00' AS ts", "CAST(-1 AS BIGINT) AS event_id"
    )
    table.write(first, -1)
    _finish(R.store(_requests(t).select(*columns), table, scratch_path(t.spark, "merge")))
    return table.read().select(*_KEYS, "status", "ts")


@query("stream_relink", _WALK + "SELECT pid, coalesce(chain_id, c.sequence_id) AS sequence_id FROM chain_v c LEFT JOIN walk USING (pid) LEFT JOIN ids USING (head)")
def stream_relink(t):
    """Runs arrive in any order; at the end every run has the id of a walk over all."""
    runs = chain(t)
    folder = scratch_path(t.spark, "chain-files")
    runs.repartitionByRange(3, F.pmod(F.xxhash64("pid"), F.lit(3))).write.parquet(folder)
    arrivals = R.file_stream(t.spark, folder, runs.schema, per_batch=1)
    shape = runs.select(*Q.KEY, "obsoletes", "obsoleted_by", F.col("sequence_id").alias("given_id"), "sequence_id", F.col("pid").alias("head"))
    table = _table(t, "chains", shape.schema, R.last_row(Q.KEY, [BATCH]))
    _finish(R.relink_stream(arrivals, table, scratch_path(t.spark, "chains")))
    return table.read().select("pid", "sequence_id")
