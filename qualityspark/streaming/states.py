"""Run states and stuck runs as one stateful operator.

The state of a run says how often it was started, and its last event. It lies in
the state store, so a stream that is started again goes on from its checkpoint.
Runs are kept in buckets by a hash of their key: a bucket is read, written and
timed as a whole, so a batch costs a call of the store per bucket, not per run.
The timer of a bucket is that of the first of its runs left processing; when it
fires, the operator itself gives the new requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from qualityspark.operators.runs import LIMIT_MESSAGE, RUN_LIMIT, STUCK_HOURS

KEYS = ["pid", "suite_id"]
_OUT = [*KEYS, "kind", "status", "error", "run_count", "events", "micros"]
_PARTS = ["run_count", "events", "micros", "event_id", "status"]
#: Buckets of runs; some thousand runs in one are well handled.
BUCKETS = 8192


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of one key within a batch of rows as one row, before they are shuffled."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("micros", "ascending"), ("event_id", "ascending"), ("status", "ascending")])
        started = pc.fill_null(pc.equal(rows["status"], "processing"), False).cast(pa.int64())
        last = [(c, "last", pc.ScalarAggregateOptions(skip_nulls=False)) for c in ("micros", "event_id", "status")]
        folded = rows.append_column("started", started).group_by(KEYS, use_threads=False).aggregate([("started", "sum"), ("started", "count"), *last])
        named = folded.select([*KEYS, "started_sum", "started_count", "micros_last", "event_id_last", "status_last"]).rename_columns([*KEYS, *_PARTS])
        yield from named.combine_chunks().to_batches()


class RunStates(StatefulProcessor):
    """Folds the events of a bucket's runs into their states; a timer asks for stuck ones again.

    ``run`` is the shape of a run's state: its key, ``_PARTS``, and the time at
    which it is to be asked for, or null. ``now`` is a clock that stands still,
    in microseconds, for tests; without it timers go by processing time.
    """

    def __init__(self, run: StructType, limit: int, hours: int, now: int | None):
        self.run, self.limit, self.wait, self.now = run, limit, hours * 3_600_000_000, now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", StructType([StructField("timer", LongType()), StructField("runs", ArrayType(self.run))]))

    def _row(self, key, kind: str, status: str, count: int, events: int, micros: int) -> Row:
        failed = count > self.limit
        error = LIMIT_MESSAGE.format(limit=self.limit) if failed else None
        values = (*key, kind, "failure" if failed else status, error, count, events, micros)
        return Row(**dict(zip(_OUT, values, strict=True)))

    def _load(self) -> tuple[int | None, dict[tuple, tuple]]:
        """The bucket's timer, and its runs by key."""
        timer, runs = self.bucket.get() or (None, [])
        return timer, {tuple(run[: len(KEYS)]): tuple(run[len(KEYS) :]) for run in runs}

    def _store(self, runs: dict[tuple, tuple], timer: int | None, timers) -> None:
        """Keep the runs, with a timer for the first that is due in place of the one set before."""
        due = min((run[-1] for run in runs.values() if run[-1] is not None), default=None)
        at = None
        if due is not None and (self.now is None or due < self.now):
            at = due // 1000 + (0 if self.now is None else timers.getCurrentProcessingTimeInMs() - self.now // 1000)
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.bucket.update((at, [(*key, *run) for key, run in runs.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, runs = self._load()
        touched = {}
        for row in rows:
            run = tuple(row[k] for k in KEYS)
            count, events, *last = touched.get(run) or runs.get(run, (0, 0, None, None, None, None))[:-1]
            if last[0] is None or (row.micros, row.event_id, row.status or "") > (last[0], last[1], last[2] or ""):
                last = [row.micros, row.event_id, row.status]
            touched[run] = (count + row.run_count, events + row.events, *last)
        for run, (count, events, micros, event, status) in touched.items():
            waits = status == "processing" and count <= self.limit
            runs[run] = (count, events, micros, event, status, micros + self.wait if waits else None)
            yield self._row(run, "state", status, count, events, micros)
        self._store(runs, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, runs = self._load()
        now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.now is None else self.now
        # Timers go by milliseconds, so all that is due within this one has fired.
        until = now + 1000 if self.now is None else now
        for run, (count, events, micros, event, status, due) in runs.items():
            if due is not None and due < until:
                # Asked for again after the same time, should the new request not be heard of.
                runs[run] = (count, events, micros, event, status, now + self.wait)
                yield self._row(run, "request", status, count + 1, events, now)
        # The timer that fired is gone.
        self._store(runs, None, timerValues)


def run_states(requests: DataFrame, limit: int = RUN_LIMIT, hours: int = STUCK_HOURS, now: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stream of requests (``pid, suite_id, ts, event_id, status``) as a stream of changes.

    Returns ``pid, suite_id, kind, status, error, run_count, events, ts``: the
    state of each run that a batch touched (``kind`` state), and new requests for
    runs that have been processing for more than ``hours`` (``request``), with
    the count of the new attempt; one beyond the limit comes out as a failure.
    Late and repeated events count like any others; events are combined before
    the shuffle, so a run of very many costs its task little. ``buckets`` is the
    number of buckets of runs, which must stay the same over a checkpoint's life.
    """
    timed = requests.select(*KEYS, F.unix_micros("ts").alias("micros"), "event_id", "status")
    keys = [requests.schema[k] for k in KEYS]
    kinds = [LongType(), LongType(), LongType(), requests.schema["event_id"].dataType, StringType()]
    run = StructType([*keys, *(StructField(c, k) for c, k in zip(_PARTS, kinds, strict=True))])
    combined = timed.mapInArrow(_combine, run).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)))
    names = {"kind": StringType(), "status": StringType(), "error": StringType(), "run_count": LongType(), "events": LongType(), "micros": LongType()}
    out = StructType([*keys, *(StructField(c, k) for c, k in names.items())])
    kept = StructType([*run.fields, StructField("due", LongType())])
    changes = combined.groupBy("bucket").transformWithState(RunStates(kept, limit, hours, now), out, "Update", "ProcessingTime")
    return changes.withColumn("ts", F.timestamp_micros("micros")).drop("micros")


def newest(changes: DataFrame, kind: str) -> DataFrame:
    """Of the changes of all batches (with ``batch``), those of one kind in each run's last batch.

    As states: where every run stands. As requests: what is to be submitted
    again, unless a later event has come since.
    """
    rest = [c for c in changes.columns if c not in (*KEYS, "batch")]
    # One row per run and kind and batch, so the last one is a maximum, combined before the shuffle.
    row = F.struct("batch", *(F.when(F.col("kind") == kind, F.col(c)).alias(c) for c in rest))
    of_kind = F.max(F.when(F.col("kind") == kind, row))
    last = changes.groupBy(*KEYS).agg(F.max("batch").alias("newest"), of_kind.alias("row"))
    return last.filter(F.col("row.batch") == F.col("newest")).select(*KEYS, *(F.col(f"row.{c}").alias(c) for c in rest if c != "kind"))


def micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp"))
