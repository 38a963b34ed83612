"""Request streams: assessment, run states, monitoring, totals, relinking.

What arrives late, twice or out of order counts exactly as in time: nothing is
dropped by age. Run states are kept by a stateful operator (``streaming.states``);
all else is reduced by key, written batch by batch and folded when it is read.
Both combine before the shuffle, so a document requested very often costs no
more than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityspark.operators.checks import Registry, Suite
from qualityspark.operators.merge import last_per_key
from qualityspark.operators.runs import RUN_LIMIT, STUCK_HOURS
from qualityspark.operators.sequences import KEY, assign_sequence, walk_back
from qualityspark.operators.suite import run_suite
from qualityspark.sinks.batches import BATCH, BatchTable
from qualityspark.streaming.states import BUCKETS, run_states


def file_stream(spark: SparkSession, folder: str, schema, name: str | None = None, per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint is the high-water mark."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_batch))
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every batch to ``merge(batch, batch_id)``, which must not mind a repeated one."""
    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def first_per_key(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps of several rows with one key the first in ``order``."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*order, BATCH)]
        first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
        return first.select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns if c != BATCH])

    return fold


def last_row(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Keeps of several rows with one key the last in ``order``."""
    return lambda rows: last_per_key(rows, keys, order)


def store(rows: DataFrame, table: BatchTable, checkpoint: str):
    """Fold each batch by itself and write it; the table's reads fold all of them.

    What a queue delivers several times counts once, whenever that is.
    """
    return each_batch(rows, lambda batch, number: table.write(table.fold(batch.withColumn(BATCH, F.lit(number).cast("long"))), number), checkpoint)


def assess_stream(docs: DataFrame, suite: Suite, registry: Registry, table: BatchTable, checkpoint: str):
    """Stream of documents to a table of runs, one per document and suite.

    ``docs`` has a ``requested`` time; a document asked for again replaces its
    run. ``table`` holds the columns of ``run_suite`` and ``requested``. Each
    batch is reduced to the last request of a document before it is assessed.
    """

    def assess(batch: DataFrame, number: int) -> None:
        latest = last_per_key(batch, ["pid"], ["requested"])
        times = latest.select("pid", "requested")
        table.write(run_suite(latest.drop("requested"), suite, registry).join(times, "pid"), number)

    return each_batch(docs, assess, checkpoint)


def state_stream(
    requests: DataFrame, table: BatchTable, checkpoint: str, limit: int = RUN_LIMIT, hours: int = STUCK_HOURS, now: int | None = None, buckets: int = BUCKETS
):
    """States of runs as their events arrive, and new requests for stuck ones (``states.run_states``), written batch by batch.

    Reads what there is and ends; overdue timers fire with the batches. For a
    stream that goes on, and fires them without new rows too, write the changes
    with a trigger of your own.
    """
    spark = requests.sparkSession
    changes = run_states(requests, limit, hours, now, buckets)
    writer = changes.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", checkpoint)
    # A stream with timers asks for batches without rows for ever, so one that is to end goes without.
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def hourly_totals(completed: DataFrame, ts: str = "ts", value: str = "elapsed") -> DataFrame:
    """Count and sum of completed runs per hour of event time."""
    return completed.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def hourly_fold(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def hourly_stream(completed: DataFrame, table: BatchTable, checkpoint: str, **columns: str):
    """Hourly totals to which late rows add like any others; ``table`` folds by ``hourly_fold``."""
    return each_batch(completed, lambda batch, number: table.write(hourly_totals(batch, **columns), number), checkpoint)


def with_heads(stored: DataFrame) -> DataFrame:
    """Stored runs with the ``head`` of their chain, as relinking takes them; runs on or behind a ring have none."""
    return stored.join(walk_back(stored).select(*KEY, "head"), KEY)


def touched(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Stored runs of the chains that arrivals join, by links of either side.

    ``stored`` keeps the ``head`` of its last assignment, so whole chains are
    found by one semi join instead of another walk. Runs without a head are few
    and always come along.
    """
    to = lambda column: arrived.select("suite_id", F.col(column).alias("pid"))
    behind = stored.join(to("obsoletes").unionByName(to("obsoleted_by")), KEY, "left_semi")
    named = [stored.join(to("pid").withColumnRenamed("pid", c), ["suite_id", c], "left_semi") for c in ("obsoletes", "obsoleted_by")]
    heads = behind.unionByName(named[0].select(*stored.columns)).unionByName(named[1].select(*stored.columns)).select("suite_id", "head")
    joined = stored.join(heads, ["suite_id", "head"], "left_semi").select(*stored.columns)
    return joined.unionByName(stored.filter("head IS NULL"))


def relink(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Sequence ids after arrivals: only chains they touch are walked again."""
    columns = ["suite_id", "pid", "obsoletes", "obsoleted_by", "sequence_id"]
    old = touched(stored, arrived).select(*columns)
    return assign_sequence(old.join(arrived.select(*KEY), KEY, "left_anti").unionByName(arrived.select(*columns)))


def relink_stream(arrivals: DataFrame, table: BatchTable, checkpoint: str):
    """Keep sequence ids up to date as runs arrive.

    ``table`` holds ``suite_id, pid, obsoletes, obsoleted_by, given_id,
    sequence_id, head``, of which a read takes the last batch's row. Every batch
    walks the chains it touches and writes the runs in them. Walks start from
    the ids that runs came with (``given_id``), so the ids do not depend on the
    order of arrival; one that was only derived may change when an earlier
    version arrives.
    """
    links = [*KEY, "obsoletes", "obsoleted_by"]

    def link(batch: DataFrame, number: int) -> None:
        stored = table.read(before=number).withColumn("sequence_id", F.col("given_id"))
        found = relink(stored, batch).select(*KEY, "sequence_id", "head")
        given = F.col("sequence_id").alias("given_id")
        kept = stored.join(batch.select(*KEY), KEY, "left_anti").select(*links, given)
        table.write(kept.unionByName(batch.select(*links, given)).join(found, KEY), number)

    return each_batch(arrivals, link, checkpoint)
