"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of bodies, its texts and its nodes are in a Python worker at once, so its size bounds that worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # Folders of very many files are listed by tasks of some hundred folders each.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Streaming state outside the heap, so its size is not bound by memory.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator here relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "qualityspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: str | None = None
#: Tables at which queries were cut, until they are dropped.
_cuts: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose tasks
    run in the driver's own process may leave it unset; it then gets a folder
    that is deleted with the process.
    """
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="qualityspark-")
        atexit.register(shutil.rmtree, _local_scratch, True)
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    Like a reliable checkpoint it survives the loss of executors; as a Parquet
    table it also keeps column pruning for its readers, its size is known to the
    planner, and ``by`` lets readers skip the rows of other values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    _cuts.append(path)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_of(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Cut what ``build`` returns, and delete the cuts that it made on the way."""
    before = len(_cuts)
    result = cut_lineage(build())
    own = _cuts.pop()
    for path in _cuts[before:]:
        remove(spark, path)
    _cuts[before:] = [own]
    return result


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store it lies in; nothing happens if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def cuts_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the cuts made within, at its end: read or write results before that."""
    before = len(_cuts)
    try:
        yield
    finally:
        for path in _cuts[before:]:
            remove(spark, path)
        del _cuts[before:]
