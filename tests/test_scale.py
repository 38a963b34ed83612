"""Plans and layouts by which work is divided."""

import pyarrow as pa
from pyspark.sql import functions as F

from qualityspark import schemas
from qualityspark.operators import lookups as L
from qualityspark.plans import QUERIES, Tables, files, load, streams
from qualityspark.session import configure, scratch_path, scratch_root
from qualityspark.sources import definitions as D

load()


def _plan(df, name="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), name)().toString()


def test_batches_of_bodies_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    bodies = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("body"))
    assert max(r.size for r in bodies.mapInArrow(sizes, "size long").collect()) < 8 << 20


def test_batches_of_an_arrow_udf_are_bounded(spark):
    """The reader is such a function: of one task's bodies it gets 4 MB at a time, whatever the session had before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @F.arrow_udf("long")
    def size(bodies: pa.Array) -> pa.Array:
        return pa.array([bodies.nbytes] * len(bodies), pa.int64())

    spark.conf.set(name, "64m")
    try:
        configure(spark)
        bodies = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("body"))
        assert bodies.select(size("body").alias("size")).agg(F.max("size")).first()[0] < 8 << 20
    finally:
        spark.conf.set(name, "4m")


def test_queries_bound_the_batches_that_the_reader_gets(spark, tmp_path):
    """Whatever the session had before: ``score_rows`` reads its bodies in batches of 4 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = F.concat_ws(" ", "id", F.repeat(F.lit("word "), 10))
    texts = spark.range(20).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length(text).alias("n_chars"))
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(name, "64m")
    try:
        assert QUERIES["score_rows"](spark, str(tmp_path)).count() == 20
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, "4m")


def test_definitions_are_parsed_once(spark):
    texts = spark.createDataFrame(
        [("1", "<check><id>a</id><name>x</name></check>"), ("2", "<check><id>a</id><name>y</name></check>"), ("3", "<check><id>"), ("4", None), ("5", "<check><name>z</name></check>")],
        "path string, value string",
    )
    read = D.definitions(texts, schemas.CHECK_XML)
    assert [(r.id, r["name"]) for r in read.collect()] == [("a", "y")]
    assert _plan(read).count("from_xml(") == 1


def test_files_do_not_move_by_their_type(spark):
    rows = spark.range(1000).select("id", F.lit("Text/CSV").alias("media_type"))
    types = spark.createDataFrame([("text/csv", "csv")], "name string, extension string")
    found = L.extension_of(rows, types)
    assert "SortMergeJoin" not in _plan(found, "executedPlan")
    assert found.filter("extension = 'csv'").count() == 1000


def test_a_batch_is_several_files(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("doc_id")).write.parquet(str(tmp_path / "numbers.parquet"))
    stream = streams._stream(Tables(spark, str(tmp_path)), "numbers", "doc_id", copies=2)
    assert stream.isStreaming
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/numbers-files-*/*.parquet")
    found = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm)
    assert len(found) > 4
    assert spark.read.parquet(f"{scratch_root(spark)}/numbers-files-*").count() == 800


def test_files_are_written_by_all_cores(spark):
    path = scratch_path(spark, "written")
    files._write(spark.range(64).select(F.lit("x").alias("top"), F.col("id").alias("pid"), F.lit("v").alias("value")), path)
    names = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), "part-(\\d+)", 1).alias("task"))
    assert names.count() == 64 and names.distinct().count() > 4
