"""File scans and sinks."""

from pyspark.sql import functions as F

from qualityspark.operators import checks as C
from qualityspark.operators.harvest import task_params
from qualityspark.operators.lookups import with_sysmeta
from qualityspark.operators.suite import explode_results, run_suite
from qualityspark.sinks import writers as W
from qualityspark.sources import definitions as D
from qualityspark.sources import documents as S
from qualityspark.streaming.requests import file_stream

CHECK = """<?xml version="1.0"?>
<k:check xmlns:k="urn:q/{v}"><id>notes.long</id><name>Notes</name><type>Reusable</type><level>REQUIRED</level>
<environment>other</environment><code><![CDATA[ return 1 < 2 ]]></code>
<selector><name>notes</name><xpath>/book/part/notes</xpath></selector>
<selector namespaceAware="true"><name>notes</name><expression syntax="json-path">.remarks</expression></selector>
<dialect><name>books</name><xpath>boolean(/*[local-name() = 'book'])</xpath></dialect></k:check>"""
SUITE = """<k:suite xmlns:k="urn:q/v1"><id>shelf.1</id><name>Shelf</name>
<check><id>notes.long</id><level>OPTIONAL</level></check><!-- <check><id>left.out</id></check> --><check><id>not.there</id><type>Accessible</type></check></k:suite>"""


def test_definitions(spark, tmp_path):
    checks, suites = tmp_path / "checks", tmp_path / "suites"
    checks.mkdir(), suites.mkdir()
    (checks / "a.xml").write_text(CHECK.format(v="v1").replace("Notes", "Old"))
    (checks / "b.xml").write_text(CHECK.format(v="v1.1"))
    (checks / "c.xml").write_text("<check><id>broken")
    (suites / "s.xml").write_text(SUITE)
    read = D.read_checks(spark, [str(checks)], "urn:q")
    assert [(r.id, r.name) for r in read.collect()] == [("notes.long", "Notes")]
    assert D.corrupt_definitions(spark, [str(checks)]).count() == 1
    suite = D.read_suites(spark, [str(suites)])
    assert [(r.check_id, r.type_override, r.level_override) for r in D.suite_references(suite).orderBy("position").collect()] == [
        ("notes.long", None, "OPTIONAL"),
        ("not.there", "Accessible", None),
    ]
    registry = C.Registry(D.check_objects(read, {"notes.long": C.min_words("notes", 2)}))
    docs = spark.createDataFrame(
        [("x", "book", "<book><part><notes>two words</notes></part></book>"), ("j", "x/json", '{"remarks":"one"}'), ("o", "other", "<leaflet/>")],
        "pid string, format_id string, body string",
    )
    rows = explode_results(run_suite(docs, D.suite_objects(suite)[0], registry)).collect()
    got = {(r.pid, r.check_id): (r.status, r.level) for r in rows}
    assert got["x", "notes.long"] == ("SUCCESS", "OPTIONAL") and got["j", "notes.long"] == ("FAILURE", "OPTIONAL")
    assert got["o", "notes.long"][0] == "SKIP" and got["x", "not.there"][0] == "SKIP"


def test_version_normalisation(spark):
    texts = ['xmlns:m="urn:q/v1"', 'xmlns:m="urn:q/v1.1" x="urn:q/v1.1 a.xsd"', 'xmlns:m="urn:q/v1.2"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(D.normalize_version(F.col("t"), "urn:q")).collect()]
    assert got == ['xmlns:m="urn:q/v1.2"', 'xmlns:m="urn:q/v1.2" x="urn:q/v1.2 a.xsd"', 'xmlns:m="urn:q/v1.2"']


def test_task_table(spark, tmp_path):
    path = tmp_path / "tasks.csv"
    path.write_text(
        'task-type,task-name,task-group,cron-schedule,params\n# left for later, "for now"\n'
        'quality,night,nodes,0 30 2 * * ?,"^book.*|^leaflet.*;shelf.1;urn:node:ONE;2022-03-04T05:06:07.008Z;7;250;"\n'
        'score,weekly,folders,0 0 3 ? * 1,"*shelf*;shelf.1;urn:node:ONE;2022-03-04T00:00:00.000Z;1;40;folder"\nnodelist,who,nodes,x,urn:node:CN\n'
    )
    q, s, n = task_params(D.read_tasks(spark, str(path))).collect()
    assert (q.format_filter, q.suite_id, q.node_id, q.count_requested) == ("^book.*|^leaflet.*", "shelf.1", "urn:node:ONE", 250)
    assert s.request_type == "folder" and n.node_id == "urn:node:CN" and n.suite_id is None


def test_dimension_files(spark, tmp_path):
    media, formats = tmp_path / "m.csv", tmp_path / "f.csv"
    media.write_text('"name","extension"\ntext/csv,csv\n')
    formats.write_text('"FormatName", "Format-Id", "Media-Type", "File-Extension", "isProprietary"\n"A, 1", http://a, text/xml, xml, N\n')
    assert tuple(D.read_media_types(spark, str(media)).first()) == ("text/csv", "csv")
    row = D.read_formats(spark, str(formats)).first()
    assert (row.format_name, row.format_id, row.proprietary) == ("A, 1", "http://a", False)


def test_document_files(spark, tmp_path):
    for d in ("in", "out"):
        (tmp_path / d / "deep").mkdir(parents=True)
        (tmp_path / d / "deep" / "a.xml").write_text("<a>\n<b/></a>")
    docs = S.text_documents(spark, str(tmp_path / "in"), "*.xml")
    assert [r.body for r in docs.collect()] == ["<a>\n<b/></a>"]
    staged = S.staged_files(spark, str(tmp_path), ["in"], "*.xml")
    assert staged.count() == 1 and staged.first()["length"] == 12


def test_results_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("pid,datasource,check_id,type,level,status\na,n,c,data,REQUIRED,SKIP\n")
    r = D.read_results_csv(spark, str(path)).first()
    assert (r.type_rank, r.level_rank, r.status_rank) == (2, 3, 3)


def test_score_csv(spark, tmp_path):
    rows = spark.sql(
        "SELECT 'a,\"1' metadata_id, 'eml' metadata_format_id, TIMESTAMP '2020-01-02 03:04:05.006' date_uploaded, 'n' datasource, 0.5D score_overall,"
        " 0.1D score_findable, CAST(NULL AS DOUBLE) score_accessible, 1D score_interoperable, 0D score_reusable, CAST(NULL AS STRING) obsoletes,"
        " 'b' obsoleted_by, 's' sequence_id"
    )
    W.write_score_csv(rows, str(tmp_path / "scores"))
    back = D.read_score_csv(spark, str(tmp_path / "scores")).first()
    assert back.pid == 'a,"1' and back.scoreAccessible is None and back.obsoletedBy == "b"
    assert back.dateUploaded.isoformat() == "2020-01-02T03:04:05.006000"


def test_versioned_write(spark, tmp_path):
    W.write_version(spark.range(3), str(tmp_path), "v1")
    path = W.write_version(spark.read.parquet(str(tmp_path / "v1")).filter("id > 0"), str(tmp_path), "v2")
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(str(tmp_path / "v1")).count() == 3


def test_bucketed_documents_join_without_a_shuffle(spark, tmp_path):
    docs = spark.range(100).selectExpr("CAST(id AS STRING) pid", "'eml' format_id", "'<a/>' body")
    meta = spark.range(100).selectExpr("CAST(id AS STRING) identifier", "'me' rights_holder")
    W.write_bucketed(docs, "b_docs", ["pid"], 4, str(tmp_path / "docs"))
    W.write_bucketed(meta, "b_meta", ["identifier"], 4, str(tmp_path / "meta"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_sysmeta(spark.table("b_docs"), spark.table("b_meta"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_docs")
        spark.sql("DROP TABLE b_meta")


def test_streamed_files_are_taken_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, "id bigint")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))
