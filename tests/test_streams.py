"""Streams and their stored batches: late, repeated and out-of-order rows, states over a restart, timers."""

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qualityspark.functions import xpaths
from qualityspark.operators.merge import last_per_key, merge_runs, partial_update, upsert
from qualityspark.sinks.batches import BatchTable
from qualityspark.streaming import requests as R
from qualityspark.streaming import states as S

SHAPE = "k string, v long"
DDL = StructType.fromDDL


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def total(both):
    return both.groupBy("k").agg(F.sum("v").alias("v"))


def test_batches_add_up_and_repeat(spark, tmp_path):
    kept = BatchTable(spark, str(tmp_path / "table"), DDL(SHAPE), total)
    assert rows(kept.read()) == []
    batch = lambda *r: spark.createDataFrame(list(r), SHAPE)
    kept.write(batch(("a", 1), ("b", 2), (None, 7)), 0)
    kept.write(batch(("a", 10)), 1)
    kept.write(batch(("a", 10)), 1)  # the same batch delivered again
    assert rows(kept.read().filter("k IS NOT NULL")) == [("a", 11), ("b", 2)]
    kept.write(batch(), 2)
    kept.write(batch(("c", 3)), 3)
    assert rows(kept.read().filter("k IS NOT NULL")) == [("a", 11), ("b", 2), ("c", 3)]
    assert kept.read().filter("k IS NULL").first().v == 7
    assert rows(kept.read(before=1).filter("k IS NOT NULL")) == [("a", 1), ("b", 2)]
    settled = kept.settle(str(tmp_path / "settled"))
    settled.write(batch(("c", 1)), 4)
    assert rows(settled.read().filter("k IS NOT NULL")) == [("a", 11), ("b", 2), ("c", 4)]
    assert [p.name for p in (tmp_path / "settled").iterdir() if p.is_dir()] and settled.rows().select("batch").distinct().count() == 2


def source(spark, folder, shape):
    return spark.readStream.schema(DDL(shape)).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(folder)


def files(spark, folder, shape, *batches, start=0):
    for i, batch in enumerate(batches, start):
        spark.createDataFrame(batch, shape).coalesce(1).write.parquet(f"{folder}/{i}")
    return lambda: source(spark, folder, shape)


def at(hour, day=1):
    return datetime(2024, 1, day, hour)


REQUESTS = "event_id long, pid string, suite_id string, ts timestamp, status string"
CHANGES = "pid string, suite_id string, kind string, status string, error string, run_count long, events long, ts timestamp"


def test_late_and_repeated_requests_count_once(spark, tmp_path):
    old = (3, "p", "s", at(1), "processing")
    batches = [[(1, "p", "s", at(9, 5), "processing")], [(2, "q", "s", at(10, 5), "success"), (1, "p", "s", at(9, 5), "processing")], [old], [old, (4, "p", "s", at(2, 5), "failure")]]
    stream = files(spark, str(tmp_path / "in"), REQUESTS, *batches)
    kept = BatchTable(spark, str(tmp_path / "out"), DDL(REQUESTS), R.first_per_key(["event_id"], ["ts"]))
    R.store(stream(), kept, str(tmp_path / "state")).awaitTermination()
    assert [r[0] for r in rows(kept.read())] == [1, 2, 3, 4]


def test_states_go_on_after_a_restart(spark, tmp_path):
    """A run's count and last event come from the state store: late events add up, also those behind a restart."""
    folder, table = str(tmp_path / "in"), BatchTable(spark, str(tmp_path / "out"), DDL(CHANGES), None)
    files(spark, folder, REQUESTS, [(1, "p", "s", at(9, 5), "processing")], [(2, "p", "s", at(1), "processing"), (3, "p", "s", at(2), "success")])
    go = lambda: R.state_stream(source(spark, folder, REQUESTS), table, str(tmp_path / "state"), limit=3, now=0).awaitTermination()
    found = lambda: {r.pid: (r.status, r.run_count, r.events, r.ts) for r in S.newest(table.rows(), "state").collect()}
    go()
    assert found() == {"p": ("processing", 2, 3, at(9, 5))}
    many = [(10 + i, "q", "s", at(i), "processing") for i in range(4)]
    files(spark, folder, REQUESTS, [(4, "q", "s", at(1), "success"), *many], [(5, "p", "s", at(8, 5), "success"), (6, "p", "s", at(9, 5), "failure")], start=2)
    go()
    assert found() == {"p": ("failure", 2, 5, at(9, 5)), "q": ("failure", 4, 5, at(3))}
    errors = {r.pid: r.error for r in S.newest(table.rows(), "state").collect()}
    assert errors == {"p": None, "q": "Run has been attempted 3 times, aborting."}


def test_timers_ask_again_for_stuck_runs(spark, tmp_path):
    """By a clock set by hand: only runs whose last event is an old start, and a later event takes the request back."""
    now = int(datetime(2024, 1, 10, tzinfo=timezone.utc).timestamp()) * 1_000_000
    batches = [
        [(1, "old", "s", at(1), "processing"), (2, "fresh", "s", at(13, 9), "processing"), (3, "done", "s", at(1), "success"), (4, "late", "s", at(1), "processing"), (5, "edge", "s", at(12, 9), "processing")],
        [(6, "late", "s", at(2), "success"), (7, "often", "s", at(3), "processing"), (8, "often", "s", at(4), "processing")],
    ]
    stream = files(spark, str(tmp_path / "in"), REQUESTS, *batches)
    table = BatchTable(spark, str(tmp_path / "out"), DDL(CHANGES), None)
    R.state_stream(stream(), table, str(tmp_path / "state"), limit=2, now=now).awaitTermination()
    again = {r.pid: (r.run_count, r.status, r.error, r.ts) for r in S.newest(table.rows(), "request").collect()}
    clock = datetime(2024, 1, 10)
    assert again == {"old": (2, "processing", None, clock), "often": (3, "failure", "Run has been attempted 2 times, aborting.", clock)}
    # The request for the late one was given, until its end was heard of.
    assert table.rows().filter("kind = 'request' AND pid = 'late'").count() == 1


def test_runs_share_a_bucket(spark, tmp_path):
    """The store is asked per bucket, not per run; states, requests and timers of its runs stay their own."""
    now = int(datetime(2024, 1, 10, tzinfo=timezone.utc).timestamp()) * 1_000_000
    first = [(i, None if i == 7 else f"p{i}", "s", at(1 + i % 2), "processing" if i % 3 else "success") for i in range(300)]
    second = [(300 + i, f"p{i}", "s", at(3), "success") for i in range(100)] + [(400, None, "s", at(4), "processing")]
    stream = files(spark, str(tmp_path / "in"), REQUESTS, first, second)
    table = BatchTable(spark, str(tmp_path / "out"), DDL(CHANGES), None)
    done = R.state_stream(stream(), table, str(tmp_path / "state"), limit=1, now=now, buckets=4)
    done.awaitTermination()
    # At most a value, and a timer in two orders, for each bucket.
    assert sum(s["numRowsTotal"] for s in done.lastProgress["stateOperators"]) <= 12
    found = {r.pid: (r.status, r.run_count, r.events) for r in S.newest(table.rows(), "state").collect()}
    wanted = {f"p{i}": ("success" if i < 100 or not i % 3 else "processing", int(i % 3 > 0), 1 + (i < 100)) for i in range(300) if i != 7}
    assert found == wanted | {"p7": ("success", 0, 1), None: ("failure", 2, 2)}
    asked = table.rows().filter("kind = 'request'").groupBy("pid").count().collect()
    assert {r.pid: r["count"] for r in asked} == {None if i == 7 else f"p{i}": 1 for i in range(300) if i % 3}


def test_hours_take_late_rows(spark, tmp_path):
    batches = [[(1, "p", "s", at(9, 5), "processing")], [(2, "p", "s", at(1), "processing"), (3, "p", "s", at(2), "success")], [(4, "q", "s", at(1), "success")]]
    stream = files(spark, str(tmp_path / "in"), REQUESTS, *batches)
    hours = BatchTable(spark, str(tmp_path / "hours"), DDL("hour timestamp, n long, total long"), R.hourly_fold)
    done = stream().filter("status = 'success'").withColumn("elapsed", F.col("event_id"))
    R.hourly_stream(done, hours, str(tmp_path / "hour-state")).awaitTermination()
    assert rows(hours.read()) == [(at(1), 1, 4), (at(2), 1, 3)]


def test_merges_read_the_stored_table_once(spark, tmp_path):
    shape = "metadata_id string, suite_id string, ts timestamp, status string, error string, sequence_id string, is_latest boolean, run_count int"
    spark.createDataFrame([("a", "s", at(1), "old", None, None, True, 4)], shape).write.parquet(str(tmp_path / "runs"))
    spark.createDataFrame([("a", "s", at(2), "new", None, "x", False, 9), ("b", "s", at(2), "new", None, None, False, 9)], shape).write.parquet(str(tmp_path / "saved"))
    runs, saved = spark.read.parquet(str(tmp_path / "runs")), spark.read.parquet(str(tmp_path / "saved"))
    merged = [
        merge_runs(runs, saved, F.expr("TIMESTAMP '2024-02-02'")),
        upsert(runs, saved, ["metadata_id", "suite_id"], ["ts"]),
        partial_update(runs, saved, ["metadata_id", "suite_id"], ["status"]),
    ]
    for df in merged:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2
    first = {r.metadata_id: (r.status, r.run_count, r.ts) for r in merged[0].collect()}
    assert first == {"a": ("new", 9, datetime(2024, 2, 2)), "b": ("new", 1, datetime(2024, 2, 2))}
    assert [(r.metadata_id, r.status, r.run_count) for r in merged[2].collect()] == [("a", "new", 4)]


def test_equal_times_go_by_the_other_columns(spark):
    tied = spark.createDataFrame([("a", 1, "x", None), ("a", 1, "z", 2), ("a", 1, "y", 3)], "k string, t long, v string, w long")
    assert {last_per_key(tied.repartition(n), ["k"], ["t"]).first().v for n in (1, 2, 3, 5)} == {"z"}


XML = """<r xmlns:g="u"><a x="1">one<b>B</b>tail</a><a x="2">two</a><c><a x="1">three</a></c><k t="Abstract">abs</k><k>no</k><g:z>ns</g:z></r>"""


def test_node_sets():
    from xml.etree import ElementTree

    top = xpaths.tree(ElementTree.fromstring(XML))
    found = lambda x, prefixes=None: [n.text() for n in xpaths.Evaluator(top, prefixes).nodes(xpaths.parse(x))]
    cases = {
        '//a[@x="1"]': ["oneBtail", "three"],
        "(//a)[last()]": ["three"],
        "//a/following-sibling::a": ["two"],
        "/r/./a/..//b": ["B"],
        "//k[not(@t)]": ["no"],
        '//a[b="B" or @x=2]': ["oneBtail", "two"],
        "//a[position()>1]": ["two"],
        "/r/a/text()": ["one", "tail", "two"],
        '/r/c/a[starts-with(.,"th")] | //b': ["B", "three"],
        "//a[count(b)=1]": ["oneBtail"],
        "//b/ancestor::r/k[1]": ["abs"],
        "//k[string-length(@t) > 3 and contains(., 'b')]": ["abs"],
        "/r/nothing[1]": [],
    }
    for path, texts in cases.items():
        assert found(path) == texts, path
    assert found("//g:z", {"g": "u"}) == ["ns"] and found("//z", {}) == [] and found("//z") == ["ns"]
    for bad in ("//a[", "foo(", "/", "//a[@x=]", "1+1", "//a[nosuch()]", "//a[not()]", "//a]"):
        try:
            xpaths.parse(bad)
        except xpaths.Refused:
            continue
        raise AssertionError(bad)
