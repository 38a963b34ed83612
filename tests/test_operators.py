"""Operators on small literal inputs."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.operators import checks as C
from qualityspark.operators import collections as K
from qualityspark.operators import harvest as H
from qualityspark.operators import lookups as L
from qualityspark.operators import merge as M
from qualityspark.operators import report as P
from qualityspark.operators import rollup as R
from qualityspark.operators import runs as U
from qualityspark.operators import scores as O
from qualityspark.operators import sequences as Q
from qualityspark.operators.skew import number_in_order
from qualityspark.operators.suite import encode_file_outputs, explode_results, run_check, run_suite
from qualityspark.functions.extract import Selector
from qualityspark.sinks import writers as W


def ts(text):
    return datetime.fromisoformat(text)


SIX = [
    ("r", "check.1", "metadata", "INFO", "FAILURE"),
    ("r", "check.2", "metadata", "OPTIONAL", "SKIP"),
    ("r", "check.3", "metadata", "INFO", "SUCCESS"),
    ("r", "check.4", "metadata", "REQUIRED", "SUCCESS"),
    ("r", "check.5", "metadata", "OPTIONAL", "SUCCESS"),
    ("r", "check.6", "metadata", "OPTIONAL", "SUCCESS"),
]


def results(spark, rows):
    return spark.createDataFrame(rows, "run_id string, check_id string, type string, level string, status string")


def test_six_results(spark):
    r = O.score_runs(results(spark, SIX)).first()
    assert (r.checks_passed, r.checks_warned, r.checks_failed, r.checks_errored, r.checks_info, r.check_count) == (3, 0, 0, 0, 3, 6)
    assert r.score_overall == 1.0
    assert O.score_by_type(results(spark, SIX)).first().score == 1.0


def test_counting_rules(spark):
    rows = [
        ("a", "1", "F", "INFO", "SKIP"),  # counts twice as info
        ("a", "2", "F", "REQUIRED", "ERROR"),  # lowers the score, not a failure
        ("a", "3", "F", None, "SUCCESS"),  # without a level: in the total only
        ("a", "4", "F", "METADATA", "SUCCESS"),
        ("b", "1", "F", "OPTIONAL", "FAILURE"),  # empty denominator
    ]
    a, b = O.score_runs(results(spark, rows)).orderBy("run_id").collect()
    assert (a.checks_passed, a.checks_failed, a.checks_errored, a.checks_info, a.check_count) == (0, 0, 1, 2, 3)
    assert a.score_overall == 0.0 and math.isnan(b.score_overall) and b.checks_warned == 1
    assert O.score_runs(results(spark, rows), nan_to_null=True).orderBy("run_id").collect()[1].score_overall is None
    assert {(r.run_id, r.score) for r in O.score_by_type(results(spark, rows)).collect()} == {("a", 0.0), ("b", 0.0)}


def test_two_decimals_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2 / 3,), (1.0,), (0.0,)], "x double")
    got = [round(r[0], 4) for r in df.select(S.two_decimals(F.col("x"))).collect()]
    assert got == [0.12, 0.38, 0.67, 1.0, 0.0]


def test_array_xml_and_flat_scores_agree(spark):
    rng = random.Random(1)
    rows = [
        (f"r{i // 9}", f"c{i % 9}", rng.choice("FAIR"), rng.choice([*S.LEVELS, None]), rng.choice(S.STATUSES)) for i in range(450)
    ]
    flat = results(spark, rows)
    runs = flat.groupBy("run_id").agg(
        F.collect_list(
            F.struct("check_id", F.lit(None).cast("string").alias("name"), "type", "level", "status", F.lit(None).cast(C.OUTPUT_TYPE).alias("output"))
        ).alias("results")
    )
    runs = runs.select("run_id", F.col("run_id").alias("pid"), F.lit("s").alias("suite_id"), F.lit("success").alias("run_status"), "results")
    columns = ["run_id", "checks_passed", "checks_warned", "checks_failed", "checks_errored", "checks_info", "check_count", "score_overall"]

    def key(df):
        return sorted(str(tuple(r)) for r in df.select(*columns).collect())

    assert key(O.score_runs(flat)) == key(O.score_arrays(runs)) == key(O.score_run_xml(W.run_xml(runs)))
    wide = {(r.run_id, t): r[f"score_{t.lower()}"] for r in O.score_by_type_wide(flat, types=list("FAIR")).collect() for t in "FAIR"}
    for r in O.score_by_type(flat).collect():
        assert wide[(r.run_id, r.type)] == r.score


def score_rows(spark, rows):
    return R.with_month(
        spark.createDataFrame(
            rows,
            "pid string, sequence_id string, date_uploaded timestamp, score_findable double, score_accessible double, "
            "score_interoperable double, score_reusable double",
        )
    )


def test_monthly_series(spark):
    rows = [
        ("a1", "a", ts("2020-01-03"), 0.2, 0.2, 0.2, 0.2),
        ("a2", "a", ts("2020-01-20"), 0.4, 0.4, 0.4, 0.4),  # latest of the month
        ("b1", "b", ts("2020-01-05"), 0.6, 0.6, 0.6, 0.6),
        ("b2", "b", ts("2020-01-05"), 0.8, 0.8, 0.8, 0.8),  # tie, both stay
        ("n1", None, ts("2020-02-01"), 0.1, 0.1, 0.1, 0.1),
        ("n2", None, ts("2020-02-02"), 0.5, 0.5, None, 0.5),  # null ids are one group
        ("c1", "c", ts("2020-03-02"), 1.0, 1.0, 1.0, 1.0),
    ]
    scores = score_rows(spark, rows)
    assert {r.pid for r in R.latest_versions(scores).collect()} == {"a2", "b1", "b2", "n2", "c1"}
    monthly = R.monthly_means(scores)
    by_rows = R.latest_versions(scores).groupBy("ym").agg(F.avg("f").alias("f"))
    assert {r.ym: round(r.f, 9) for r in monthly.collect()} == {r.ym: round(r.f, 9) for r in by_rows.collect()}
    series = R.cumulative_means(monthly).orderBy("ym").collect()
    assert [round(r.f, 6) for r in series] == [60.0, 50.0, 100.0] and [round(r.fc, 6) for r in series] == [60.0, 55.0, 70.0]
    # A null makes its month null, and every later cumulative mean.
    assert series[1].i is None and [r.ic is None for r in series] == [False, True, True]
    long = R.scores_long(R.cumulative_means(monthly))
    assert long.count() == 24 and R.monthly_series(long).count() == 12
    means = {r.metric: r for r in R.overall_means(long).collect()}
    assert means["Findable"].label == "Findable (70%)" and round(means["Interoperable"]["mean"], 6) == 80.0
    assert R.axis_unit(long).first().axis == "Month"
    last = {r.metric: r["mean"] for r in R.last_cumulative(long).collect()}
    assert round(last["Cum. Findable"], 6) == 70.0 and last["Cum. Interoperable"] is None


def chain(spark, rows):
    """Runs from (pid, obsoletes, sequence_id) or (pid, obsoletes, sequence_id, obsoleted_by)."""
    return spark.createDataFrame(
        [("s", *r, *[None] * (4 - len(r))) for r in rows],
        "suite_id string, pid string, obsoletes string, sequence_id string, obsoleted_by string",
    )


def assigned(spark, rows):
    return {r.pid: r for r in Q.assign_sequence(chain(spark, rows)).collect()}


def test_sequences(spark):
    simple = assigned(spark, [("a", None, None), ("b", "a", None), ("c", "b", None)])
    assert {p: (r.sequence_id, r.position) for p, r in simple.items()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2)}
    assert all(r.sequence_id == "s1" for r in assigned(spark, [("a", None, None), ("b", "a", "s1"), ("c", "b", None)]).values())
    gap = assigned(spark, [("a", None, None), ("c", "b", None), ("d", "c", None)])
    assert [gap[p].sequence_id for p in "acd"] == ["a", None, None]
    own = assigned(spark, [("a", "A", None), ("b", "a", None)])
    assert own["a"].sequence_id is None and own["b"].head == "a"
    two = [("a", None, None), ("b", "a", "s1"), ("c", "b", "s2")]
    assert {r.sequence_id for r in assigned(spark, two).values()} == {"s1"}
    conflict = Q.sequence_conflicts(chain(spark, two)).first()
    assert (conflict.head, conflict.chain_id, conflict.versions) == ("a", "s1", 3)


def test_cycle_is_reported(spark):
    rows = assigned(spark, [("a", "b", None), ("b", "a", None), ("c", "b", None), ("x", None, None)])
    assert {p for p, r in rows.items() if r.in_cycle} == {"a", "b", "c"} and rows["x"].sequence_id == "x"


def test_links_from_either_side(spark):
    by_first = assigned(spark, [("a", None, None, "b"), ("b", None, None)])
    assert {p: (r.sequence_id, r.position) for p, r in by_first.items()} == {"a": ("a", 0), "b": ("a", 1)}
    # One's own link counts before another's, unless the run it names is not stored.
    two = assigned(spark, [("a", None, None, "c"), ("b", None, None), ("c", "b", None), ("d", "x", None), ("e", None, None, "d")])
    assert {p: r.head for p, r in two.items()} == {"a": "a", "b": "b", "c": "b", "d": "e", "e": "e"}
    own = assigned(spark, [("a", None, None, "A"), ("b", "a", None, "b")])
    assert {r.sequence_id for r in own.values()} == {"a"}
    ring = assigned(spark, [("a", None, None, "b"), ("b", None, None, "a"), ("c", "b", None)])
    assert all(r.in_cycle and r.sequence_id is None for r in ring.values())
    assert Q.assign_sequence(chain(spark, [])).count() == 0


def test_random_chains_match_a_plain_walk(spark):
    rng = random.Random(7)
    rows = []
    for c in range(40):
        n = rng.randint(1, 150)
        for i in range(n):
            name = lambda k, c=c: f"{c}-{k:03}"
            if rng.random() < 0.95:
                back = name(i - 1) if i and rng.random() < 0.7 else None
                rows.append((name(i), back, None, name(i + 1) if rng.random() < 0.6 else None))
    stored = {r[0]: r for r in rows}
    named = {}
    for pid, _, _, by in rows:
        if by:
            named[by] = min(pid, named.get(by, pid))

    def walk(pid):
        steps = 0
        while True:
            back = stored[pid][1] if stored[pid][1] in stored else named.get(pid)
            if back is None:
                return pid, steps
            pid, steps = back, steps + 1

    ours = {(r.pid, r.head, r.position) for r in Q.walk_back(chain(spark, rows)).collect()}
    assert ours == {(p, *walk(p)) for p in stored}


def test_mark_latest(spark):
    rows = [("a", "s", ts("2020-01-01"), True), ("b", "s", ts("2020-01-31 23:00:00"), False), ("c", "s", ts("2020-02-01"), True)]
    runs = spark.createDataFrame(rows, "pid string, sequence_id string, date_uploaded timestamp, is_latest boolean")
    got = {r.pid: (r.is_latest, r.modified) for r in Q.mark_latest(runs).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (True, False)}


RUNS = "metadata_id string, suite_id string, ts timestamp, status string, run_count int"


def test_merge_runs_is_idempotent(spark):
    stored = spark.createDataFrame([("a", "s", ts("2020-01-01"), "processing", 1), ("z", "s", ts("2020-01-01"), "success", 4)], RUNS)
    saved = spark.createDataFrame(
        [("a", "s", ts("2020-01-02"), "processing", 2), ("a", "s", ts("2020-01-03"), "success", 3), ("n", "s", ts("2020-01-02"), "success", 9)], RUNS
    )
    now = F.expr("TIMESTAMP '2020-02-01'")
    once = M.merge_runs(stored, saved, now)
    got = {r.metadata_id: (r.status, r.run_count) for r in once.collect()}
    assert got == {"a": ("success", 3), "n": ("success", 1), "z": ("success", 4)}
    twice = M.upsert(once, once, ["metadata_id", "suite_id"], ["ts"])
    assert sorted(map(tuple, twice.select("metadata_id", "status", "run_count").collect())) == sorted(
        (k, *v) for k, v in got.items()
    )


def test_changed_rows_writes_only_differences(spark):
    table = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    changes = spark.createDataFrame([("a", 1, None), ("b", 2, "y")], "k string, n int, s string")
    rows = M.changed_rows(table, changes, ["k"], ["n", "s"]).collect()
    assert [tuple(r) for r in rows] == [("b", 2, "y")]
    assert M.delete_keys(table, changes.filter("k = 'a'"), ["k"]).count() == 1
    assert M.insert_absent(table, spark.createDataFrame([("a", 9, "z"), ("c", 3, "z")], table.schema), ["k"], ["n"]).count() == 3


def test_stuck_runs(spark):
    rows = [("old", "s", ts("2020-01-01 23:00:00"), "processing", 1), ("new", "s", ts("2020-01-02 01:00:00"), "processing", 1), ("done", "s", ts("2020-01-01"), "COMPLETED", 1)]
    runs = spark.createDataFrame(rows, RUNS)
    names = spark.createDataFrame([(i, "node") for i in ("old", "new", "done")], "metadata_id string, data_source string")
    got = U.in_process(runs, names, F.expr("TIMESTAMP '2020-01-03 00:00:00'"), 24).collect()
    assert [r.metadata_id for r in got] == ["old"]


def test_run_state_limit(spark):
    events = [(i, "p", "s", ts(f"2020-01-01 00:{i:02}:00"), "processing" if i % 2 == 0 else "failure") for i in range(22)]
    events += [(30, "q", "s", ts("2020-01-01"), "processing"), (31, "q", "s", ts("2020-01-02"), "success")]
    df = spark.createDataFrame(events, "event_id int, pid string, suite_id string, ts timestamp, status string")
    got = {r.pid: (r.status, r.run_count) for r in U.run_states(df, ["pid", "suite_id"]).collect()}
    assert got == {"p": ("failure", 11), "q": ("success", 1)}


def test_numbering_splits_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{i % 5}", ts(f"2020-01-0{rng.randint(1, 9)} 0{rng.randint(0, 9)}:00:00")) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    got = {r.id: r.n for r in number_in_order(df, ["k"], "ts", "id", "n").collect()}
    seen = {}
    for i, k, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]


def test_numbering_keeps_null_keys_and_times(spark):
    rows = [(1, None, None), (2, None, ts("2020-01-01")), (3, "a", None), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    assert {r.id: r.n for r in number_in_order(df, ["k"], "ts", "id", "n").collect()} == {1: 1, 4: 2, 2: 3, 3: 1}


def test_numbering_splits_one_key_within_one_second(spark):
    """Nine tenths of the rows have one key and one second, and many of them one tie: no task has much more than its share."""
    rows = [(i // 2, "hot", ts("2020-01-01")) if i % 10 else (i, f"k{i % 3}", ts("2020-01-02")) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    numbered = number_in_order(df, ["k"], "ts", "id", "n")
    got = sorted((r.k, r.n, r.id) for r in numbered.collect())
    hot = sorted(i for i, k, _ in rows if k == "hot")
    assert [(n, i) for k, n, i in got if k == "hot"] == list(enumerate(hot, 1))
    for k in ("k0", "k1", "k2"):
        assert [(n, i) for x, n, i in got if x == k] == list(enumerate(sorted(i for i, x, _ in rows if x == k), 1))


def brute_rules(rows, rules):
    found = set()
    for rule in rules:
        for r in rows:
            ok = True
            for c in rule.conditions:
                v = r[c.column]
                if isinstance(c, K.OneOf):
                    ok &= v is not None and str(v) in map(str, c.values)
                else:
                    low, high = (ts(x) if isinstance(x, str) else x for x in (c.low, c.high))
                    ok &= v is not None and (low is None or v > low or (not c.open and v == low)) and (high is None or v < high or (not c.open and v == high))
            if ok:
                found.add((rule.collection_id, r["pid"]))
    return sorted(found)


def test_rules_are_an_index(spark):
    """Values, open and closed ranges of numbers and times, several rules of a collection, rules without conditions, nulls."""
    rng = random.Random(8)
    day = lambda: f"2020-01-{rng.randrange(1, 29):02}"
    rows = [{"pid": i, "kind": rng.choice(["a", "b", None, "#3", "7"]), "size": rng.choice([None, rng.randrange(100)]), "at": ts(day()) if i % 9 else None} for i in range(200)]
    rules = [K.Rule("all"), K.Rule("none", (K.OneOf("kind", ()),)), K.Rule("whole", (K.Between("size"),)), K.Rule("one", (K.Between("size", 50, 50),))]
    for i in range(120):
        low, width = rng.randrange(-5, 105), rng.randrange(30)
        first, last = sorted((day(), day()))
        conditions = [
            K.OneOf("kind", tuple(rng.choice(["a", "b", "c", 7, "#3"]) for _ in range(2))),
            K.Between("size", rng.choice([None, low]), rng.choice([None, low + width]), rng.random() < 0.5),
            K.Between("at", first, rng.choice([None, last]), rng.random() < 0.5),
        ]
        rng.shuffle(conditions)
        rules.append(K.Rule(f"c{i % 90}", tuple(conditions[: rng.randrange(1, 4)])))
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "pid int, kind string, size int, at timestamp")
    found = K.matching(df, rules)
    assert sorted((r.collection_id, r.pid) for r in found.collect()) == brute_rules(rows, rules)
    size = lambda n: len(K.matching(df, [K.Rule(f"r{i}", (K.OneOf("kind", (f"v{i}",)), K.Between("size", i, i + 3))) for i in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(1000) - size(20)) < 2000
    assert K.matching(df, []).count() == 0


REPORT = "id int, ym date, sequence_id string, date_uploaded timestamp, f double, a double, i double, r double"


def test_report_follows_changes(spark, tmp_path):
    """After each batch the series are those of a full run: rows that change month, sequence or score, go null, come late or twice."""
    rng = random.Random(4)
    stored, report = {}, None
    for number in range(4):
        batch = {}
        for _ in range(60):
            i = rng.randrange(90)
            when = ts(f"2020-{rng.randrange(1, 6):02}-{rng.randrange(1, 28):02}")
            score = lambda: rng.choice([None] + [float(rng.randrange(100)) for _ in range(30)])
            batch[i] = (i, when.date().replace(day=1), rng.choice([None, "s1", "s2", f"s{i}"]), when, score(), score(), score(), score())
        stored |= batch
        changed = spark.createDataFrame(list(batch.values()), REPORT)
        report = report or P.Report.at(spark, str(tmp_path / "report"), changed.schema, ["id"])
        report.apply(changed, number)
        if number == 2:
            report.apply(changed, number)  # the same batch delivered again
        names = ["ym", "n", *R.METRICS, *(f"{m}c" for m in R.METRICS)]
        tell = lambda df: sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in row) for row in df.select(*names).collect())
        whole = R.cumulative_means(R.monthly_means(spark.createDataFrame(list(stored.values()), REPORT)))
        assert tell(report.series()) == tell(whole)


def test_merges_keep_their_buckets(spark, tmp_path):
    """The stored side of a merge has no exchange above its scan, before and after a merge."""
    shape = "metadata_id string, suite_id string, ts timestamp, status string, error string, sequence_id string, is_latest boolean, run_count int"
    row = lambda i, s: (f"m{i}", "s", ts("2020-01-01"), s, None, None, False, 1)
    kept = W.BucketedTable(spark, "kept_runs", str(tmp_path / "runs"), ("metadata_id", "suite_id"), 8)
    kept.create(spark.createDataFrame([row(i, "old") for i in range(200)], shape))
    saved = spark.createDataFrame([row(i, "new") for i in range(150, 260)], shape)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(3):
            plan = M.upsert(kept.read(), saved, ["metadata_id", "suite_id"], ["ts"])._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            at = next(i for i, line in enumerate(plan) if "kept_runs" in line)
            above, level = [], depth(plan[at])
            for line in reversed(plan[:at]):
                if depth(line) < level:
                    above.append(line)
                    level = depth(line)
            join = next(i for i, line in enumerate(above) if "Join" in line)
            assert not any("Exchange" in line for line in above[:join]) and any("Exchange" in line for line in plan)
            kept.merge(lambda stored: M.upsert(stored, saved, ["metadata_id", "suite_id"], ["ts"]))
        found = {r.metadata_id: r.status for r in kept.read().collect()}
        assert found == {f"m{i}": "new" if i >= 150 else "old" for i in range(260)}
        assert len(kept._versions()) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        kept.drop()


def test_table_checks_give_rows(spark):
    """100,000 outputs of one document, none of another, and one that fails on the way."""

    def counted(n, word):
        for i in range(n):
            if word == "bad" and i == 2:
                raise ValueError("no more")
            yield "SUCCESS", f"{word}{i}", None, i

    df = spark.createDataFrame([(1, 100000, "a"), (2, 0, "b"), (3, 5, "bad"), (4, None, "c")], "pid int, n int, word string")
    found = C.outputs(df, C.table_check(counted), {"n": F.col("n"), "word": F.col("word")}, ["pid"])
    assert found.columns == ["pid", "status", "value", "type", "identifier"]
    counts = {(r.pid, r.status): (r.n, r.last) for r in found.groupBy("pid", "status").agg(F.count("*").alias("n"), F.max_by("value", F.col("identifier").cast("int")).alias("last")).collect()}
    assert counts[1, "SUCCESS"] == (100000, "a99999") and counts[3, "SUCCESS"] == (2, "bad1")
    assert found.filter("pid = 3 AND status = 'ERROR'").first().value == "no more"
    assert {k[0] for k in counts} == {1, 3, 4} and found.filter("pid = 4").first().status == "ERROR"


def test_whole_texts_in_the_roster(spark, tmp_path):
    """A name that repeats behind many others is found."""
    from qualityspark import plans

    plans.load()
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words), "en", "s", 5), (2, " ".join([*words, "w7"]), "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.pid: r.status for r in plans.QUERIES["xpath_errors"](spark, str(tmp_path)).filter("check_id = 'names'").collect()}
    assert found == {1: "SUCCESS", 2: "FAILURE"}


DOC = "<eml><dataset><title>A long enough title</title><attribute><attributeName>x</attributeName></attribute>{}</dataset></eml>"


def docs(spark, *bodies):
    rows = [(f"d{i}", "eml", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "pid string, format_id string, body string")


def mock_suite():
    title = Selector("title", "//dataset/title")
    count = Selector("entityCount", "count(//dataset/dataTable | //dataset/otherEntity)")
    names = Selector("attributeNames", "//attribute/attributeName")
    registry = C.Registry(
        [
            C.Check("check.1.1", C.longer_than("title", 10), "titleLength", level="OPTIONAL", selectors=(title,)),
            C.Check("check.2.1", C.positive_count("entityCount"), "entityCount", level="INFO", selectors=(count,)),
            C.Check("check.3.1", C.unique_items("attributeNames"), "attributeNames", level="REQUIRED", selectors=(names,)),
        ]
    )
    refs = (C.CheckRef("check.1.1"), C.CheckRef("check.2.1"), C.CheckRef("check.3.1", "Findable", "OPTIONAL"), C.CheckRef("gone"))
    return C.Suite("suite.2.1", refs), registry


def test_mock_suite(spark):
    suite, registry = mock_suite()
    again = "<dataTable/><attribute><attributeName>x</attributeName></attribute>"
    runs = run_suite(docs(spark, DOC.format(""), DOC.format(again), "<eml>"), suite, registry)
    status = {r.pid: r.run_status for r in runs.collect()}
    assert status == {"d0": "success", "d1": "success", "d2": "failure"}
    got = {(r.pid, r.check_id): r for r in explode_results(runs).collect()}
    assert [got["d0", c].status for c in ("check.1.1", "check.2.1", "check.3.1", "gone")] == ["SUCCESS", "FAILURE", "SUCCESS", "SKIP"]
    assert [got["d1", c].status for c in ("check.2.1", "check.3.1")] == ["SUCCESS", "FAILURE"]
    assert (got["d0", "check.3.1"].type, got["d0", "check.3.1"].level) == ("Findable", "OPTIONAL")
    assert got["d0", "gone"].output[0].value == "Could not locate referenced check in store: gone"


def run_python(spark, fn, value="2"):
    s = Selector("v", "/d/v")
    check = C.Check("c", C.python_check(fn), selectors=(s,))
    body = f"<d><v>{value}</v></d>" if value is not None else "<d/>"
    return explode_results(run_check(docs(spark, body), check)).first()


def test_python_contract(spark):
    def equal(v):
        return v == 2

    def raises(v):
        raise RuntimeError("broken")

    def nothing(v):
        return None

    def explicit(v):
        return {"status": "FAILURE", "output": "no"}

    def null(v):
        return {"status": "SUCCESS" if v is None else "FAILURE"}

    r = run_python(spark, equal)
    assert r.status is None and r.output[0].value == "true"
    r = run_python(spark, raises)
    assert r.status == "ERROR" and r.output[0].value == "broken"
    assert run_python(spark, nothing).status == "FAILURE"
    assert run_python(spark, explicit).output[0].value == "no"
    assert run_python(spark, null, None).status == "SUCCESS"


def test_python_check_takes_nested_lists(spark):
    from qualityspark.functions.extract import SubSelector

    def sizes(v):
        return {"status": "SUCCESS", "output": [len(x) for x in v]}

    s = Selector("v", "/d/o", sub=SubSelector("i", "i"))
    check = C.Check("c", C.python_check(sizes), selectors=(s,))
    r = explode_results(run_check(docs(spark, "<d><o><i>1</i><i>2</i></o><o/></d>"), check)).first()
    assert [o.value for o in r.output] == ["2", "0"]


def test_abstract_words(spark):
    s = Selector("abstract", "//abstract")
    check = C.Check("a", C.min_words("abstract", 3), selectors=(s,))
    bodies = ["<d><abstract>one two three</abstract></d>", "<d><abstract>one two</abstract></d>", "<d><abstract> </abstract></d>", "<d/>", "<d><abstract>one</abstract><abstract>two three</abstract></d>"]
    rows = explode_results(run_check(docs(spark, *bodies), check)).orderBy("pid").collect()
    assert [r.status for r in rows] == ["SUCCESS", "FAILURE", "FAILURE", "FAILURE", "SUCCESS"]
    assert rows[0].output[0].value == "The abstract is valid, with a word count of 3"
    assert rows[2].output[0].value == "The abstract is blank" and rows[3].output[0].value == "An abstract was not found."


def test_file_outputs(spark):
    results_ = spark.createDataFrame([("a", "/tmp/x.png"), ("b", "text")], "pid string, value string")
    files = spark.createDataFrame([("/tmp/x.png", bytearray(b"hi"))], "path string, content binary")
    assert {r.pid: r.value for r in encode_file_outputs(results_, files).collect()} == {"a": "aGk=", "b": "text"}


def test_harvest_window_rules(spark):
    nodes = spark.createDataFrame([("new",), ("past",), ("future",)], "node_id string")
    marks = spark.createDataFrame([("past", ts("2020-01-01")), ("future", ts("2021-01-01"))], "node_id string, last_harvest_datetime timestamp")
    now = F.expr("TIMESTAMP '2020-06-01'")
    got = {r.node_id: r.since for r in H.windows(nodes, marks, F.expr("TIMESTAMP '2019-01-01'"), now).collect()}
    assert got == {"new": ts("2019-01-01"), "past": ts("2020-01-01"), "future": ts("2020-05-31 23:59:00")}


def test_format_patterns(spark):
    df = spark.createDataFrame([("eml://x",), ("http://a/eml-2",), ("xeml",), ("json",)], "f string")
    text = "^eml.*|^http.*eml.*"
    assert [r[0] for r in df.select(H.format_matches(F.col("f"), text)).collect()] == [True, True, False, False]
    assert [r[0] for r in df.select(H.format_matches(F.col("f"), F.lit(text))).collect()] == [True, True, False, False]


def test_collection_query_edit(spark):
    q = '(((project:"A") AND (-obsoletedBy:* AND formatType:METADATA)))'
    assert spark.range(1).select(K.all_versions(F.lit(q))).first()[0] == '(((project:"A")))'
    assert K.format_family(F.lit("x"), None) is not None


def test_award_keys(spark):
    df = spark.createDataFrame([("123456",), ("NSF Award 123456 ",), ("0123456",), ("12345678",)], "a string")
    assert [r[0] for r in df.select(S.award_key(F.col("a"))).collect()] == ["0123456", "123456", "0123456", "12345678"]


def test_relative_paths(spark):
    rows = [("data", "a.csv", "f", "csv"), ("data", "", "f1", ".csv"), ("code", None, "f2", None), ("tmp", "x", "f", "png")]
    df = spark.createDataFrame(rows, "s string, alt string, id string, ext string")
    got = [r[0] for r in df.select(S.relative_path(F.col("s"), F.col("alt"), F.col("id"), F.col("ext"))).collect()]
    assert got == ["data/a.csv", "data/f1..csv", "code/f2", "tmp/x.png"]


@pytest.mark.parametrize(
    "level, status, colour",
    [("INFO", "FAILURE", "BLUE"), ("REQUIRED", "SKIP", "BLUE"), ("OPTIONAL", "FAILURE", "ORANGE"), ("REQUIRED", "FAILURE", "RED"), ("OPTIONAL", "ERROR", "ORANGE"), ("REQUIRED", "ERROR", "RED")],
)
def test_colours(spark, level, status, colour):
    assert spark.range(1).select(S.result_colour(F.lit(level), F.lit(status))).first()[0] == colour


def test_fetch_fallback_and_groups(spark):
    first = spark.createDataFrame([("a", "x"), ("b", None)], "pid string, body string")
    second = spark.createDataFrame([("b", "y"), ("c", "z")], "pid string, body string")
    assert {r.pid: r.body for r in L.fetch_with_fallback(first, second).collect()} == {"a": "x", "b": "y", "c": "z"}
    holders = spark.createDataFrame([("1", "ann"), ("2", "team"), ("3", "who")], "pid string, rights_holder string")
    membership = spark.createDataFrame([("ann", "team"), ("ann", "lab")], "subject string, group string")
    got = sorted((r.pid, r.group) for r in L.group_lookup(holders, membership).collect())
    assert got == [("1", "lab"), ("1", "team"), ("2", "team")]
