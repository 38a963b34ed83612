"""Counts, scores and proportions of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.sinks.writers import read_run_xml

# The four score types of the wide score row.
SCORE_TYPES = ["Findable", "Accessible", "Interoperable", "Reusable"]

_scored = lambda level: ~level.isin("INFO", "METADATA")


def _tests(status: Column, level: Column) -> dict[str, Column]:
    """What each counter counts. A null level is in none of them but the total."""
    return {
        "checks_passed": (status == "SUCCESS") & _scored(level),
        "checks_warned": (status == "FAILURE") & (level == "OPTIONAL"),
        "checks_failed": (status == "FAILURE") & (level == "REQUIRED"),
        "checks_errored": status == "ERROR",
    }


def _blocking(status: Column, level: Column) -> Column:
    return (level == "REQUIRED") & status.isin("FAILURE", "ERROR")


def _ratio(n: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(float("nan"))).otherwise(n / den)


def score_runs(results: DataFrame, by: list[str] | str = "run_id", nan_to_null: bool = False) -> DataFrame:
    """Counters and overall score per run, in one map-side combined aggregation."""
    keys = [by] if isinstance(by, str) else by
    status, level = F.col("status"), F.col("level")
    counted = results.groupBy(*keys).agg(
        *[F.count_if(test).alias(name) for name, test in _tests(status, level).items()],
        (F.count_if(status == "SKIP") + F.count_if(level == "INFO")).alias("checks_info"),
        (F.count(F.lit(1)) - F.count_if(level == "METADATA")).alias("check_count"),
        F.count_if(_blocking(status, level)).alias("_blocking"),
    )
    return _with_overall(counted, nan_to_null).drop("_blocking")


def _with_overall(counted: DataFrame, nan_to_null: bool) -> DataFrame:
    score = _ratio(F.col("checks_passed"), F.col("checks_passed") + F.col("_blocking"))
    if nan_to_null:
        score = F.nanvl(score, F.lit(None).cast("double"))
    return counted.withColumn("score_overall", score)


def score_arrays(runs: DataFrame, results: str = "results", nan_to_null: bool = False) -> DataFrame:
    """The same counters from the results array of each run: one fold over it, without a shuffle."""
    tests = {
        **{name: (lambda r, name=name: _tests(r.status, r.level)[name]) for name in ("checks_passed", "checks_warned", "checks_failed", "checks_errored")},
        "_skip": lambda r: r.status == "SKIP",
        "_info": lambda r: r.level == "INFO",
        "_other": lambda r: ~(r.level == "METADATA") | r.level.isNull(),
        "_blocking": lambda r: _blocking(r.status, r.level),
    }
    counted = _fold(runs, results, tests).withColumns(
        {"checks_info": F.col("_n._skip") + F.col("_n._info"), "check_count": F.col("_n._other"), "_blocking": F.col("_n._blocking")}
    )
    order = ["checks_passed", "checks_warned", "checks_failed", "checks_errored"]
    counted = counted.withColumns({name: F.col(f"_n.{name}") for name in order})
    counted = counted.select(*runs.columns, *order, "checks_info", "check_count", "_blocking")
    return _with_overall(counted, nan_to_null).drop("_blocking")


def _fold(runs: DataFrame, results: str, tests: dict) -> DataFrame:
    """Add ``_n``, a struct that counts the results meeting each test in one pass over the array."""
    one = lambda test, r: F.coalesce(test(r), F.lit(False)).cast("bigint")
    start = F.struct(*[F.lit(0).cast("bigint").alias(name) for name in tests])
    step = lambda n, r: F.struct(*[(n[name] + one(test, r)).alias(name) for name, test in tests.items()])
    return runs.withColumn("_n", F.aggregate(results, start, step))


def score_run_xml(runs: DataFrame, body: str = "run_xml") -> DataFrame:
    """The same counters from run documents, each parsed once."""
    read = F.transform(read_run_xml(F.col(body))["result"], lambda r: F.struct(r.status.alias("status"), r.check.level.alias("level")))
    return score_arrays(runs.withColumn("_results", read), "_results").drop("_results")


def type_scores(runs: DataFrame, results: str = "results", types: list[str] | None = None) -> DataFrame:
    """Add a score per type from the results array; null where the run has no check of it."""
    types = types or SCORE_TYPES
    tests = {}
    for i, t in enumerate(types):
        tests[f"c{i}"] = lambda r, t=t: r.type == t
        tests[f"n{i}"] = lambda r, t=t: (r.type == t) & (r.status == "SUCCESS") & _scored(r.level)
        tests[f"b{i}"] = lambda r, t=t: (r.type == t) & _blocking(r.status, r.level)
    n = F.col("_n")
    scored = {f"score_{t.lower()}": F.when(n[f"c{i}"] > 0, _type_score(n[f"n{i}"], n[f"b{i}"])) for i, t in enumerate(types)}
    return _fold(runs, results, tests).withColumns(scored).drop("_n")


def score_by_type(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Long form: one row per run and distinct type, two decimals, 0 for an empty denominator."""
    status, level = F.col("status"), F.col("level")
    sums = (
        results.filter("type IS NOT NULL")
        .groupBy(by, "type")
        .agg(
            F.count_if((status == "SUCCESS") & _scored(level)).alias("_n"),
            F.count_if(_blocking(status, level)).alias("_b"),
        )
    )
    return sums.select(by, "type", _type_score(F.col("_n"), F.col("_b")).alias("score"))


def _type_score(n: Column, blocking: Column) -> Column:
    den = n + blocking
    return S.two_decimals(F.when(den == 0, F.lit(0.0)).otherwise(n / den))


def score_by_type_wide(
    results: DataFrame, by: str = "run_id", types: list[str] | None = None, overall: bool = False
) -> DataFrame:
    """One row per run with a score per type; null where the run has no check of it.

    Conditional counts need one aggregation, where a pivot over
    ``score_by_type`` would need two; ``overall`` adds the overall score to it.
    """
    types = types or SCORE_TYPES
    status, level = F.col("status"), F.col("level")
    aggs = []
    for i, t in enumerate(types):
        of_type = F.col("type") == t
        aggs += [
            F.count_if(of_type).alias(f"_c{i}"),
            F.count_if(of_type & (status == "SUCCESS") & _scored(level)).alias(f"_n{i}"),
            F.count_if(of_type & _blocking(status, level)).alias(f"_b{i}"),
        ]
    passed = F.count_if((status == "SUCCESS") & _scored(level)).alias("checks_passed")
    counted = results.groupBy(by).agg(*aggs, passed, F.count_if(_blocking(status, level)).alias("_blocking"))
    if overall:
        counted = _with_overall(counted, False)
    return counted.select(
        by,
        *(["score_overall"] if overall else []),
        *[
            F.when(F.col(f"_c{i}") > 0, _type_score(F.col(f"_n{i}"), F.col(f"_b{i}"))).alias(f"score_{t.lower()}")
            for i, t in enumerate(types)
        ],
    )


def score_map(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Scores by type as a map, named as the index names them."""
    long = score_by_type(results, by)
    name = F.concat(F.lit("scoreByType_"), F.col("type"), F.lit("_f"))
    return long.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "score")))).alias("scores"))


def distinct_types(results: DataFrame, by: str = "run_id") -> DataFrame:
    return results.filter("type IS NOT NULL").select(by, "type").distinct()


def echoed_values(results: Column, marker: str) -> Column:
    """De-duplicated outputs of the checks whose id contains ``marker``."""
    hits = F.filter(results, lambda r: r.check_id.contains(marker))
    texts = F.flatten(F.transform(hits, lambda r: F.coalesce(r.output, F.array().cast("array<struct<value:string,type:string,identifier:string>>"))))
    return F.array_distinct(
        F.filter(F.transform(texts, lambda o: S.normalize_space(o.value)), lambda t: t.isNotNull())
    )


def score_rows(runs: DataFrame) -> DataFrame:
    """Index row of each run: ids, times, node, multi-valued fields, counters, scores by type.

    ``runs`` has ``run_id, pid, suite_id, results, sysmeta`` and may have ``ts``,
    ``sequence_id`` and ``groups`` (list of group subjects), which are null if it
    has not.
    """
    scored = type_scores(score_arrays(runs))
    meta = F.col("sysmeta")
    fields = runs.schema["sysmeta"].dataType.names
    given = lambda name, kind: (F.col(name) if name in runs.columns else F.lit(None).cast(kind)).alias(name)
    series = meta["series_id"] if "series_id" in fields else F.lit(None).cast("string")
    return scored.select(
        "run_id",
        F.col("pid").alias("metadata_id"),
        "suite_id",
        given("ts", "timestamp"),
        given("sequence_id", "string"),
        series.alias("series_id"),
        meta["format_id"].alias("metadata_format_id"),
        S.normalize_space(meta["origin_member_node"]).alias("datasource"),
        S.normalize_space(meta["rights_holder"]).alias("rights_holder"),
        given("groups", "array<string>"),
        meta["date_uploaded"].alias("date_uploaded"),
        meta["obsoletes"].alias("obsoletes"),
        meta["obsoleted_by"].alias("obsoleted_by"),
        echoed_values(F.col("results"), "check.echo.funder.").alias("funder"),
        echoed_values(F.col("results"), "check.lookup.award.").alias("funder_info"),
        *["checks_passed", "checks_warned", "checks_failed", "checks_errored", "checks_info", "check_count"],
        "score_overall",
        *[f"score_{t.lower()}" for t in SCORE_TYPES],
    )


def corpus_results(results: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Results over the documents a query selects (``pid``): counts and successes per group."""
    of_chosen = results.join(chosen.select("pid"), "pid", "left_semi")
    return of_chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("n_success"))


# Proportions ------------------------------------------------------------------


def proportions(results: DataFrame, keys: list[str]) -> DataFrame:
    """Share of all rows per group.

    The total is a sum over the grouped counts, whose exchange both use: results
    are read once, and no task sees all groups.
    """
    counts = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(*keys, "n", (F.col("n") / total).alias("proportion"))


def proportions_single(results: DataFrame) -> DataFrame:
    shares = proportions(results, ["pid", "type", "status", "level"])
    return shares.withColumn("color", S.result_colour(F.col("level"), F.col("status")))


def proportions_multi(results: DataFrame) -> DataFrame:
    return proportions(results, ["datasource", "status", "level"])


def box_scores(results: DataFrame) -> DataFrame:
    """Share of SUCCESS per document, INFO results left out."""
    return (
        results.filter("level <> 'INFO'")
        .groupBy("datasource", "pid")
        .agg((F.count_if(F.col("status") == "SUCCESS") / F.count(F.lit(1))).alias("score"))
    )


def box_summary(scores: DataFrame) -> DataFrame:
    """Five-number summary per datasource.

    Scores are ratios of small counts, so the distinct values are few: they are
    counted first and the percentiles weighted, which keeps a datasource with
    very many documents small.
    """
    weighted = scores.groupBy("datasource", "score").agg(F.count(F.lit(1)).alias("_n"))
    marks = F.percentile("score", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]), F.col("_n"))
    names = ["low", "q1", "median", "q3", "high"]
    return (
        weighted.groupBy("datasource")
        .agg(marks.alias("_p"), F.sum("_n").alias("n"))
        .select("datasource", "n", *[F.col("_p")[i].alias(name) for i, name in enumerate(names)])
    )


def summary_kind(results: DataFrame) -> DataFrame:
    """Whether results call for the single- or the multi-document summary.

    Least and greatest id tell one document from many without counting ids.
    """
    one = F.min("pid") == F.max("pid")
    return results.agg(F.when(one, "single").otherwise("multi").alias("summary"))


def runs_with_status(scores: DataFrame, errored: bool) -> DataFrame:
    """Runs with at least one errored check, or without any."""
    return scores.filter(F.col("checks_errored") >= 1 if errored else F.col("checks_errored") == 0)


def fold_statuses(results: DataFrame, by: str, order: str = "check_no", message: str = "message") -> DataFrame:
    """Fold of helper statuses: one FAILURE sticks, and messages append in order.

    A run has as many rows as its suite has checks, so its list stays small.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, message)))
    return results.groupBy(by).agg(
        F.when(F.bool_and(F.col("status") != "FAILURE"), "SUCCESS").otherwise("FAILURE").alias("status"),
        F.transform(rows, lambda r: r[message]).alias("messages"),
    )
