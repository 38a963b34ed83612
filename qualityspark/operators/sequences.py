"""Version sequences over obsolescence links."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from qualityspark.operators.skew import join_latest
from qualityspark.session import cut_lineage

KEY = ["suite_id", "pid"]


def links(runs: DataFrame) -> DataFrame:
    """Back link of every stored run, to a stored run, from either side of an obsolescence.

    A run's own ``obsoletes`` counts if that run is stored; otherwise the stored
    run that names it in ``obsoleted_by``, of several the one with the smallest
    pid. A link to oneself is no link in either column (compared without case).
    ``is_first`` marks a run that names nothing it obsoletes and is named by none.
    """
    other = lambda a, b: F.lower(F.col(a).cast("string")) != F.lower(F.col(b).cast("string"))
    stored = runs.select("suite_id", F.col("pid").alias("_own"), F.lit(True).alias("_stored"))
    named = runs.filter(other("obsoleted_by", "pid")).groupBy("suite_id", F.col("obsoleted_by").alias("pid")).agg(F.min("pid").alias("_by"))
    own = runs.select(
        "suite_id", "pid", "sequence_id", F.when(other("obsoletes", "pid"), F.col("obsoletes")).alias("_own"), F.col("obsoletes").isNull().alias("_none")
    )
    linked = own.join(named, KEY, "left").join(stored, ["suite_id", "_own"], "left")
    back = F.when(F.col("_stored"), F.col("_own")).otherwise(F.col("_by"))
    return linked.select(*KEY, "sequence_id", back.alias("back"), (F.col("_none") & back.isNull()).alias("is_first"))


def walk_back(runs: DataFrame) -> DataFrame:
    """First stored version behind every stored run, and the distance to it.

    ``runs(suite_id, pid, obsoletes, obsoleted_by, sequence_id, ...)`` holds the
    stored runs only. Returns ``suite_id, pid, sequence_id, head, position,
    head_is_first, in_cycle``: the walk ends at a run without a back link
    (``head_is_first``), or before a missing run or at a self link. Pointer
    doubling: each round doubles the distance covered, so the number of joins is
    the logarithm of the longest chain. Finished runs leave the joined side, so
    no head is ever a hot join key, and a round writes the runs still walking
    only. Runs on or behind a cycle are reported with ``in_cycle`` and no head.
    """
    columns = [*KEY, "sequence_id", "head", "position", "is_first", "done"]
    end = F.col("back").isNull()
    state = links(runs).select(
        *KEY, "sequence_id", F.coalesce("back", "pid").alias("head"), F.when(end, 0).otherwise(1).cast("bigint").alias("position"), "is_first", end.alias("done")
    )
    total = Observation()
    pieces = [cut_lineage(state.observe(total, F.count_if(~F.col("done")).alias("n")))]
    left = total.get["n"]
    limit = math.ceil(math.log2(max(left, 2))) + 2
    while left and limit:
        limit -= 1
        # The newest word on each run: finished ones of all rounds, and those of the last.
        known = reduce(DataFrame.unionByName, [p.filter("done") for p in pieces[:-1]] + [pieces[-1]])
        ahead = known.select(
            "suite_id", F.col("pid").alias("head"), F.col("head").alias("_head"), F.col("position").alias("_position"), F.col("is_first").alias("_first"), F.col("done").alias("_done")
        )
        counted = Observation()
        moved = (
            pieces[-1]
            .filter("NOT done")
            .join(ahead, ["suite_id", "head"])
            .select(
                *KEY,
                "sequence_id",
                F.col("_head").alias("head"),
                (F.col("position") + F.col("_position")).alias("position"),
                F.col("_first").alias("is_first"),
                F.col("_done").alias("done"),
            )
            .observe(counted, F.count_if(~F.col("done")).alias("n"))
        )
        pieces.append(cut_lineage(moved))
        left = counted.get["n"]
    known = reduce(DataFrame.unionByName, [p.filter("done") for p in pieces[:-1]] + [pieces[-1]]).select(*columns)
    placed = lambda c: F.when(F.col("done"), F.col(c))
    return known.select(
        *KEY,
        "sequence_id",
        placed("head").alias("head"),
        placed("position").alias("position"),
        (F.col("done") & F.col("is_first")).alias("head_is_first"),
        (~F.col("done")).alias("in_cycle"),
    )


def chain_ids(walked: DataFrame) -> DataFrame:
    """Sequence id of every chain: the id found at the lowest position, else the
    first pid if the walk reached it, else none. One row per ``suite_id, head``."""
    by_chain = walked.filter("head IS NOT NULL").groupBy("suite_id", "head").agg(
        F.min_by("sequence_id", F.when(F.col("sequence_id").isNotNull(), F.struct("position", "pid"))).alias("_found"),
        F.bool_or("head_is_first").alias("_first"),
        F.min("sequence_id").alias("_least"),
        F.max("sequence_id").alias("_greatest"),
        F.count(F.lit(1)).alias("versions"),
    )
    first = F.when(F.col("_first"), F.col("head").cast(walked.schema["sequence_id"].dataType))
    return by_chain.select(
        "suite_id",
        "head",
        F.coalesce("_found", first).alias("chain_id"),
        "versions",
        (F.col("_least") != F.col("_greatest")).alias("_two"),
    ).withColumn("conflict", F.coalesce("_two", F.lit(False))).drop("_two")


def assign_sequence(runs: DataFrame) -> DataFrame:
    """Give every run its chain's sequence id and say which rows change.

    Runs whose chain has no id keep what they have, which is none.
    """
    walked = walk_back(runs)
    chains = chain_ids(walked).select("suite_id", "head", "chain_id")
    placed = join_latest(walked, chains, ["suite_id", "head"], "left")
    return placed.select(
        *KEY,
        "head",
        "position",
        "in_cycle",
        F.coalesce("chain_id", "sequence_id").alias("sequence_id"),
        (F.col("chain_id").isNotNull() & ~F.col("sequence_id").eqNullSafe(F.col("chain_id"))).alias("modified"),
    )


def sequence_conflicts(runs: DataFrame) -> DataFrame:
    """Chains in which more than one sequence id was found."""
    return chain_ids(walk_back(runs)).filter("conflict").drop("conflict")


def modified_runs(runs: DataFrame) -> DataFrame:
    return runs.filter("modified")


def latest_in_month(runs: DataFrame) -> DataFrame:
    """Latest run per sequence and calendar month; of equal dates the greater pid."""
    return runs.groupBy("sequence_id", F.date_trunc("month", "date_uploaded").alias("month")).agg(
        F.max(F.struct("date_uploaded", "pid")).alias("_top")
    ).select("sequence_id", "month", F.col("_top.pid").alias("pid"), F.col("_top.date_uploaded").alias("date_uploaded"))


def mark_latest(runs: DataFrame) -> DataFrame:
    """Set ``is_latest`` on the latest run of each month, clear it on the others.

    ``modified`` tells which rows differ from their stored flag.
    """
    dated = runs.withColumn("month", F.date_trunc("month", "date_uploaded"))
    top = latest_in_month(runs).select("sequence_id", "month", F.col("pid").alias("_top"))
    marked = join_latest(dated, top, ["sequence_id", "month"], "left").withColumn(
        "_now", F.coalesce(F.col("pid") == F.col("_top"), F.lit(False))
    )
    return (
        marked.withColumn("modified", ~F.col("is_latest").eqNullSafe(F.col("_now")))
        .withColumn("is_latest", F.col("_now"))
        .drop("_now", "_top", "month")
    )
