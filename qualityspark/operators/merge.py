"""Keyed upserts and deletes as DataFrame operators.

The change set is reduced to one row per key first. Stored table and changes
then meet in one full outer join on the key, so each is read once; a table that
is kept bucketed by its key does not move for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType


def last_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``. Combines before the shuffle, so a
    key repeated very often costs no more than any other. Rows equal in ``order``
    go by their other columns, so a task that is tried again gives the same row."""
    lead = [c for c in order if c not in keys]
    rest = [c for c in changes.columns if c not in keys and c not in order]
    ties = [c for c in rest if not _holds_map(changes.schema[c].dataType)]
    top = changes.groupBy(*keys).agg(F.max_by(F.struct(*lead, *rest), F.struct(*lead, *ties)).alias("_row"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in changes.columns])


def _holds_map(kind: DataType) -> bool:
    return isinstance(kind, MapType) or "map<" in kind.simpleString()


def _meet(
    table: DataFrame, changed: DataFrame, keys: list[str], row: Callable[[Column, Column], Column], how: str = "full"
) -> DataFrame:
    """Join the two on their keys and take ``row(stored, changed)``, each a struct or null."""
    rest = [c for c in table.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    both = pack(table, "_old").join(pack(changed, "_new"), keys, how).withColumn("_row", row(F.col("_old"), F.col("_new")))
    return both.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in table.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Changed rows replace stored ones of the same key; new keys are added."""
    return _meet(table, last_per_key(changes, keys, order), keys, lambda old, new: F.coalesce(new, old))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not stored yet are added; stored rows stay as they are."""
    return _meet(table, last_per_key(rows, keys, order), keys, lambda old, new: F.coalesce(old, new))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def merge_runs(runs: DataFrame, saved: DataFrame, now: Column) -> DataFrame:
    """Save runs by (metadata_id, suite_id).

    The time is set to ``now``. A stored run takes the given run count; a new
    one starts at its default of 1, whatever it was given.
    """

    def row(old: Column, new: Column) -> Column:
        count = F.when(old.isNotNull(), new["run_count"]).otherwise(1).cast("int")
        saved_ = new.withField("ts", now.cast("timestamp")).withField("run_count", count)
        return F.when(new.isNotNull(), saved_).otherwise(old)

    keys = ["metadata_id", "suite_id"]
    return _meet(runs, last_per_key(saved, keys, ["ts"]), keys, row)


def merge_identifiers(table: DataFrame, saved: DataFrame) -> DataFrame:
    return upsert(table, saved, ["metadata_id"], ["ts"])


def merge_nodes(table: DataFrame, saved: DataFrame) -> DataFrame:
    return upsert(table, saved, ["identifier"], ["last_harvest"])


def merge_marks(table: DataFrame, saved: DataFrame) -> DataFrame:
    return upsert(table, saved, ["task_name", "task_type", "node_id"], ["last_harvest_datetime"])


def merge_files(table: DataFrame, saved: DataFrame) -> DataFrame:
    return upsert(table, saved, ["pid", "storage_type", "media_type", "alt_filename"], ["creation_datetime"])


def merge_scores(table: DataFrame, saved: DataFrame) -> DataFrame:
    return upsert(table, saved, ["run_id"], ["ts"])


def changed_rows(table: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Stored rows to rewrite: given fields overwrite, all others are copied, and
    only rows where some value differs come out."""
    given = changes.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = table.join(given, keys)
    differs = F.lit(False)
    for f in fields:
        new = F.col(f"_new_{f}")
        differs = differs | (new.isNotNull() & ~new.eqNullSafe(F.col(f)))
    updated = {f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}
    return joined.filter(differs).select(*[updated.get(c, F.col(c)).alias(c) for c in table.columns])


def partial_update(table: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Whole table after ``changed_rows`` is merged in; keys that are not stored are left out.

    ``changes`` has one row per key, as for ``changed_rows``.
    """
    given = changes.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    updated = {f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}
    return table.join(given, keys, "left").select(*[updated.get(c, F.col(c)).alias(c) for c in table.columns])
