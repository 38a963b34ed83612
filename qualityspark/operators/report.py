"""A report that follows changed scores without reading all of them again.

Its totals merge: per version date of a sequence and per month, the rows, and of
each metric its sum and its values that are not null. A changed row takes its
old share back and adds its new one; of a month, only the sequences that changed
take back what their latest versions gave before and add what they give now.
Everything is stored as differences, one folder per batch, so nothing is
rewritten, and a batch that comes twice leaves the same totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from qualityspark.operators import rollup
from qualityspark.operators.merge import last_per_key
from qualityspark.session import cut_lineage
from qualityspark.sinks.batches import BATCH, BatchTable

_GROUP = ["ym", "sequence_id"]


def _totals(metrics: list[str]) -> list[str]:
    return ["n", *(f"s_{m}" for m in metrics), *(f"n_{m}" for m in metrics)]


def _shares(rows: DataFrame, metrics: list[str], by: list[str], sign: int = 1) -> DataFrame:
    """Totals of rows per group, or (``sign`` -1) what takes them back."""
    counted = [(F.count(F.lit(1)) * sign).alias("n"), *((F.sum(m) * sign).alias(f"s_{m}") for m in metrics), *((F.count(m) * sign).alias(f"n_{m}") for m in metrics)]
    filled = rows.groupBy(*by).agg(*counted)
    return filled.select(*by, "n", *(F.coalesce(f"s_{m}", F.lit(0.0)).alias(f"s_{m}") for m in metrics), *(f"n_{m}" for m in metrics))


def _summed(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in _totals(metrics)))


def _newest(versions: DataFrame, metrics: list[str]) -> DataFrame:
    """Totals of the latest version date of each sequence in a month, as long as it has rows."""
    last = F.max(F.struct("date_uploaded", *_totals(metrics)))
    return versions.filter("n > 0").groupBy(*_GROUP).agg(last.alias("t")).select("ym", *(f"t.{c}" for c in _totals(metrics)))


@dataclass(frozen=True)
class Report:
    """Stored rows by key, totals per version date, and totals per month, below one root."""

    rows: BatchTable
    versions: BatchTable
    months: BatchTable
    keys: tuple[str, ...]
    metrics: tuple[str, ...]

    @classmethod
    def at(cls, spark: SparkSession, root: str, shape: StructType, keys: list[str], metrics: list[str] | None = None) -> Report:
        """``shape``: the keys, ``ym, sequence_id, date_uploaded`` and the metrics (see ``rollup.with_month``)."""
        metrics = metrics or list(rollup.METRICS)
        shape = StructType([shape[c] for c in (*keys, *_GROUP, "date_uploaded", *metrics)])

        def table(name: str, by: list[str]) -> BatchTable:
            own = StructType([shape[c] for c in by])
            for c in _totals(metrics):
                own = own.add(c, DoubleType() if c.startswith("s_") else LongType())
            return BatchTable(spark, f"{root}/{name}", own, lambda rows: _summed(rows, metrics, by).filter("n <> 0"))

        rows = BatchTable(spark, f"{root}/rows", shape, lambda rows: last_per_key(rows, list(keys), [BATCH]))
        return cls(rows, table("versions", [*_GROUP, "date_uploaded"]), table("months", ["ym"]), tuple(keys), tuple(metrics))

    def apply(self, changed: DataFrame, number: int) -> None:
        """Take in changed rows, one per key, as batch ``number``; numbers grow, and a repeated one replaces itself.

        Joins are by the changed keys and by the months and sequences that they
        touch, null sequences among them.
        """
        metrics, keys = list(self.metrics), list(self.keys)
        new = cut_lineage(changed.select(*self.rows.schema.names))
        old = self.rows.read(before=number).join(new.select(*keys), keys, "left_semi")
        dated = [*_GROUP, "date_uploaded"]
        moved = _shares(new, metrics, dated).unionByName(_shares(old, metrics, dated, -1))
        moved = cut_lineage(_summed(moved, metrics, dated))
        group = lambda: F.struct(*_GROUP).alias("_group")
        touched = moved.select(group()).distinct()
        before = cut_lineage(self.versions.read(before=number).withColumn("_group", group()).join(touched, "_group", "left_semi").drop("_group"))
        after = _summed(before.unionByName(moved), metrics, dated)
        gains = _newest(after, metrics).unionByName(_negated(_newest(before, metrics), metrics))
        self.months.write(_summed(gains, metrics, ["ym"]), number)
        self.versions.write(moved, number)
        self.rows.write(new, number)

    def monthly(self) -> DataFrame:
        """The same as ``rollup.monthly_means`` of all stored rows, from one row per month and batch."""
        mean = lambda m: F.when(F.col(f"n_{m}") == F.col("n"), F.col(f"s_{m}") / F.col("n")).alias(m)
        return self.months.read().filter("n > 0").select("ym", "n", *(mean(m) for m in self.metrics))

    def series(self) -> DataFrame:
        return rollup.cumulative_means(self.monthly(), metrics=list(self.metrics))


def _negated(totals: DataFrame, metrics: list[str]) -> DataFrame:
    return totals.select("ym", *((-F.col(c)).alias(c) for c in _totals(metrics)))


def months_of(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Score rows in the shape that a report takes."""
    return rollup.with_month(scores).select(*keys, *_GROUP, "date_uploaded", *rollup.METRICS)
