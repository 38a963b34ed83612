"""What the batches of a stream give, as plain Parquet: one folder per batch, folded when read.

A batch is reduced by key before it is written, and written over a folder of its
own number, so one that is delivered twice leaves the same rows. A read folds
the rows of all batches, which must not mind their order. The folders grow with
the batches; ``settle`` writes the folded rows as the first batch of a new root.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from qualityspark.session import exists

BATCH = "batch"


@dataclass(frozen=True)
class BatchTable:
    """Rows in ``schema`` below ``root``, a folder that all executors share.

    ``fold`` reduces rows of any batches, with the column ``batch`` beside them,
    to the table's rows in ``schema``.
    """

    spark: SparkSession
    root: str
    schema: StructType
    fold: Callable[[DataFrame], DataFrame]

    def write(self, rows: DataFrame, number: int) -> None:
        """Write the rows of a batch, in place of an earlier try."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/{BATCH}={number}")

    def rows(self) -> DataFrame:
        """Rows of all batches, with the number of theirs."""
        shape = StructType([*self.schema.fields]).add(BATCH, LongType())
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(self.root)

    def read(self, before: int | None = None) -> DataFrame:
        """The table after all batches, or after those before a number."""
        rows = self.rows()
        return self.fold(rows if before is None else rows.filter(F.col(BATCH) < before)).select(*self.schema.names)

    def settle(self, root: str) -> BatchTable:
        """The same rows below a new root, as one batch before all that come."""
        settled = BatchTable(self.spark, root, self.schema, self.fold)
        settled.write(self.read(), -1)
        return settled
