"""Table, CSV, XML and JSON sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from qualityspark.functions import scalars as S
from qualityspark.session import remove


def write_version(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write a whole table state into a new folder of ``root``.

    A merged state reads the version before it, so it never overwrites what it
    reads; a rerun of the same version replaces only its own folder.
    """
    path = f"{root.rstrip('/')}/{version}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """Write a table bucketed and sorted by its join keys.

    Documents, system metadata, runs and scores kept this way join, and merge,
    without moving their rows: of large bodies that is the costliest shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


@dataclass(frozen=True)
class BucketedTable:
    """A stored table whose merges keep it bucketed and sorted by its keys, so its rows never move for one.

    ``name`` is that of the catalog, ``root`` a folder that all executors share.
    Each merge writes the next version, ``name_v<number>``, and drops the one
    before the last; readers of the last one are not disturbed.
    """

    spark: SparkSession
    name: str
    root: str
    keys: tuple[str, ...]
    buckets: int

    def _versions(self) -> list[int]:
        found = (t.name.removeprefix(f"{self.name}_v") for t in self.spark.catalog.listTables(pattern=f"{self.name}_v*"))
        return sorted(int(n) for n in found if n.isdigit())

    def create(self, rows: DataFrame) -> None:
        self._write(rows.repartition(self.buckets, *self.keys), 0)

    def read(self) -> DataFrame:
        return self.spark.table(f"{self.name}_v{self._versions()[-1]}")

    def merge(self, merged: Callable[[DataFrame], DataFrame]) -> None:
        """Write ``merged(stored)``, an outer join of the stored rows with changes on the keys, as the next version.

        The join leaves every row in its key's bucket, so nothing moves but the changes.
        """
        last = self._versions()[-1]
        self._write(merged(self.read()), last + 1)
        for old in self._versions():
            if old < last:
                self.spark.sql(f"DROP TABLE {self.name}_v{old}")
                remove(self.spark, f"{self.root}/v{old}")

    def _write(self, rows: DataFrame, number: int) -> None:
        write_bucketed(rows, f"{self.name}_v{number}", list(self.keys), self.buckets, f"{self.root}/v{number}")

    def drop(self) -> None:
        for number in self._versions():
            self.spark.sql(f"DROP TABLE {self.name}_v{number}")
            remove(self.spark, f"{self.root}/v{number}")


def score_csv_rows(scores: DataFrame) -> DataFrame:
    """The twelve columns of the score file, dates as ISO-8601 text."""
    return scores.select(
        F.col("metadata_id").alias("pid"),
        F.col("metadata_format_id").alias("formatId"),
        S.iso_millis(F.col("date_uploaded")).alias("dateUploaded"),
        "datasource",
        F.col("score_overall").alias("scoreOverall"),
        F.col("score_findable").alias("scoreFindable"),
        F.col("score_accessible").alias("scoreAccessible"),
        F.col("score_interoperable").alias("scoreInteroperable"),
        F.col("score_reusable").alias("scoreReusable"),
        "obsoletes",
        F.col("obsoleted_by").alias("obsoletedBy"),
        F.col("sequence_id").alias("sequenceId"),
    )


def write_score_csv(scores: DataFrame, path: str) -> None:
    score_csv_rows(scores).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def run_xml(runs: DataFrame, unescape: bool = False) -> DataFrame:
    """Adds ``run_xml``, the run as an XML document.

    ``runs(run_id, pid, suite_id, run_status, results)``. With ``unescape`` the
    five entities of the text become plain characters.
    """

    def one(r: Column) -> Column:
        return F.struct(
            F.struct(
                r.check_id.alias("id"), r["name"].alias("name"), r.type.alias("type"), r.level.alias("level")
            ).alias("check"),
            F.transform(r.output, lambda o: F.struct(o.value.alias("_VALUE"), o.type.alias("_type"), o.identifier.alias("_identifier"))).alias("output"),
            r.status.alias("status"),
        )

    body = F.struct(
        F.col("run_id").cast("string").alias("id"),
        F.col("pid").cast("string").alias("objectIdentifier"),
        F.col("suite_id").alias("suiteId"),
        F.col("run_status").alias("runStatus"),
        F.transform("results", one).alias("result"),
    )
    text = F.to_xml(body, {"rowTag": "run"})
    return runs.withColumn("run_xml", S.xml_unescape(text) if unescape else text)


RUN_XML = (
    "struct<id:string,objectIdentifier:string,suiteId:string,runStatus:string,"
    "result:array<struct<check:struct<id:string,name:string,type:string,level:string>,"
    "output:array<struct<_VALUE:string,_type:string,_identifier:string>>,status:string>>,_corrupt:string>"
)


def read_run_xml(text: Column, xsd_path: str | None = None) -> Column:
    """Run document to a struct; with an XSD, invalid documents land in ``_corrupt``."""
    options = {"columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    if xsd_path:
        options["rowValidationXSDPath"] = xsd_path
    return F.from_xml(text, RUN_XML, options)


def to_json_text(value: Column) -> Column:
    """Object to JSON text, nulls kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def from_json_text(text: Column, schema: StructType | str) -> Column:
    return F.from_json(text, schema)


@F.arrow_udf(StringType())
def xml_to_json(bodies: pa.Array) -> pa.Array:
    """Whole XML documents as JSON texts, whatever elements they have.

    An element is its text, or an object of its attributes (``_name``), its
    children by name, repeated ones as a list, and its own text (``_VALUE``);
    names lose their prefix. A text that is not well formed gives null.
    """
    import json
    from xml.etree import ElementTree

    local = lambda name: name.rsplit("}", 1)[-1]

    def value(root):
        # Children are finished before their parent, without recursion.
        done, stack = {}, [(root, False)]
        while stack:
            node, ready = stack.pop()
            if not ready:
                stack.append((node, True))
                stack.extend((child, False) for child in node)
                continue
            fields = {f"_{local(k)}": v for k, v in node.attrib.items()}
            for child in node:
                name, found = local(child.tag), done.pop(id(child))
                if name in fields:
                    if not isinstance(fields[name], list):
                        fields[name] = [fields[name]]
                    fields[name].append(found)
                else:
                    fields[name] = found
            text = "".join([node.text or ""] + [c.tail or "" for c in node])
            if not fields:
                done[id(node)] = text
                continue
            if text.strip():
                fields["_VALUE"] = text
            done[id(node)] = fields
        return done[id(root)]

    def one(body):
        try:
            root = ElementTree.fromstring(body)
        except (ElementTree.ParseError, ValueError, TypeError):
            return None
        return json.dumps({local(root.tag): value(root)}, ensure_ascii=False)

    return pa.array([one(b) for b in bodies.to_pylist()], pa.string())


def report_file(text: Column) -> Column:
    """Size and checksum under which a report is stored."""
    return F.struct(S.byte_size(text).alias("size"), S.checksum(text).alias("sha1"))
