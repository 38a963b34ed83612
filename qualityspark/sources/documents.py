"""Document scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from qualityspark import schemas
from qualityspark.functions.extract import is_json_format


def text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: ``path, body``. For XML and JSON documents alike."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def record_documents(spark: SparkSession, path: str, row_tag: str, fields: StructType, glob: str | None = None) -> DataFrame:
    """Rows of XML files that hold many records each, one element ``row_tag`` a line.

    Such files are split, so one of any size is read by many tasks, and a record
    is read once, straight into ``fields`` (attributes as ``_name``). One that
    the reader refuses, or that has a value of another type, keeps a row, with
    its text in ``corrupt`` and nulls; text behind a number does not count.
    """
    reader = spark.read.format("xml").schema(StructType([*fields.fields, StructField("corrupt", StringType())]))
    reader = reader.option("rowTag", row_tag).option("multiLine", "false").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path)
    read = F.col("corrupt").isNull()
    return rows.select(*(F.when(read, F.col(f.name)).alias(f.name) for f in fields.fields), "corrupt")


def routed(docs: DataFrame) -> DataFrame:
    """Adds the dialect of each document, chosen by its format id."""
    return docs.withColumn("dialect", F.when(is_json_format(F.col("format_id")), "json").otherwise("xml"))


def system_metadata(docs: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """System metadata of either version from XML texts.

    A text that cannot be read gives a row with the reason in ``error`` and
    nulls; ``keep`` names columns that tell which document it belongs to.
    """
    x = F.from_xml(
        F.col(body),
        schemas.SYSMETA_XML,
        {"columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"},
    )
    return (
        docs.select(*(keep or []), x.alias("x"))
        .withColumn("error", F.when(F.col("x").isNull() | F.col("x._corrupt").isNotNull(), "system metadata cannot be read"))
        .withColumn("x", F.when(F.col("error").isNull(), F.col("x")))
        .select(
            *(keep or []),
            "error",
            F.col("x.identifier").alias("identifier"),
            F.col("x.formatId").alias("format_id"),
            F.col("x.size").alias("size"),
            F.when(
                F.col("x.checksum").isNotNull(),
                F.struct(F.col("x.checksum._algorithm").alias("algorithm"), F.col("x.checksum._VALUE").alias("value")),
            ).alias("checksum"),
            F.col("x.submitter").alias("submitter"),
            F.col("x.rightsHolder").alias("rights_holder"),
            F.transform(
                "x.accessPolicy.allow",
                lambda a: F.struct(a.subject.alias("subjects"), a.permission.alias("permissions")),
            ).alias("access"),
            F.col("x.obsoletes").alias("obsoletes"),
            F.col("x.obsoletedBy").alias("obsoleted_by"),
            F.col("x.seriesId").alias("series_id"),
            F.col("x.archived").alias("archived"),
            F.col("x.dateUploaded").alias("date_uploaded"),
            F.col("x.dateSysMetadataModified").alias("date_sysmetadata_modified"),
            F.col("x.originMemberNode").alias("origin_member_node"),
            F.col("x.authoritativeMemberNode").alias("authoritative_member_node"),
            F.col("x.fileName").alias("file_name"),
        )
    )


def readers(access) -> DataFrame:
    """Subjects an access policy lets read."""
    may_read = F.filter(access, lambda a: F.exists(a.permissions, lambda p: p == "read"))
    return F.array_distinct(F.flatten(F.transform(may_read, lambda a: a.subjects)))


def staged_files(
    spark: SparkSession, root: str, directories: list[str], glob: str = "*", exclude: list[str] | None = None
) -> DataFrame:
    """Files below the included top directories, with path, size and time; the
    bytes are read only if ``content`` is selected. A file whose path matches one
    of the ``exclude`` patterns (of a task's filter list) is left out."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load([f"{root.rstrip('/')}/{d}" for d in directories])
    )
    for pattern in exclude or []:
        files = files.filter(~F.col("path").rlike(pattern))
    return files
