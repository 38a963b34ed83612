"""Lookups that enrich documents, runs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityspark.functions import scalars as S
from qualityspark.session import cut_lineage


NO_SYSMETA = "system metadata not found"


def with_sysmeta(docs: DataFrame, sysmeta: DataFrame) -> DataFrame:
    """Documents with their system metadata as one struct.

    A document whose metadata is missing stays, with the reason in
    ``sysmeta_error``; a suite run over it is a failed run. So does one whose
    metadata could not be read (``error`` of ``system_metadata``).
    """
    fields = [F.col(c) for c in sysmeta.columns if c != "error"]
    reason = F.col("error") if "error" in sysmeta.columns else F.lit(None).cast("string")
    packed = sysmeta.select(F.col("identifier").alias("pid"), F.struct(*fields).alias("sysmeta"), reason.alias("_reason"))
    joined = docs.join(packed, "pid", "left")
    missing = F.when(F.col("sysmeta").isNull(), NO_SYSMETA)
    return joined.withColumn("sysmeta_error", F.coalesce("_reason", missing)).drop("_reason")


def data_objects(docs: DataFrame, objects: DataFrame) -> DataFrame:
    """Data objects of every document, the document itself left out.

    Long form, one row per object and one with a null for a document without
    any, so a document with very many objects stays many rows.
    """
    links = objects.filter(F.col("data_pid") != F.col("pid")).select("pid", "data_pid")
    return docs.select("pid").join(links, "pid", "left")


def data_counts(docs: DataFrame, objects: DataFrame) -> DataFrame:
    counts = objects.filter(F.col("data_pid") != F.col("pid")).groupBy("pid").agg(F.count(F.lit(1)).alias("n_data"))
    return docs.join(counts, "pid", "left").withColumn("n_data", F.coalesce("n_data", F.lit(0).cast("bigint")))


def group_lookup(rights_holders: DataFrame, membership: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Groups of each rights holder, one row per group.

    A person gives the person's groups, a group subject itself, and a subject
    that is neither gives nothing. ``membership(subject, group)``;
    ``people(subject)`` lists persons, and is taken from ``membership`` if absent.
    """
    entry = lambda subject, group, person: F.struct(subject.alias("subject"), group.alias("group"), F.lit(person).alias("person"))
    member, group = F.col("subject"), F.col("group")
    known = membership.select(F.inline(F.array(entry(member, group, True), entry(group, group, False))))
    if people is not None:
        known = known.unionByName(people.select("subject", F.lit(None).cast("string").alias("group"), F.lit(True).alias("person")))
    # One row per subject: a person's groups, or the group itself if it is no person.
    subjects = known.groupBy("subject").agg(F.collect_set(F.struct("person", "group")).alias("_all"), F.bool_or("person").alias("_person"))
    own = F.filter("_all", lambda g: (g["person"] == F.col("_person")) & g["group"].isNotNull())
    subjects = subjects.select(F.col("subject").alias("rights_holder"), F.transform(own, lambda g: g["group"]).alias("_groups"))
    return rights_holders.join(subjects, "rights_holder").select(*rights_holders.columns, F.explode("_groups").alias("group"))


def award_lookup(docs: DataFrame, awards: DataFrame) -> DataFrame:
    """Outputs of each award a document names; unknown awards give nothing.

    ``docs(pid, awards)`` with a null list is FAILURE with output ``NA``.
    """
    missing = docs.filter("awards IS NULL").select(
        "pid", F.lit(0).alias("position"), F.lit("FAILURE").alias("status"), F.lit("NA").alias("output")
    )
    # Documents without awards never reach the join, in which they would be one key.
    named = docs.select("pid", F.posexplode("awards").alias("position", "award")).filter("award IS NOT NULL")
    title = F.format_string("%s (%s %s)", "title", "agency", "id")
    joined = named.withColumn("id", S.award_key(F.col("award"))).join(awards, "id")
    fields = F.array(title, "title", "agency", "id", "fund_program_name", "primary_program")
    return joined.select("pid", "position", F.lit("SUCCESS").alias("status"), F.explode(fields).alias("output")).unionByName(missing)


def extension_of(files: DataFrame, media_types: DataFrame) -> DataFrame:
    """File extension by media type.

    The types are written first: Spark then knows their size, and files, of which very many have one type, need not move by it.
    """
    types = cut_lineage(media_types.select(F.lower("name").alias("_name"), F.col("extension")))
    return files.join(types, F.lower("media_type") == F.col("_name"), "left").drop("_name")


def media_type_of(files: DataFrame, media_types: DataFrame) -> DataFrame:
    """Media type by file extension, in any case."""
    types = media_types.groupBy(F.lower("extension").alias("_ext")).agg(F.min("name").alias("media_type"))
    return files.join(types, F.lower("extension") == F.col("_ext"), "left").drop("_ext")


def file_lookup(requests: DataFrame, files: DataFrame) -> DataFrame:
    """File entry of each request: by storage and file name if a name is given,
    otherwise by pid, suite, storage and media type. Two equality joins."""
    named = F.coalesce(F.length("alt_filename"), F.lit(0)) > 0
    by_name = ["storage_type", "alt_filename"]
    by_pid = ["pid", "suite_id", "storage_type", "media_type"]
    entry = lambda keys: files.groupBy(*keys).agg(F.min("file_id").alias("file_id"))
    return (
        requests.filter(named)
        .join(entry(by_name), by_name, "left")
        .unionByName(requests.filter(~named).join(entry(by_pid), by_pid, "left"))
    )


def with_path(files: DataFrame, media_types: DataFrame) -> DataFrame:
    return extension_of(files, media_types).withColumn(
        "path",
        S.relative_path(F.col("storage_type"), F.col("alt_filename"), F.col("file_id"), F.col("extension")),
    )


def fetch_with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Body from the first source, or from the second where the first has none."""
    has = primary.filter("body IS NOT NULL")
    first = has.select("pid", "body", F.lit("primary").alias("source"))
    # Only keys of the first source move; its bodies stay where they are read.
    second = fallback.join(has.select("pid"), "pid", "left_anti")
    second = second.select("pid", "body", F.when(F.col("body").isNotNull(), "fallback").alias("source"))
    neither = primary.filter("body IS NULL").select("pid").join(fallback.select("pid"), "pid", "left_anti")
    nothing = F.lit(None).cast("string")
    return first.unionByName(second).unionByName(neither.select("pid", nothing.alias("body"), nothing.alias("source")))
