"""Collections: membership, access, and the scores of their members."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from qualityspark.operators.harvest import coordinating_pattern

# Fixed value: the clause of a collection query that keeps newest versions only.
HEAD_CLAUSE = r"\s*AND\s*\(-obsoletedBy:\*\s*AND\s*formatType:METADATA\)"


def all_versions(query: Column) -> Column:
    """Collection query without the clause that keeps newest versions only."""
    return F.regexp_replace(query, HEAD_CLAUSE, "")


def current_collections(collections: DataFrame) -> DataFrame:
    """Newest definition of every collection."""
    return collections.filter(F.col("obsoleted_by").isNull())


def active_collections(collections: DataFrame, usage: DataFrame) -> DataFrame:
    active = usage.filter(F.lower("status") == "active").select("collection_id")
    return collections.join(active, "collection_id", "left_semi")


def readable_by(read_subjects: Column, rights_holder: Column, subjects: Column) -> Column:
    """Public, or readable or held by one of the subjects."""
    return (
        F.array_contains(read_subjects, "public")
        | F.arrays_overlap(read_subjects, subjects)
        | F.array_contains(subjects, rights_holder)
    )


def owner_subjects(collections: DataFrame, membership: DataFrame) -> DataFrame:
    """Subjects each collection's owner acts as: the owner and the owner's groups."""
    own = collections.select("collection_id", F.col("rights_holder").alias("subject"))
    groups = own.join(membership.withColumnRenamed("subject", "_member"), F.col("subject") == F.col("_member"))
    return own.unionByName(groups.select("collection_id", F.col("group").alias("subject"))).distinct()


@dataclass(frozen=True)
class OneOf:
    """A column that has one of some values, compared as text."""

    column: str
    values: tuple


@dataclass(frozen=True)
class Between:
    """A number, date or time within bounds; None is no bound, ``open`` leaves a bound itself out."""

    column: str
    low: float | str | None = None
    high: float | str | None = None
    open: bool = False


@dataclass(frozen=True)
class Rule:
    """A collection's documents are those that meet all conditions; of several rules with one id, any will do."""

    collection_id: str
    conditions: tuple[OneOf | Between, ...] = ()


#: Ranges of a column are found by this many equal buckets between their outermost bounds.
BUCKETS = 256

_CONDITION = "array<struct<column:string,among:array<string>,low:double,high:double,open:boolean>>"


def _number(column: Column, kind: DataType) -> Column:
    """A value as a number, times as microseconds."""
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def _meets(given: Column) -> Callable[[Column], Column]:
    """Whether a condition holds for a document's values, ``texts`` and ``numbers`` by column."""

    def test(c: Column) -> Column:
        v = F.element_at(given["numbers"], c["column"])
        inside = (c["low"].isNull() | (v > c["low"]) | (~c["open"] & (v == c["low"]))) & (c["high"].isNull() | (v < c["high"]) | (~c["open"] & (v == c["high"])))
        among = F.array_contains(c["among"], F.element_at(given["texts"], c["column"]))
        return F.coalesce(F.when(c["among"].isNotNull(), among).otherwise(inside & v.isNotNull()), F.lit(False))

    return test


def matching(sysmeta: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of every collection whose rules they meet, with ``collection_id``; a row comes once for each.

    Rules are rows, not expressions, so the plan does not grow with them. A rule
    is found by one of its conditions: by a value where it asks for some, else
    by the buckets of a range. Only rows that hit a rule's value or bucket meet
    its conditions; rules without any take all rows, which cannot be helped.
    """
    spark = sysmeta.sparkSession
    kinds = {f.name: f.dataType for f in sysmeta.schema.fields}
    used = dict.fromkeys(c.column for r in rules for c in r.conditions)
    bounds = {c.column: [] for r in rules for c in r.conditions if isinstance(c, Between)}
    as_number = _bound_numbers(spark, kinds, [c for r in rules for c in r.conditions if isinstance(c, Between)])
    for c, (low, high) in as_number.items():
        bounds[c.column] += [x for x in (low, high) if x is not None]
    grid = {c: (min(b), max(b)) if b and min(b) < max(b) else None for c, b in bounds.items()}

    def bucket(column: str, x: float | None, otherwise: int) -> int:
        """As ``width_bucket``: 0 below the first bound, ``BUCKETS + 1`` from the last on."""
        if x is None or grid[column] is None:
            return otherwise
        low, high = grid[column]
        return 0 if x < low else BUCKETS + 1 if x >= high else int(BUCKETS * ((x - low) / (high - low))) + 1

    index = []
    for rule in rules:
        conditions = [
            (c.column, [str(v) for v in c.values], None, None, False) if isinstance(c, OneOf) else (c.column, None, *as_number[c], c.open) for c in rule.conditions
        ]
        lead = next((c for c in rule.conditions if isinstance(c, OneOf)), next(iter(rule.conditions), None))
        if lead is None:
            keys = [("", "")]
        elif isinstance(lead, OneOf):
            keys = [(lead.column, v) for v in dict.fromkeys(map(str, lead.values))]
        elif grid[lead.column] is None:
            keys = [(lead.column, "#")]
        else:
            low, high = as_number[lead]
            # One bucket more on each side, so that no rounding of a bound matters.
            span = range(max(bucket(lead.column, low, 0) - 1, 0), min(bucket(lead.column, high, BUCKETS + 1) + 1, BUCKETS + 1) + 1)
            keys = [(lead.column, f"#{b}") for b in span]
        index += [(column, value, rule.collection_id, conditions) for column, value in keys]
    asked = spark.createDataFrame(index, f"_column string, _value string, collection_id string, _conditions {_CONDITION}")

    texts = F.map_from_arrays(F.array(*map(F.lit, used)), F.array(*(F.col(c).cast("string") for c in used))) if used else F.expr("CAST(map() AS map<string,string>)")
    ranged = [*bounds]
    numbers = F.map_from_arrays(F.array(*map(F.lit, ranged)), F.array(*(_number(F.col(c), kinds[c]) for c in ranged))) if ranged else F.expr("CAST(map() AS map<string,double>)")
    leads = {k[0] for k in index}
    keys = [F.struct(F.lit("").alias("_column"), F.lit("").alias("_value"))] if "" in leads else []
    for c in used:
        if c in leads:
            keys.append(F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value")))
            if c in bounds:
                place = F.lit("#") if grid[c] is None else F.concat(F.lit("#"), F.width_bucket(_number(F.col(c), kinds[c]), F.lit(grid[c][0]), F.lit(grid[c][1]), F.lit(BUCKETS)).cast("string"))
                keys.append(F.struct(F.lit(c).alias("_column"), place.alias("_value")))
    if not keys:
        return sysmeta.withColumn("collection_id", F.lit(None).cast("string")).limit(0)
    own = [F.col(c) for c in sysmeta.columns]
    tried = sysmeta.select(*own, F.struct(texts.alias("texts"), numbers.alias("numbers")).alias("_given"), F.explode(F.array(*keys)).alias("_key"))
    tried = tried.select(*sysmeta.columns, "_given", "_key._column", "_key._value").filter("_value IS NOT NULL")
    hits = tried.join(asked, ["_column", "_value"]).filter(F.forall("_conditions", _meets(F.col("_given"))))
    out = hits.select(*sysmeta.columns, "collection_id")
    # A row that meets several rules of a collection comes once: only then is there something to take out.
    several = len({r.collection_id for r in rules}) < len(rules)
    return out.dropDuplicates(["collection_id", "pid"]) if several else out


def _bound_numbers(spark: SparkSession, kinds: Mapping[str, DataType], ranges: list[Between]) -> dict[Between, tuple[float | None, float | None]]:
    """Bounds as numbers, those written as text by the type of their column."""
    rows = [(i, c.column, None if b is None else str(b)) for i, c in enumerate(ranges) for b in (c.low, c.high)]
    if not rows:
        return {}
    given = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, i long, column string, bound string")
    number = F.lit(None).cast("double")
    for c in dict.fromkeys(r.column for r in ranges):
        number = F.when(F.col("column") == c, _number(F.col("bound").cast(kinds[c]), kinds[c])).otherwise(number)
    # Rules are configuration: two numbers a range.
    found = [r.x for r in given.select("n", number.alias("x")).orderBy("n").collect()]
    return {c: (found[2 * i], found[2 * i + 1]) for i, c in enumerate(ranges)}


def members(matched: DataFrame, subjects: DataFrame) -> DataFrame:
    """Pids of each collection its owner may read.

    Public documents, usually most of them, pass without a join. The others are
    joined by subject and de-duplicated.
    """
    public = F.array_contains("read_subjects", "public")
    open_ = matched.filter(public).select("collection_id", "pid")
    closed = matched.filter(~F.coalesce(public, F.lit(False))).select(
        "collection_id",
        "pid",
        F.explode(
            F.array_distinct(
                F.concat(F.coalesce("read_subjects", F.array().cast("array<string>")), F.array("rights_holder"))
            )
        ).alias("subject"),
    )
    allowed = closed.join(subjects, ["collection_id", "subject"], "left_semi").select("collection_id", "pid").distinct()
    return open_.unionByName(allowed)


def format_family(format_id: Column, families: str | None) -> Column:
    """True where the format id holds one of the comma-divided family names."""
    if not families:
        return F.lit(True)
    test = F.lit(False)
    for family in families.split(","):
        test = test | format_id.contains(family.strip())
    return test


def node_scores(
    scores: DataFrame, node_id: str, suite_id: str | None = None, families: str | None = None, apply_format: bool = False
) -> DataFrame:
    """Scores of a node's documents; a coordinating node stands for all nodes.

    The format family is left out of node collections unless ``apply_format``.
    """
    out = scores if suite_id is None else scores.filter(F.col("suite_id") == suite_id)
    if not re.match(coordinating_pattern(), node_id):
        out = out.filter(F.col("datasource") == node_id)
    return out.filter(format_family(F.col("metadata_format_id"), families)) if apply_format else out


def member_scores(
    scores: DataFrame, pids: DataFrame, suite_id: str | None = None, families: str | None = None
) -> DataFrame:
    """Scores of each collection's members, as one join."""
    out = scores if suite_id is None else scores.filter(F.col("suite_id") == suite_id)
    out = out.filter(format_family(F.col("metadata_format_id"), families))
    return out.join(pids.withColumnRenamed("pid", "metadata_id"), "metadata_id")
