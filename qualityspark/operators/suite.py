"""Suite runs: every check of a suite over every document.

A run stays one row: the results are an array on the document's row, so
assessing and scoring documents needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.functions.extract import DocumentReader, Selector, is_json_format, json_query, json_texts, with_values
from qualityspark.functions.scalars import iso_millis
from qualityspark.operators.checks import OUTPUT_TYPE, Check, CheckRef, Registry, Suite, outcome

RESULT_TYPE = (
    "array<struct<position:int,check_id:string,name:string,type:string,level:string,"
    f"status:string,output:{OUTPUT_TYPE}>>"
)
SCHEMA_ORG = "https://schema.org/"
# Outputs of checks that are not run, and of a data suite without data.
MISSING_MESSAGE = "Could not locate referenced check in store: "
DIALECT_MESSAGE = "Dialect for this check is not supported"
NO_DATA_MESSAGE = "Could not retrieve data objects."


def resolve(suite: Suite, registry: Registry) -> list[tuple[CheckRef, Check | None]]:
    """Each reference with its check, whose type and level the reference overrides."""
    out = []
    for ref in suite.checks:
        check = registry.get(ref.check_id)
        if check is not None:
            check = replace(check, type=ref.type or check.type, level=ref.level or check.level)
        out.append((ref, check))
    return out


def applies(
    check: Check, reader: DocumentReader, tests: dict, is_json: Column, body: Column, strict_json: bool
) -> Column:
    """True when the check lists no dialect, or one of its dialects fits the document."""
    if check.dialects is None:
        return F.lit(True)
    xml = F.lit(False)
    for d in check.dialects:
        if d.xpath is not None:
            # A test that cannot be read fits no document.
            xml = xml | F.coalesce(F.element_at(reader.values(tests[d.xpath]), 1) == "true", F.lit(False))
    json = F.lit(True)
    if strict_json:
        json = F.lit(False)
        for d in check.dialects:
            if d.json_path is not None:
                texts = json_texts(body, d.json_path, node=F.col("_node"))
                json = json | F.coalesce(texts == F.array(F.lit(SCHEMA_ORG)), F.lit(False))
    return F.when(is_json, json).otherwise(xml)


def run_suite(
    docs: DataFrame,
    suite: Suite,
    registry: Registry,
    params: Mapping[str, str] | None = None,
    strict_json: bool = False,
    json_scalars: bool = False,
) -> DataFrame:
    """Run ``suite`` over ``docs(pid, format_id, body)``.

    Optional columns of ``docs``: ``sysmeta`` (struct) for the system-metadata
    variables, ``data_pids`` (list), and ``n_data`` for suites whose id starts with ``data-suite``,
    which fail on documents without data objects, and ``sysmeta_error``, which
    makes a run fail with that reason. Returns ``pid, suite_id,
    run_status, error_description, results``, and keeps ``sysmeta``.
    """
    steps = resolve(suite, registry)
    checks = [c for _, c in steps if c is not None]
    selectors = {s for c in checks for s in c.selectors}
    bound = {s: replace(s, namespaces={**suite.namespaces, **s.namespaces}) for s in selectors}
    tests = {
        d.xpath: Selector(f"dialect:{d.xpath}", _as_boolean(d.xpath))
        for c in checks
        for d in c.dialects or ()
        if d.xpath is not None
    }
    reader = DocumentReader([*bound.values(), *tests.values()])

    is_json = is_json_format(F.col("format_id"))
    body = F.col("body")
    parsed = reader.attach(docs.withColumn("_json", is_json), when=~is_json)
    parsed = parsed.withColumn("_node", F.when(F.col("_json"), F.try_parse_json(body)))
    has_system = "sysmeta" in docs.columns

    # One staged column per distinct selector and dialect, so that checks share them.
    values = {s: f"v{i}" for i, s in enumerate(sorted(selectors, key=repr))}
    # A selector that reads one kind of document only gives null for the other.
    refused = {s: why for s in values if (why := _refused(s, bound[s], reader)) is not None}
    plain = {
        name: _texts(s, bound[s], reader, body, json_scalars)
        for s, name in values.items()
        if s.sub is None and s not in refused
    }
    nested = {name: reader.nested(bound[s]) for s, name in values.items() if s.sub is not None and s not in refused}
    staged = with_values(parsed, plain, "_json").withColumns(
        nested
        | {
            f"a{i}": applies(c, reader, tests, F.col("_json"), body, strict_json)
            for i, (_, c) in enumerate(steps)
            if c is not None and c.dialects is not None
        }
        | {"_ok": F.when(F.col("_json"), F.col("_node").isNotNull()).otherwise(reader.ok)}
    )

    base: dict[str, Column] = {
        "document": body,
        "pid": F.col("pid"),
        "params": F.create_map(*[F.lit(x) for kv in (params or {}).items() for x in kv]).cast("map<string,string>"),
        "sysmeta": F.col("sysmeta") if has_system else F.lit(None),
    }
    if has_system:
        system = F.col("sysmeta")
        base |= {
            "datasource": system["origin_member_node"],
            "dateUploaded": iso_millis(system["date_uploaded"]),
            "authoritativeMemberNode": system["authoritative_member_node"],
            "systemMetadataPid": system["identifier"],
        }
    for name, column in (("n_data", "n_data"), ("dataPids", "data_pids")):
        if column in docs.columns:
            base[name] = F.col(column)

    # Outcomes are staged columns: they are used twice below, and Python checks
    # run only as columns of their own. Checks that inherit state need the
    # outcome before them, so theirs are staged later.
    results, carried, pending = [], {}, {}
    for position, (ref, check) in enumerate(steps):
        if check is None:
            missing = outcome(F.lit("SKIP"), F.lit(MISSING_MESSAGE + ref.check_id))
            results.append(_result(position, ref.check_id, None, ref.type, ref.level, missing))
            continue
        inherits = check.inherit_state and carried
        if inherits:
            staged, pending = staged.withColumns(pending), {}
        own = {s.name: F.col(values[s]) for s in check.selectors if s not in refused}
        variables = {**base, **(carried if inherits else {}), **own}
        unread = [refused[s] for s in check.selectors if s in refused]
        # One selector that cannot be read is an error of its check, not of the suite.
        done = outcome(F.lit("ERROR"), F.lit("; ".join(unread))) if unread else check.run(variables)
        done, state = done if isinstance(done, tuple) else (done, {})
        if check.dialects is not None:
            skip = outcome(F.lit("SKIP"), F.lit(DIALECT_MESSAGE))
            if state and any(callable(s) for s in state.values()):
                skip = skip.withField("state", F.lit(None).cast("map<string,string>"))
            done = F.when(F.col(f"a{position}"), done).otherwise(skip)
        own_outcome = F.col(f"c{position}")
        pending[f"c{position}"] = done
        # What a check computes is a variable of the checks after it: a column of the
        # variables, staged here, or a function of the staged outcome.
        computed = {}
        for name, value in state.items():
            if callable(value):
                computed[name] = value(own_outcome)
            else:
                pending[f"s{position}_{name}"] = value
                computed[name] = F.col(f"s{position}_{name}")
        carried = {**variables, **computed, "previous_status": own_outcome["status"]}
        results.append(_result(position, check.id, check.name, check.type, check.level, F.col(f"c{position}")))
    staged = staged.withColumns(pending)

    if "sysmeta_error" in docs.columns:
        staged = staged.withColumn("_ok", F.col("_ok") & F.col("sysmeta_error").isNull())
    reason = F.col("sysmeta_error") if "sysmeta_error" in docs.columns else F.lit(None).cast("string")
    failed = F.when(~F.coalesce(F.col("_ok"), F.lit(False)), F.coalesce(reason, reader.error, F.lit("document cannot be parsed")))
    if suite.id.startswith("data-suite") and "n_data" in docs.columns:
        no_data = F.coalesce(F.col("n_data"), F.lit(0)) == 0
        failed = F.coalesce(failed, F.when(no_data, F.lit(NO_DATA_MESSAGE)))
    keep = ["sysmeta"] if has_system else []
    return staged.select(
        "pid",
        F.lit(suite.id).alias("suite_id"),
        F.when(failed.isNull(), "success").otherwise("failure").alias("run_status"),
        failed.alias("error_description"),
        F.when(failed.isNull(), F.array(*results).cast(RESULT_TYPE)).alias("results"),
        *keep,
    )


def _refused(selector: Selector, bound: Selector, reader: DocumentReader) -> str | None:
    """Why a selector cannot be read, or None."""
    if bound in reader.refused:
        return reader.refused[bound]
    if selector.json_path is not None:
        try:
            json_query(selector.json_path)
        except ValueError as exc:
            return str(exc)
    return None


def _as_boolean(expr: str) -> str:
    """A dialect test is read as text and then as a boolean, so only ``true`` counts."""
    return expr.strip()


def _texts(selector: Selector, bound: Selector, reader: DocumentReader, body: Column, json_scalars: bool) -> Column:
    none = F.lit(None).cast("array<string>")
    xml = reader.values(bound) if selector.xpath is not None else none
    if selector.json_path is None:
        return F.when(~F.col("_json"), xml)
    return F.when(F.col("_json"), json_texts(body, selector.json_path, json_scalars, F.col("_node"))).otherwise(xml)


def _result(position: int, check_id: str, name, type_, level, done: Column) -> Column:
    text = lambda v: F.lit(v).cast("string")
    return F.struct(
        F.lit(position).alias("position"),
        text(check_id).alias("check_id"),
        text(name).alias("name"),
        text(type_).alias("type"),
        text(level).alias("level"),
        done["status"].alias("status"),
        done["output"].alias("output"),
    )


def run_check(docs: DataFrame, check: Check, params: Mapping[str, str] | None = None) -> DataFrame:
    """Run a single check over every document."""
    suite = Suite(check.id, (CheckRef(check.id),))
    return run_suite(docs, suite, Registry([check]), params)


def explode_results(runs: DataFrame, *keep: str) -> DataFrame:
    """One row per run and check.

    The outer generator keeps Spark from inferring a filter on the array's
    size, which would compute every result a second time below the generator.
    """
    rows = runs.select("pid", "suite_id", *keep, F.inline_outer("results"))
    return rows.filter("check_id IS NOT NULL")


def resolve_references(suites: DataFrame, checks: DataFrame) -> DataFrame:
    """Table form of the reference rule, for definitions kept as tables.

    ``suites(suite_id, position, check_id, type_override, level_override)`` and
    ``checks(check_id, type, level, ...)``. A reference without a check stays,
    with status SKIP.
    """
    found = checks.select("check_id", "type", "level", F.lit(True).alias("_found"))
    joined = suites.join(found, "check_id", "left")
    return joined.select(
        "suite_id",
        "position",
        "check_id",
        F.coalesce("type_override", "type").alias("type"),
        F.coalesce("level_override", "level").alias("level"),
        F.when(F.col("_found").isNull(), "SKIP").alias("status"),
        F.when(
            F.col("_found").isNull(),
            F.concat(F.lit(MISSING_MESSAGE), F.col("check_id").cast("string")),
        ).alias("output"),
    )


#: No white space, and a slash or a dot somewhere.
PATH_LIKE = r"^\S*[/\\.]\S*$"


def encode_file_outputs(results: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs that name a file become the base64 text of its bytes.

    ``results`` holds one output per row in ``value``; ``files(path, content)``
    is a binary file scan. Only values that can be a path meet the files, so a
    message that very many results share is no join key.
    """
    can_be = F.coalesce(F.col("value").rlike(PATH_LIKE), F.lit(False))
    named = files.select(F.col("path").alias("value"), F.base64("content").alias("_encoded"))
    encoded = results.filter(can_be).join(named, "value", "left").withColumn("value", F.coalesce("_encoded", "value"))
    return encoded.select(*results.columns).unionByName(results.filter(~can_be))
