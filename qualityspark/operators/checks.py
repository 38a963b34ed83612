"""Checks: definitions, built-in Column checks and Python checks.

A check is a function from its variables to an outcome. Column checks build
Spark expressions; Python checks run opaque code in Arrow batches. Both return
the same ``status`` and ``output`` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from qualityspark.functions import scalars as S
from qualityspark.functions.extract import Selector

OUTPUT_TYPE = "array<struct<value:string,type:string,identifier:string>>"
OUTCOME_TYPE = f"struct<status:string,output:{OUTPUT_TYPE}>"
_OUTCOME = pa.struct(
    [
        ("status", pa.string()),
        (
            "output",
            pa.list_(pa.struct([("value", pa.string()), ("type", pa.string()), ("identifier", pa.string())])),
        ),
    ]
)


@dataclass(frozen=True)
class Dialect:
    """Documents a check applies to: an XPath test, or a JSON path for JSON documents."""

    name: str
    xpath: str | None = None
    json_path: str | None = None


@dataclass(frozen=True)
class Check:
    id: str
    run: Callable[[Mapping[str, Column]], Column] | None = field(default=None, compare=False)
    name: str | None = None
    type: str | None = None
    level: str | None = None
    description: str | None = None
    environment: str = "spark"
    inherit_state: bool = False
    selectors: tuple[Selector, ...] = ()
    dialects: tuple[Dialect, ...] | None = None


@dataclass(frozen=True)
class CheckRef:
    """A check named in a suite; its type and level override the check's own."""

    check_id: str
    type: str | None = None
    level: str | None = None


@dataclass(frozen=True)
class Suite:
    id: str
    checks: tuple[CheckRef, ...]
    name: str | None = None
    namespaces: Mapping[str, str] = field(default_factory=dict, hash=False)


def messages(*texts: Column) -> Column:
    """Outputs without type and identifier."""
    one = lambda t: F.struct(
        t.cast("string").alias("value"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("identifier"),
    )
    return F.array(*[one(t) for t in texts]).cast(OUTPUT_TYPE)


def outcome(status: Column, message: Column | None = None, output: Column | None = None) -> Column:
    if output is None:
        output = messages(message) if message is not None else F.lit(None)
    return F.struct(status.cast("string").alias("status"), output.cast(OUTPUT_TYPE).alias("output"))


def list_output(values: Column, types: Column | None = None, identifiers: Column | None = None) -> Column:
    """Several outputs, each with its identifier and type."""
    blank = F.transform(values, lambda _: F.lit(None).cast("string"))
    zipped = F.arrays_zip(
        values.alias("value"),
        (types if types is not None else blank).alias("type"),
        (identifiers if identifiers is not None else blank).alias("identifier"),
    )
    return F.transform(
        zipped,
        lambda z: F.struct(
            z["value"].cast("string").alias("value"),
            z["type"].alias("type"),
            z["identifier"].alias("identifier"),
        ),
    )


def passed(condition: Column) -> Column:
    return F.when(condition, "SUCCESS").otherwise("FAILURE")


# Column checks ----------------------------------------------------------------


def longer_than(variable: str, n: int):
    """SUCCESS when the text is longer than ``n`` characters; a null text has no status."""

    def run(v):
        text = F.element_at(v[variable]["items"], 1)
        return outcome(F.when(S.longer_than(text, n), "SUCCESS").when(text.isNotNull(), "FAILURE"))

    return run


# What checks of texts and of presence say.
WORDS_MESSAGES = {
    "absent": "An {label} was not found.",
    "blank": "The {label} is blank",
    "few": "The {label} word count of '%d' is less that the recommended minimum of '{n}'",
    "enough": "The {label} is valid, with a word count of %d",
}
PRESENCE_MESSAGES = {
    "no list": "Object '{name}' was not a list, which is the expected type.",
    "empty": "Object '{name}' was of length zero when it was expected to be of length one.",
    "many": "Object '{name}' was of length %d when it was expected to be of length one.",
    "one": "Object '{name}' was present and was of length one.",
}


def min_words(variable: str, n: int, label: str = "abstract"):
    """SUCCESS when a text, or the texts of a list joined by blanks, has ``n`` words."""
    says = {k: m.format(label=label, n=n) for k, m in WORDS_MESSAGES.items()}

    def judge(items: Column, words: Column) -> Column:
        message = F.when(items.isNull(), says["absent"]).when(F.coalesce(words, F.lit(0)) == 0, says["blank"])
        message = message.when(words < n, F.format_string(says["few"], words)).otherwise(F.format_string(says["enough"], words))
        return outcome(passed(F.coalesce(words >= n, F.lit(False))), message)

    def run(v):
        items = v[variable]["items"]
        # A text of whitespace only counts no words here.
        words = S.let(
            S.strip(F.array_join(items, " ")),
            lambda text: F.when(text == "", 0).otherwise(S.count_words(text)),
        )
        return S.let(words, lambda w: judge(items, w))

    return run


def unique_items(variable: str):
    def run(v):
        items = v[variable]["items"]
        return outcome(passed(items.isNull() | ~S.has_duplicates(items)))

    return run


def any_present(variable: str):
    """SUCCESS when some item of the variable is not blank."""

    def run(v):
        found = ~S.all_blank(v[variable]["items"])
        return outcome(passed(F.coalesce(found, F.lit(False))))

    return run


def positive_count(variable: str):
    return lambda v: outcome(passed(F.coalesce(v[variable]["num"] > 0, F.lit(False))))


def present(variable: str):
    """A list variable of exactly one item passes; the message names the object."""

    def run(v):
        items = v[variable]["items"]
        status, message = presence(items, variable)
        return outcome(status, message)

    return run


def presence(items: Column, name: str) -> tuple[Column, Column]:
    n = F.size(items)
    status = F.when(items.isNotNull() & (n == 1), "SUCCESS").otherwise("FAILURE")
    says = {k: m.format(name=name) for k, m in PRESENCE_MESSAGES.items()}
    message = F.when(items.isNull(), says["no list"]).when(n == 0, says["empty"])
    message = message.when(n > 1, F.format_string(says["many"], n)).otherwise(says["one"])
    return status, message


def all_present(*variables: str):
    """Fold of several presence tests: one FAILURE sticks and messages append in order."""

    def run(v):
        parts = [presence(v[name]["items"], name) for name in variables]
        ok = F.lit(True)
        for status, _ in parts:
            ok = ok & (status == "SUCCESS")
        return outcome(passed(ok), output=messages(*[m for _, m in parts]))

    return run


def echo(variable: str):
    """SUCCESS and the value itself when there is one; otherwise FAILURE without output."""

    def run(v):
        text = F.array_join(v[variable]["items"], ", ")
        has = F.coalesce(F.length(text), F.lit(0)) > 0
        return outcome(passed(has), output=F.when(has, messages(text)))

    return run


def listed(variable: str):
    """SUCCESS and every item as an output of its own, named by its place."""

    def run(v):
        items = v[variable]["items"]
        places = F.transform(items, lambda _, i: (i + 1).cast("string"))
        has = F.coalesce(F.size(items), F.lit(0)) > 0
        return outcome(passed(has), output=F.when(has, list_output(items, identifiers=places)))

    return run


def computes(run: Callable, **state: Callable[[Mapping[str, Column]], Column]):
    """A check whose computed values are variables of later checks that inherit state."""
    return lambda v: (run(v), {name: value(v) for name, value in state.items()})


def echo_system(field_name: str):
    """Echo of a system-metadata field; FAILURE with ``NA`` when there is no system metadata."""

    def run(v):
        value = v["sysmeta"][field_name]
        has = v["sysmeta"].isNotNull()
        return outcome(passed(has), F.when(has, value).otherwise("NA"))

    return run


def in_time_frame(variable: str, latest: str):
    """SUCCESS for a date text not after the day ``latest``."""

    def run(v):
        day = F.try_to_date(F.element_at(v[variable]["items"], 1))
        return outcome(passed(F.coalesce(day <= F.lit(latest).cast("date"), F.lit(False))))

    return run


# Python checks ----------------------------------------------------------------


def _as_output(output, identifiers=None, types=None):
    if output is None:
        return None
    if isinstance(output, (list, tuple)):
        ids = identifiers or [None] * len(output)
        kinds = types or [None] * len(output)
        return [
            {"value": _text(o), "type": _text(k), "identifier": _text(i)} for o, k, i in zip(output, kinds, ids)
        ]
    return [{"value": _text(output), "type": None, "identifier": None}]


def _text(value):
    if value is None:
        return None
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


_PLAIN = {"number": "num", "boolean": "bool", "string": "str"}


def _plain(value):
    """A selected value as the Python object a check expects."""
    if not isinstance(value, dict) or "kind" not in value:
        return value
    if value["kind"] == "list":
        return value["items"]
    return value[_PLAIN[value["kind"]]] if value["kind"] else None


def python_check(fn: Callable, state: tuple[str, ...] = ()):
    """A check from a plain function ``fn(**variables)``.

    Values under the names in ``state`` of a returned dict are variables, as
    texts, of later checks that inherit state.

    It may return a dict with ``status``, ``output`` and optional
    ``output_identifiers`` and ``output_type`` lists, where a missing status
    counts as FAILURE; or any other value, which becomes the output and leaves
    the status null. An exception gives ERROR with its message.
    """

    kind = pa.struct([*_OUTCOME, ("state", pa.map_(pa.string(), pa.string()))]) if state else _OUTCOME

    @F.arrow_udf(from_arrow_type(kind))
    def run_batch(rows: pa.Array) -> pa.Array:
        def one(row):
            try:
                res = fn(**{k: _plain(v) for k, v in row.items()})
                if isinstance(res, dict):
                    return {
                        "status": res.get("status") or "FAILURE",
                        "output": _as_output(
                            res.get("output"), res.get("output_identifiers"), res.get("output_type")
                        ),
                        **({"state": [(n, _text(res.get(n))) for n in state]} if state else {}),
                    }
                if res is None:
                    return {"status": "FAILURE", "output": None}
                return {"status": None, "output": _as_output(_text(res))}
            except Exception as exc:  # a check's failure is its result
                return {"status": "ERROR", "output": _as_output(str(exc))}

        return pa.array([one(r) for r in rows.to_pylist()], kind)

    names = fn.__code__.co_varnames[: fn.__code__.co_argcount] if hasattr(fn, "__code__") else ()

    def run(v):
        done = run_batch(F.struct(*[v[n].alias(n) for n in names]))
        return (done, {n: (lambda c, n=n: c["state"][n]) for n in state}) if state else done

    return run


#: What a table check gives, one row per output.
OUTPUT_ROW = StructType([StructField(n, StringType()) for n in ("status", "value", "type", "identifier")])


def table_check(fn: Callable):
    """A table function from a check that yields its outputs one by one: ``fn(**variables)`` yields ``(status, value, type, identifier)``.

    Outputs are rows from the start, so a document may have any number of them
    without a list that holds them all. A check that fails on the way gives one
    more row, ERROR with its message, and a document without outputs gives none.
    Call it with ``outputs``.
    """
    names = fn.__code__.co_varnames[: fn.__code__.co_argcount]

    class Outputs:
        @staticmethod
        def analyze(*variables: AnalyzeArgument) -> AnalyzeResult:
            if len(variables) != len(names):
                raise ValueError(f"the check takes {', '.join(names)}")
            return AnalyzeResult(OUTPUT_ROW)

        def eval(self, *variables):
            try:
                values = (v.asDict(True) if hasattr(v, "asDict") else v for v in variables)
                for output in fn(**{n: _plain(v) for n, v in zip(names, values, strict=True)}):
                    yield tuple(_text(x) for x in output)
            except Exception as exc:  # a check's failure is its result
                yield "ERROR", str(exc), None, None

    return names, F.udtf(Outputs)


def outputs(docs: DataFrame, check, variables: Mapping[str, Column], keep: list[str]) -> DataFrame:
    """Rows that a table check gives for each document, beside the columns in ``keep``."""
    names, table = check
    given = docs.select(*keep, *(variables[n].alias(f"_v_{n}") for n in names))
    return given.lateralJoin(table(*(F.col(f"_v_{n}").outer() for n in names))).select(*keep, "status", "value", "type", "identifier")


def class_check(cls: type, **variables: str):
    """A check from a class: its properties are set by name, then it is called."""

    def call(values):
        check = cls()
        for prop, value in values.items():
            setattr(check, prop, value)
        return check()

    names = list(variables.items())

    @F.arrow_udf(from_arrow_type(_OUTCOME))
    def run_batch(rows: pa.Array) -> pa.Array:
        def one(row):
            try:
                status, output = call({k: _plain(v) for k, v in row.items()})
                return {"status": status, "output": _as_output(output)}
            except Exception as exc:  # a check's failure is its result
                return {"status": "ERROR", "output": _as_output(str(exc))}

        return pa.array([one(r) for r in rows.to_pylist()], _OUTCOME)

    return lambda v: run_batch(F.struct(*[v[var].alias(prop) for prop, var in names]))


class Registry:
    """Checks by id."""

    def __init__(self, checks: list[Check] | None = None):
        self._checks = {c.id: c for c in checks or []}

    def add(self, check: Check) -> Check:
        self._checks[check.id] = check
        return check

    def get(self, check_id: str) -> Check | None:
        return self._checks.get(check_id)

    def ids(self) -> list[str]:
        return sorted(self._checks)
