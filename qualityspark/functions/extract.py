"""Typed values from XML and JSON documents.

Element paths of a whole suite are read in one pass over each document: an
Arrow UDF parses the body once and returns only the nodes some selector asked
for, so the cost does not grow with the number of selectors. Everything after
that is JVM-side array work. Node sets with predicates are evaluated in the same
pass (``xpaths``); expressions whose value is no node set go to Spark's
``xpath_string``, all together in one more parse; JSON paths to
``get_json_object`` and VARIANT.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from qualityspark.functions import xpaths
from qualityspark.functions.scalars import retype_sql

_NODE = pa.struct([("sel", pa.int32()), ("value", pa.string())])
_GROUPS = pa.struct([("sel", pa.int32()), ("groups", pa.list_(pa.list_(pa.string())))])
_PARSED = pa.struct(
    [("ok", pa.bool_()), ("error", pa.string()), ("nodes", pa.list_(_NODE)), ("nested", pa.list_(_GROUPS))]
)


@dataclass(frozen=True)
class SubSelector:
    name: str
    xpath: str


@dataclass(frozen=True)
class Selector:
    """One named value of a document.

    ``xpath`` reads XML documents and ``json_path`` JSON documents; a selector
    may have both. Prefixes in a namespace-aware path are bound by
    ``namespaces``, which win over those the document declares.
    """

    name: str
    xpath: str | None = None
    json_path: str | None = None
    namespace_aware: bool = False
    namespaces: dict[str, str] = field(default_factory=dict, hash=False)
    sub: SubSelector | None = None


@dataclass(frozen=True)
class NodePattern:
    """Regular expression over a node's path, and which of its texts to take."""

    pattern: str
    take: str  # "element", "text", "@name", or "node" where only its presence counts
    aware: bool
    namespaces: tuple[tuple[str, str], ...] = ()


_NAME = r"[A-Za-z_][\w.-]*"
_IS_NAMED = r"local-name\(\)\s*=\s*'[^']+'"
_STEP = re.compile(
    rf"(//|/)(text\(\)|@{_NAME}|\*\[\s*{_IS_NAMED}(?:\s+or\s+{_IS_NAMED})*\s*\]|\*|(?:{_NAME}:)?{_NAME})(?=/|\s*$)"
)
_NODE_TEST = re.compile(r"^\s*(count|boolean)\s*\((.*)\)\s*$", re.S)


def path_patterns(xpath: str, namespaces: dict[str, str] | None = None, aware: bool = False) -> list[NodePattern] | None:
    """Patterns of a union of plain absolute element paths, or None for any other expression."""
    out = []
    for branch in xpath.split("|"):
        branch = branch.strip()
        pos, pattern, take, depth = 0, "", "element", 0
        while pos < len(branch):
            step = _STEP.match(branch, pos)
            if step is None or take != "element":
                return None
            axis, name = step.groups()
            pos = step.end()
            if name == "text()" or name.startswith("@"):
                if axis == "//" or not depth:
                    return None
                take = "text" if name == "text()" else name
                continue
            depth += 1
            pattern += "(?:/[^/]+)*" if axis == "//" else ""
            if name == "*":
                pattern += "/[^/]+"
            elif name[0] == "*":
                if aware:
                    return None
                named = re.findall(r"'([^']+)'", name)
                pattern += "/(?:" + "|".join(re.escape(n) for n in named) + ")"
            elif ":" in name and not aware:
                # Without namespaces a prefixed name test matches nothing.
                return None
            else:
                pattern += "/" + re.escape(name)
        if not depth:
            return None
        out.append(NodePattern(f"^{pattern}$", take, aware, tuple(sorted((namespaces or {}).items()))))
    return out


def _relative(outer: list[NodePattern], inner: str, namespaces, aware) -> tuple[list[NodePattern], int | None] | None:
    """Patterns of a path below an outer one, and its depth if that is fixed."""
    inner = inner.strip()
    inner = inner[1:] if inner.startswith("./") else inner
    absolute = inner if inner.startswith("/") else "/" + inner
    patterns = path_patterns(absolute, namespaces, aware)
    if patterns is None or len(patterns) != 1 or any(p.take != "element" for p in outer):
        return None
    p = patterns[0]
    joined = [NodePattern(o.pattern[:-1] + p.pattern[1:], p.take, o.aware, o.namespaces) for o in outer]
    fixed = None if "//" in absolute else len([s for s in _STEP.findall(absolute) if s[1][0] != "@" and s[1] != "text()"])
    return joined, fixed


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _qualified(tag: str, prefixes: dict[str, str]) -> str:
    """``{uri}name`` as ``prefix:name`` under the given uri to prefix bindings."""
    if tag[0] != "{":
        return tag
    uri, name = tag[1:].split("}", 1)
    prefix = prefixes.get(uri)
    return f"{prefix}:{name}" if prefix else f"{{{uri.replace('/', '|')}}}{name}"


@dataclass(frozen=True)
class NestedPatterns:
    """Outer and inner patterns of a sub-selector, and how far below its outer
    node an inner one lies (None for any distance)."""

    outer: tuple[NodePattern, ...]
    inner: tuple[NodePattern, ...]
    distance: int | None


@dataclass(frozen=True)
class NodeSet:
    """An expression evaluated on the document's nodes, and one evaluated on each node it yields."""

    xpath: str
    aware: bool
    namespaces: tuple[tuple[str, str], ...] = ()
    inner: str | None = None


def node_reader(patterns: list[list[NodePattern]], nested: list[NestedPatterns], sets: list[NodeSet] = ()):
    """Arrow UDF: body -> parsed document, holding what each pattern list and node set selects.

    Node sets are numbered after the patterns, those with an inner expression after ``nested``.
    """
    plain_sets = [s for s in sets if s.inner is None]
    inner_sets = [s for s in sets if s.inner is not None]
    first_set, first_inner = len(patterns), len(nested)
    flat = [(("node", sel), p) for sel, group in enumerate(patterns) for p in group]
    for sel, spec in enumerate(nested):
        flat += [(("outer", sel), replace(p, take="node")) for p in spec.outer]
        flat += [(("inner", sel), p) for p in spec.inner]
    distances = [spec.distance for spec in nested]

    @F.arrow_udf(from_arrow_type(_PARSED))
    def read(bodies: pa.Array) -> pa.Array:
        from bisect import bisect_left, bisect_right
        from io import StringIO
        from xml.etree import ElementTree

        compiled = [(sel, re.compile(p.pattern), p.take, p.aware, dict(p.namespaces)) for sel, p in flat]
        any_aware = any(c[3] for c in compiled) or any(s.aware for s in sets)
        plain = [(sel, rx, take) for sel, rx, take, aware, _ in compiled if not aware]
        expressions = {x: xpaths.parse(x) for s in sets for x in (s.xpath, s.inner) if x is not None}
        # Places of elements, as (path, paths by the bindings, what matches there, places below by tag): patterns
        # meet a place once, not each element. Without bindings documents share them.
        shared = ("", (), [], {})

        def texts(el):
            parts = [el.text] + [child.tail for child in el]
            return [t for t in parts if t]

        def parse(body):
            declared: dict[str, str] = {}
            if not any_aware:
                return ElementTree.fromstring(body), declared
            events = ElementTree.iterparse(StringIO(body), events=("start-ns",))
            for _, (prefix, uri) in events:
                declared.setdefault(prefix, uri)
            return events.root, declared

        # Nodes of all documents, column by column; those of sub-selectors by outer node, selector and document.
        sels, values, ends = [], [], [0]
        oks, errors = [], []
        inner_values, inner_ends, outer_ends, inner_sels, inner_docs = [], [0], [0], [], [0]

        def add_groups(sel, lists):
            for found in lists:
                inner_values.extend(found)
                inner_ends.append(len(inner_values))
            outer_ends.append(len(inner_ends) - 1)
            inner_sels.append(sel)

        def walk(root, declared):
            bindings = []
            for sel, rx, take, aware, own in compiled:
                if aware:
                    bound = {**{p: u for p, u in declared.items() if p}, **own}
                    bindings.append((sel, rx, take, {u: p for p, u in bound.items()}))

            def place(above, tag):
                path = f"{above[0]}/{_local(tag) if tag[0] == '{' else tag}"
                hits = [(sel, take) for sel, rx, take in plain if rx.match(path)]
                mine = []
                for (sel, rx, take, prefixes), up in zip(bindings, above[1]):
                    mine.append(f"{up}/{_qualified(tag, prefixes)}")
                    if rx.match(mine[-1]):
                        hits.append((sel, take))
                made = above[3][tag] = (path, mine, list(dict.fromkeys(hits)), {})
                return made

            top = ("", [""] * len(bindings), [], {}) if bindings else shared
            outer, inner = [[] for _ in distances], [[] for _ in distances]
            serial = 0
            # Depth-first without recursion, so deep documents do not overflow.
            stack = [(root, top[3].get(root.tag) or place(top, root.tag), 0, None)]
            while stack:
                el, at, depth, opened = stack.pop()
                if el is None:
                    for node in opened:
                        node[1] = serial - 1
                    continue
                opened = []
                for (kind, sel), take in at[2]:
                    if kind == "outer":
                        node = [serial, serial, depth]
                        outer[sel].append(node)
                        opened.append(node)
                        continue
                    if take == "element":
                        found = ("".join(el.itertext()) if len(el) else el.text or "",)
                    elif take == "node":
                        found = (None,)
                    elif take == "text":
                        found = texts(el)
                    else:
                        found = [v for k, v in el.attrib.items() if _local(k) == take[1:]]
                    if kind == "inner":
                        inner[sel].extend((serial, depth, v) for v in found)
                    else:
                        sels.extend([sel] * len(found))
                        values.extend(found)
                serial += 1
                if len(el):
                    if opened:
                        stack.append((None, None, 0, opened))
                    below = at[3]
                    for child in reversed(el):
                        under = below.get(child.tag) or place(at, child.tag)
                        # A leaf that nothing matches counts only where places in the document do.
                        if under[2] or distances or len(child):
                            stack.append((child, under, depth + 1, None))
            for sel, distance in enumerate(distances):
                # Both are in document order, so an outer node's inner ones are one run.
                ids = [i for i, _, _ in inner[sel]]
                runs = (inner[sel][bisect_left(ids, first) : bisect_right(ids, last)] for first, last, _ in outer[sel])
                depths = (depth for _, _, depth in outer[sel])
                add_groups(sel, ([v for _, d, v in run if distance is None or d == depth + distance] for run, depth in zip(runs, depths)))

        def evaluate(root, declared):
            top = xpaths.tree(root)

            def chosen(spec):
                bound = {**{p: u for p, u in declared.items() if p}, **dict(spec.namespaces)} if spec.aware else None
                reader = xpaths.Evaluator(top, bound)
                return reader, reader.nodes(expressions[spec.xpath])

            for sel, spec in enumerate(plain_sets, first_set):
                found = [n.text() for n in chosen(spec)[1]]
                sels.extend([sel] * len(found))
                values.extend(found)
            for sel, spec in enumerate(inner_sets, first_inner):
                reader, found = chosen(spec)
                add_groups(sel, ([n.text() for n in reader.nodes(expressions[spec.inner], node)] for node in found))

        for body in bodies.to_pylist():
            error = None
            if body is None:
                error = "no document"
            else:
                try:
                    root, declared = parse(body)
                    walk(root, declared)
                    if sets:
                        evaluate(root, declared)
                except (ElementTree.ParseError, ValueError) as exc:
                    error = str(exc)
            oks.append(error is None)
            errors.append(error)
            ends.append(len(sels))
            inner_docs.append(len(inner_sels))
        offsets = lambda at: pa.array(at, pa.int32())
        nodes = pa.StructArray.from_arrays([pa.array(sels, pa.int32()), pa.array(values, pa.string())], fields=list(_NODE))
        lists = pa.ListArray.from_arrays(offsets(inner_ends), pa.array(inner_values, pa.string()))
        grouped = [pa.array(inner_sels, pa.int32()), pa.ListArray.from_arrays(offsets(outer_ends), lists)]
        groups = pa.StructArray.from_arrays(grouped, fields=list(_GROUPS))
        unread = pa.array([not ok for ok in oks], pa.bool_())
        columns = [pa.array(oks, pa.bool_()), pa.array(errors, pa.string()), pa.ListArray.from_arrays(offsets(ends), nodes)]
        return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(offsets(inner_docs), groups, mask=unread)], fields=list(_PARSED))

    # So marked, filters stay above the parse and never repeat it.
    return read.asNondeterministic()


def _no_mark(body: Column) -> Column:
    """The JVM parser takes no byte order mark in a text."""
    return F.when(body.startswith("\ufeff"), F.substr(body, F.lit(2))).otherwise(body)


_PREFIXED = re.compile(rf"(?<![\w:.-]){_NAME}:(?!:)[A-Za-z_*]")
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")
_OPERATOR = re.compile(r"!=|<=|>=|[=<>+]|(?<=[\s)\]])(?:\*|or\b|and\b|div\b|mod\b)|(?<=\s)-")
_CALL = re.compile(rf"^({_NAME})\s*\(")
#: Stands in no XML document, not even as a reference.
_BETWEEN = "\x01"


def _outermost(expr: str) -> str:
    """The expression with all that stands in quotes, brackets and parentheses blanked."""
    out, depth = [], 0
    for c in _QUOTED.sub(lambda m: "_" * len(m[0]), expr):
        depth -= c in ")]"
        out.append("_" if depth else c)
        depth += c in "(["
    return "".join(out)


def is_scalar(expr: str) -> bool:
    """True for an expression whose value is a number, text or boolean: an operation, a function's result, a literal."""
    bare = _outermost(expr.strip())
    if re.match(r"^([_-]|[0-9.]*[0-9])", bare) or _OPERATOR.search(bare):
        return True
    call = _CALL.match(bare)
    return bool(call) and call.group(1) not in ("text", "node", "id") and bare.endswith(")") and bare.count("(") == 1


def unreadable(spark: SparkSession, xpath: str) -> str | None:
    """Why Spark cannot evaluate a scalar expression, or None."""
    try:
        spark.sql("SELECT xpath_string('<a/>', :x)", {"x": xpath}).collect()
    except Exception as exc:  # whatever it is, it would end the job later
        return f"XPath {xpath!r} cannot be evaluated: {str(exc).splitlines()[0][:200]}"
    return None


class DocumentReader:
    """Values of a list of selectors, read from ``body`` in one parse.

    ``attach`` adds the parsed columns; ``values`` and ``nested`` then give Column
    expressions for a selector. A selector that cannot be read is refused alone:
    ``refused`` has the reason, and its values are null.
    """

    def __init__(self, selectors: list[Selector], parsed: str = "_parsed"):
        self.parsed = parsed
        self._patterns: list[list[NodePattern]] = []
        self._nested: list[NestedPatterns] = []
        self._sets: list[NodeSet] = []
        self._inner_sets: list[NodeSet] = []
        self._scalars: list[str] = []
        self._plan: dict[Selector, tuple] = {}
        self.refused: dict[Selector, str] = {}
        for selector in selectors:
            if selector.xpath is not None:
                try:
                    self._plan[selector] = self._plan_xml(selector)
                except xpaths.Refused as exc:
                    self.refused[selector] = str(exc)
                    self._plan[selector] = ("refused",)

    def _add(self, patterns: list[NodePattern]) -> int:
        if patterns in self._patterns:
            return self._patterns.index(patterns)
        self._patterns.append(patterns)
        return len(self._patterns) - 1

    def _plan_xml(self, selector: Selector) -> tuple:
        aware = selector.namespace_aware
        patterns = path_patterns(selector.xpath, selector.namespaces, aware)
        if selector.sub is not None:
            inner = patterns and _relative(patterns, selector.sub.xpath, selector.namespaces, aware)
            if inner:
                joined, distance = inner
                self._nested.append(NestedPatterns(tuple(patterns), tuple(joined), distance))
                return ("nested", len(self._nested) - 1)
            return ("inner set", self._add_set(selector, selector.sub.xpath))
        if patterns is not None:
            return ("nodes", self._add(patterns))
        test = _NODE_TEST.match(selector.xpath)
        inner = test and path_patterns(test.group(2), selector.namespaces, aware)
        if inner and all(p.take == "element" for p in inner):
            return (test.group(1), self._add([replace(p, take="node") for p in inner]))
        if is_scalar(selector.xpath):
            why = unreadable(SparkSession.active(), selector.xpath)
            if _PREFIXED.search(_QUOTED.sub("''", selector.xpath)):
                why = f"XPath {selector.xpath!r} has a name prefix in an expression that is no node set"
            if why:
                raise xpaths.Refused(why)
            if _BETWEEN in selector.xpath:
                return ("lone scalar",)
            if selector.xpath not in self._scalars:
                self._scalars.append(selector.xpath)
            return ("scalar", self._scalars.index(selector.xpath))
        return ("set", self._add_set(selector))

    def _add_set(self, selector: Selector, inner: str | None = None) -> int:
        for x in (selector.xpath, inner):
            if x is not None:
                xpaths.parse(x)
        spec = NodeSet(selector.xpath, selector.namespace_aware, tuple(sorted(selector.namespaces.items())), inner)
        own = self._sets if inner is None else self._inner_sets
        if spec not in own:
            own.append(spec)
        return own.index(spec)

    def attach(self, df: DataFrame, body: str = "body", when: Column | None = None) -> DataFrame:
        """Parse each document once; rows outside ``when`` are handed over as null."""
        source = F.col(body) if when is None else F.when(when, F.col(body))
        parsed = df.withColumn(self.parsed, node_reader(self._patterns, self._nested, [*self._sets, *self._inner_sets])(source))
        if not self._scalars:
            return parsed
        # Texts of all scalar expressions from one parse; ``concat`` makes texts of them as ``xpath_string`` does.
        # The lazy branch keeps the JVM parser away from malformed documents.
        joined = "concat(" + f", '{_BETWEEN}', ".join(self._scalars) + ", '')"
        texts = F.split(F.xpath_string(_no_mark(F.col(body)), F.lit(joined)), _BETWEEN, -1)
        return parsed.withColumn(f"{self.parsed}_scalars", F.when(self.ok, texts))

    @property
    def ok(self) -> Column:
        return F.col(f"{self.parsed}.ok")

    @property
    def error(self) -> Column:
        return F.col(f"{self.parsed}.error")

    def _nodes(self, sel: int) -> Column:
        return F.filter(F.col(f"{self.parsed}.nodes"), lambda n: n.sel == sel)

    def values(self, selector: Selector, body: str = "body") -> Column:
        """Texts the selector yields, in document order; empty when nothing matches."""
        kind, *rest = self._plan[selector]
        if kind == "nodes":
            return F.when(self.ok, F.transform(self._nodes(rest[0]), lambda n: n.value))
        if kind == "count":
            return F.when(self.ok, F.array(F.size(self._nodes(rest[0])).cast("string")))
        if kind == "boolean":
            return F.when(self.ok, F.array((F.size(self._nodes(rest[0])) > 0).cast("string")))
        if kind == "set":
            return F.when(self.ok, F.transform(self._nodes(len(self._patterns) + rest[0]), lambda n: n.value))
        if kind == "refused":
            return F.lit(None).cast("array<string>")
        if kind == "scalar":
            return F.when(self.ok, F.array(F.get(f"{self.parsed}_scalars", F.lit(rest[0]))))
        if kind == "lone scalar":
            return F.when(self.ok, F.array(F.xpath_string(_no_mark(F.col(body)), F.lit(selector.xpath))))
        raise ValueError(f"{selector.name} is nested")

    def nested(self, selector: Selector) -> Column:
        """One list of inner texts per outer node."""
        kind, *rest = self._plan[selector]
        if kind == "refused":
            return F.lit(None).cast("array<array<string>>")
        return F.col(f"{self.parsed}.nested")[rest[0] + (len(self._nested) if kind == "inner set" else 0)]["groups"]


def selected_sql(texts: str, empty_is_list: str = "false") -> str:
    """SQL of the value a list of texts stands for.

    One text becomes a typed value, several a list, none null or, where
    ``empty_is_list`` holds, an empty list. ``texts`` names an array column.
    """
    one = retype_sql("CASE WHEN size(items) = 1 THEN items[0] END")
    is_list = f"size(i.items) > 1 OR (({empty_is_list}) AND size(i.items) = 0)"
    return f"""transform(transform(array({texts}), items -> named_struct('items', items, 'v', {one})), i -> named_struct(
        'kind', CASE WHEN {is_list} THEN 'list' ELSE i.v.kind END, 'num', i.v.num, 'bool', i.v.bool, 'str', i.v.str,
        'items', CASE WHEN size(i.items) = 1 OR {is_list} THEN i.items END))[0]"""


def with_values(df: DataFrame, texts: dict[str, Column], empty_is_list: str = "false") -> DataFrame:
    """Add typed values by name, each from an array of texts."""
    staged = {name: f"_texts_{name}" for name in texts}
    return (
        df.withColumns({staged[name]: column for name, column in texts.items()})
        .withColumns({name: F.expr(selected_sql(column, empty_is_list)) for name, column in staged.items()})
        .drop(*staged.values())
    )


# JSON -----------------------------------------------------------------------

_JQ_TOKEN = re.compile(r"""\s*(?:\.?\[\s*"([^"]+)"\s*\]|\.?\[\s*'([^']+)'\s*\]|\.?\[(-?\d+)\]|\.?(\[\])|\.([A-Za-z_@$][\w$@-]*)|(\?)|(\.))""")
_SELECT = re.compile(r"""^select\((.*?)(?:(==|!=)\s*("[^"]*"|-?\d+(?:\.\d+)?|true|false|null)\s*)?\)$""", re.S)


def _divide(path: str, mark: str) -> list[str]:
    """Parts of a query between marks that stand in no quotes, brackets or parentheses."""
    parts, depth, quote, start, at = [], 0, None, 0, 0
    while at < len(path):
        c = path[at]
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and path.startswith(mark, at):
            parts.append(path[start:at].strip())
            start = at = at + len(mark)
            continue
        at += 1
    return [*parts, path[start:].strip()]


def json_steps(path: str) -> list[tuple]:
    """Steps of a query such as ``.a["k"].b[]? | select(.c == "x") | .d | length``."""
    steps: list[tuple] = []
    for part in _divide(path, "|"):
        if part == "length":
            steps.append(("length",))
            continue
        chosen = _SELECT.match(part)
        if chosen:
            inner = json_steps(chosen.group(1).strip())
            if any(s[0] not in ("key", "index") for s in inner):
                raise ValueError(f"unsupported JSON path: {path}")
            steps.append(("select", tuple(inner), chosen.group(2), chosen.group(3)))
            continue
        pos = 0
        if not part:
            raise ValueError(f"unsupported JSON path: {path}")
        while pos < len(part):
            token = _JQ_TOKEN.match(part, pos)
            if token is None:
                raise ValueError(f"unsupported JSON path: {path}")
            dq, sq, index, each, name, _, _ = token.groups()
            if dq or sq or name:
                steps.append(("key", dq or sq or name))
            elif index is not None:
                steps.append(("index", index))
            elif each:
                steps.append(("each", ""))
            pos = token.end()
    return steps


def json_query(path: str) -> list:
    """Alternatives of a query (``a // b``), each its steps, or a literal text."""
    return [part[1:-1] if re.match(r'^"[^"]*"$', part) else json_steps(part) for part in _divide(path, "//")]


def _json_path(steps: list[tuple]) -> str:
    return "$" + "".join(f"['{s[1]}']" if s[0] == "key" else f"[{s[1]}]" for s in steps)


def _grouped(steps: list[tuple]) -> list:
    """Steps with runs of keys and indices joined to one path."""
    out: list = []
    for step in steps:
        if step[0] in ("key", "index"):
            if out and out[-1][0] == "path":
                out[-1][1].append(step)
            else:
                out.append(("path", [step]))
        else:
            out.append(step)
    return out


def _nodes(root: Column, steps: list[tuple]) -> Column:
    """Parsed values that the steps yield; a step that does not fit a value yields nothing or null, as with ``?``."""
    none = F.array().cast("array<variant>")
    at = lambda node, path, kind: F.try_variant_get(node, path, kind)

    def into(path: str):
        return lambda node: at(node, path, "variant")

    def spread(node: Column) -> Column:
        return F.coalesce(at(node, "$", "array<variant>"), F.map_values(at(node, "$", "map<string,variant>")), none)

    def length(node: Column) -> Column:
        size = F.coalesce(
            F.size(at(node, "$", "array<variant>")), F.size(at(node, "$", "map<string,variant>")), F.length(at(node, "$", "string")), F.lit(0)
        )
        return F.parse_json(size.cast("string"))

    def keeps(step: tuple):
        path, sign, literal = _json_path(step[1]), step[2], step[3]

        def test(node: Column) -> Column:
            value = at(node, path, "variant")
            plain = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            if sign is None:
                return (plain != "VOID") & F.coalesce(at(value, "$", "string") != "false", F.lit(True))
            kind = "STRING" if literal[0] == '"' else "BOOLEAN" if literal in ("true", "false") else "VOID" if literal == "null" else None
            if kind:
                same = (plain == kind) & (F.lit(True) if kind == "VOID" else at(value, "$", "string") == literal.strip('"'))
            else:
                same = plain.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (at(value, "$", "double") == float(literal))
            same = F.coalesce(same, F.lit(False))
            return same if sign == "==" else ~same

        return test

    found = F.array(root)
    for step in _grouped(steps):
        if step[0] == "path":
            found = F.transform(found, into(_json_path(step[1])))
        elif step[0] == "each":
            found = F.flatten(F.transform(found, spread))
        elif step[0] == "length":
            found = F.transform(found, length)
        else:
            found = F.filter(found, keeps(step))
    return found


def _spelled(body: Column, root: Column, steps: list[tuple], scalars: bool) -> Column:
    """Texts of what the steps yield, objects and arrays as the document spells them."""
    groups: list[list[tuple]] = [[]]
    for step in steps:
        if step[0] == "each":
            groups.append([])
        else:
            groups[-1].append(step)

    def step_into(steps: list[tuple]):
        p = _json_path(steps)
        return lambda pair: F.struct(
            F.get_json_object(pair["text"], p).alias("text"),
            F.try_variant_get(pair["node"], p, "variant").alias("node"),
        )

    def spread(pair: Column) -> Column:
        texts = F.from_json(pair.text, "array<string>")
        nodes = F.try_variant_get(pair.node, "$", "array<variant>")
        both = F.arrays_zip(texts.alias("text"), nodes.alias("node"))
        return F.coalesce(
            F.transform(both, lambda b: F.struct(b["text"].alias("text"), b["node"].alias("node"))),
            F.array().cast("array<struct<text:string,node:variant>>"),
        )

    first = F.struct(body.alias("text"), root.alias("node"))
    pairs = F.transform(F.array(first), step_into(groups[0])) if groups[0] else F.array(first)
    for steps in groups[1:]:
        pairs = F.flatten(F.transform(pairs, spread))
        if steps:
            pairs = F.transform(pairs, step_into(steps))

    def text_of(pair: Column) -> Column:
        keep = F.schema_of_variant(pair["node"]).rlike("^(STRING$|OBJECT|ARRAY)")
        return pair["text"] if scalars else F.when(keep, pair["text"])

    return F.transform(pairs, text_of)


def json_texts(body: Column, path: str, scalars: bool = False, node: Column | None = None) -> Column:
    """Array with one text per node the path yields.

    Strings give their text and objects or arrays their JSON text. Numbers,
    booleans and nulls give null, unless ``scalars`` asks for their text.
    ``node`` is the parsed body, where the caller already has it: the body's
    text itself is read again only where a path yields an object or array.
    """
    root = F.try_parse_json(body) if node is None else node
    kind = lambda n: F.coalesce(F.schema_of_variant(n), F.lit("VOID"))
    nested = lambda n: kind(n).rlike("^(OBJECT|ARRAY)")

    def texts(steps: list[tuple]) -> Column:
        found = _nodes(root, steps)

        def text(n: Column) -> Column:
            plain = F.try_variant_get(n, "$", "string")
            return F.when(nested(n), F.to_json(n)).otherwise(plain if scalars else F.when(kind(n) == "STRING", plain))

        short = F.transform(found, text)
        if all(s[0] in ("key", "index", "each") for s in steps):
            # Spelled as in the document, with keys in its order.
            return F.when(F.exists(found, nested), _spelled(body, root, steps, scalars)).otherwise(short)
        return short

    def given(steps) -> Column:
        if isinstance(steps, str):
            return F.array(F.lit(steps))
        return texts(steps)

    *before, last = json_query(path)
    out = given(last)
    for steps in reversed(before):
        told = _nodes(root, steps)
        there = F.filter(told, lambda n: (kind(n) != "VOID") & F.coalesce(F.try_variant_get(n, "$", "string") != "false", F.lit(True)))
        out = F.when(F.size(there) > 0, F.filter(given(steps), lambda s: s.isNotNull())).otherwise(out)
    return out


def with_json_values(df: DataFrame, body: str, paths: dict[str, str], scalars: bool = False) -> DataFrame:
    """Add typed values of JSON paths: one node a single value, otherwise a list."""
    parsed = df.withColumn("_node", F.try_parse_json(F.col(body)))
    texts = {name: json_texts(F.col(body), path, scalars, F.col("_node")) for name, path in paths.items()}
    return with_values(parsed, texts, "true").drop("_node")


def is_json_format(format_id: Column) -> Column:
    return F.contains(F.lower(format_id), F.lit("json"))


# Node table -----------------------------------------------------------------

_ELEMENT = pa.struct(
    [
        ("node_id", pa.int32()),
        ("parent_id", pa.int32()),
        ("path", pa.string()),
        ("local", pa.string()),
        ("prefix", pa.string()),
        ("ns_uri", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
        ("ord", pa.int32()),
    ]
)


@F.arrow_udf(from_arrow_type(pa.list_(_ELEMENT)))
def _all_nodes(bodies: pa.Array) -> pa.Array:
    from io import StringIO
    from xml.etree import ElementTree

    def one(body):
        if body is None:
            return None
        out, stack, scopes, pending = [], [], [{}], {}
        try:
            for event, item in ElementTree.iterparse(StringIO(body), events=("start-ns", "start", "end")):
                if event == "start-ns":
                    pending[item[1]] = item[0]
                elif event == "start":
                    scopes.append({**scopes[-1], **pending})
                    pending = {}
                    uri = item.tag[1:].split("}", 1)[0] if item.tag[0] == "{" else None
                    above = stack[-1] if stack else None
                    local = _local(item.tag)
                    node = {
                        "node_id": len(out),
                        "parent_id": above["node_id"] if above else None,
                        "path": f"{above['path'] if above else ''}/{local}",
                        "local": local,
                        "prefix": (scopes[-1].get(uri) or None) if uri else None,
                        "ns_uri": uri,
                        "attrs": list(item.attrib.items()),
                        "text": None,
                        "ord": above["children"] if above else 0,
                        "children": 0,
                    }
                    if above:
                        above["children"] += 1
                    out.append(node)
                    stack.append(node)
                else:
                    # Own text only: whole string values would repeat each text once per level.
                    stack.pop()["text"] = "".join([item.text or ""] + [c.tail or "" for c in item])
                    scopes.pop()
        except (ElementTree.ParseError, ValueError):
            return None
        for node in out:
            del node["children"]
        return out

    return pa.array([one(b) for b in bodies.to_pylist()], pa.list_(_ELEMENT))


def shred(docs: DataFrame, key: str = "pid", body: str = "body") -> DataFrame:
    """One row per element: id, parent, path, name, namespace, attributes, own text."""
    # The outer generator avoids an inferred size filter, and so a second parse.
    return docs.select(key, F.inline_outer(_all_nodes(F.col(body)))).filter("node_id IS NOT NULL")


def namespaces_of(docs: DataFrame, key: str = "pid", body: str = "body") -> DataFrame:
    """Namespaces a document's elements use; the first prefix met for a uri wins."""
    return (
        shred(docs, key, body)
        .filter("ns_uri IS NOT NULL")
        .groupBy(key, "ns_uri")
        .agg(F.min_by("prefix", "node_id").alias("prefix"))
    )


def root_namespace(docs: DataFrame, key: str = "pid", body: str = "body") -> DataFrame:
    return shred(docs, key, body).filter("parent_id IS NULL").select(key, "local", "ns_uri")


# Schema validity --------------------------------------------------------------


# What a schema check says.
SCHEMA_MESSAGES = {"FAILURE": "Document is not schema valid", "SUCCESS": "Document is schema valid"}


def schema_check(body: Column, schema: str, xsd_path: str | None = None) -> Column:
    """SUCCESS, FAILURE or ERROR of a document against a row schema or an XSD.

    ``schema`` must hold a ``_corrupt string`` column. With ``xsd_path`` the
    parser validates against that file, which every executor must have.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    if xsd_path:
        options["rowValidationXSDPath"] = xsd_path
    row = F.from_xml(body, schema, options)
    bad = row.getField("_corrupt").isNotNull()
    return F.struct(
        F.when(body.isNull(), "ERROR").when(bad, "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(body.isNull(), "no document")
        .when(bad, SCHEMA_MESSAGES["FAILURE"])
        .otherwise(SCHEMA_MESSAGES["SUCCESS"])
        .alias("output"),
    )
