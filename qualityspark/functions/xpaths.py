"""Node sets of XPath expressions with predicates, for the document reader's task code.

Plain element paths are patterns over node paths (``extract``), and values that
are no node sets are Spark's ``xpath_string``. This helper is for what lies
between, of which Spark returns no element texts: steps with predicates, other
axes and filtered node sets. An expression outside of its grammar is refused
when a suite is planned.
"""

from __future__ import annotations

import re
from itertools import islice
from math import inf

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<text>"[^"]*"|'[^']*')|(?P<mark>//|::|\.\.|!=|<=|>=|[/.@|()\[\],=<>*])"""
    r"""|(?P<name>[A-Za-z_][\w.-]*(?::(?!:)(?:[A-Za-z_][\w.-]*|\*))?))"""
)
AXES = ("child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "following-sibling", "preceding-sibling", "attribute")
FUNCTIONS = {
    "not": 1, "contains": 2, "starts-with": 2, "position": 0, "last": 0, "count": 1, "string": 1, "number": 1, "boolean": 1,
    "normalize-space": 1, "string-length": 1, "local-name": 1, "name": 1, "true": 0, "false": 0, "concat": None,
}
#: Functions that may leave out their argument and then take the context node.
_ON_CONTEXT = {"string", "number", "normalize-space", "string-length", "local-name", "name"}


class Refused(ValueError):
    """An expression that is not in the grammar."""


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            token = _TOKEN.match(text, at)
            if token is None:
                raise Refused(f"cannot read {text[at:]!r} in XPath {self.text!r}")
            self.tokens.append((token.lastgroup, token[token.lastgroup]))
            at = token.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)

    def take(self, *marks: str) -> str | None:
        kind, value = self.peek()
        if kind in ("mark", "name") and value in marks:
            self.at += 1
            return value
        return None

    def need(self, mark: str) -> None:
        if self.take(mark) is None:
            raise Refused(f"expected {mark!r} at {self.peek()[1]!r} in XPath {self.text!r}")

    def whole(self):
        found = self.union()
        if self.peek()[0] is not None:
            raise Refused(f"unexpected {self.peek()[1]!r} in XPath {self.text!r}")
        return found

    def union(self):
        branches = [self.path()]
        while self.take("|"):
            branches.append(self.path())
        return branches[0] if len(branches) == 1 else ("union", branches)

    def path(self):
        start, steps = ("context",), []
        if self.peek() == ("mark", "("):
            self.need("(")
            start = self.union()
            self.need(")")
            start = ("filter", start, self.predicates())
            if self.peek()[1] not in ("/", "//"):
                return start
        elif self.peek()[1] in ("/", "//"):
            start = ("root",)
            if self.peek()[1] == "/" and self.peek(1)[0] != "name" and self.peek(1)[1] not in (".", "..", "@", "*"):
                raise Refused(f"no step after / in XPath {self.text!r}")
        else:
            steps.append(self.step())
        while sign := self.take("/", "//"):
            if sign == "//":
                steps.append(("descendant-or-self", ("node",), []))
            steps.append(self.step())
        return ("path", start, steps)

    def step(self):
        if self.take("."):
            return ("self", ("node",), [])
        if self.take(".."):
            return ("parent", ("node",), [])
        axis = "attribute" if self.take("@") else "child"
        kind, name = self.peek()
        if kind == "name" and self.peek(1)[1] == "::":
            if name not in AXES:
                raise Refused(f"axis {name} in XPath {self.text!r}")
            axis, self.at = name, self.at + 2
            kind, name = self.peek()
        if self.take("*"):
            test = ("any",)
        elif kind == "name":
            self.at += 1
            test = ("named", name)
            if name in ("text", "node") and self.take("("):
                self.need(")")
                test = (name,)
        else:
            raise Refused(f"no step at {name!r} in XPath {self.text!r}")
        return (axis, test, self.predicates())

    def predicates(self) -> list:
        found = []
        while self.take("["):
            found.append(self.either())
            self.need("]")
        return found

    def _chain(self, below, *marks):
        left = below()
        while mark := self.take(*marks):
            left = (mark, left, below())
        return left

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.equal, "and")

    def equal(self):
        return self._chain(self.order, "=", "!=")

    def order(self):
        return self._chain(self.value, "<", "<=", ">", ">=")

    def value(self):
        kind, text = self.peek()
        if kind == "number":
            self.at += 1
            return ("constant", float(text))
        if kind == "text":
            self.at += 1
            return ("constant", text[1:-1])
        if kind == "name" and self.peek(1)[1] == "(" and text not in ("text", "node"):
            return self.call(text)
        if kind == "mark" and text == "(":
            before = self.at
            try:
                return self.union()
            except Refused:
                self.at = before + 1
                inner = self.either()
                self.need(")")
                return inner
        return self.union()

    def call(self, name: str):
        if name not in FUNCTIONS:
            raise Refused(f"function {name} in XPath {self.text!r}")
        self.at += 2
        given = []
        while not self.take(")"):
            if given:
                self.need(",")
            given.append(self.either())
        if not given and name in _ON_CONTEXT:
            given = [("path", ("context",), [("self", ("node",), [])])]
        if FUNCTIONS[name] not in (None, len(given)):
            raise Refused(f"{name} takes {FUNCTIONS[name]} values in XPath {self.text!r}")
        return ("call", name, given)


def parse(text: str):
    """The steps of a node-set expression; raises ``Refused`` for any other."""
    return _Parser(text).whole()


class Tree:
    """A parsed document, of which nodes are made as expressions reach them: one costs what it touches."""

    def __init__(self, root):
        self.root = root
        self.top = Node(self, "document", None, None, None, None)
        self._made: dict = {}
        self._tags = self._numbers = self._parents = None

    def element(self, item, parent: Node | None = None) -> Node:
        node = self._made.get(item)
        if node is None:
            node = self._made[item] = Node(self, "element", item.tag, None, parent, item)
        return node

    def tags(self) -> set:
        if self._tags is None:
            self._tags = {item.tag for item in self.root.iter()}
        return self._tags

    def number(self, item) -> int:
        """Place of an element in document order."""
        if self._numbers is None:
            self._numbers = {each: i for i, each in enumerate(self.root.iter())}
        return self._numbers[item]

    def last(self, item) -> int:
        """Number of the last element below an element, or its own."""
        while len(item):
            item = item[-1]
        return self.number(item)

    def above(self, item) -> Node:
        if self._parents is None:
            self._parents = {child: each for each in self.root.iter() for child in each}
        return self.top if item is self.root else self.element(self._parents[item])


class Node:
    """An element, attribute, text or the document itself. ``item`` is an element, or where in its parent an attribute or text stands."""

    __slots__ = ("tree", "kind", "name", "value", "item", "_parent", "_children", "_attributes", "_places")

    def __init__(self, tree: Tree, kind, name, value, parent, item):
        self.tree, self.kind, self.name, self.value, self._parent, self.item = tree, kind, name, value, parent, item
        self._children = self._attributes = self._places = None

    @property
    def parent(self) -> Node | None:
        if self._parent is None and self.kind == "element":
            self._parent = self.tree.above(self.item)
        return self._parent

    @property
    def order(self) -> tuple:
        """Sorts nodes as they stand in the document."""
        if self.kind == "document":
            return (-1, 0, 0)
        if self.kind == "element":
            return (self.tree.number(self.item), 0, 0)
        if self.kind == "attribute":
            return (self.tree.number(self._parent.item), 1, self.item)
        if self.item is None:
            return (self.tree.number(self._parent.item), 2, 0)
        # Behind an element and all in it; of such texts that of the inner element comes first.
        return (self.tree.last(self.item), 3, -self.tree.number(self.item))

    @property
    def children(self) -> list:
        if self._children is None:
            out = self._children = []
            if self.kind == "document":
                out.append(self.tree.element(self.tree.root, self))
            elif self.kind == "element":
                if self.item.text:
                    out.append(Node(self.tree, "text", None, self.item.text, self, None))
                for child in self.item:
                    out.append(self.tree.element(child, self))
                    if child.tail:
                        out.append(Node(self.tree, "text", None, child.tail, self, child))
        return self._children

    @property
    def attributes(self) -> list:
        if self._attributes is None:
            pairs = self.item.attrib.items() if self.kind == "element" else ()
            self._attributes = [Node(self.tree, "attribute", name, value, self, i) for i, (name, value) in enumerate(pairs)]
        return self._attributes

    def place(self) -> int:
        """Place among the children of the parent."""
        above = self.parent
        if above._places is None:
            above._places = {id(child): i for i, child in enumerate(above.children)}
        return above._places[id(self)]

    def text(self) -> str:
        if self.value is not None:
            return self.value
        return "".join((self.tree.root if self.kind == "document" else self.item).itertext())

    def below(self) -> list:
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(reversed(node.children))
        return out


def tree(root) -> Node:
    """The document node of a parsed document."""
    return Tree(root).top


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


_DOWN = ("descendant", "descendant-or-self")
_SIDE = ("following-sibling", "preceding-sibling")
_NUMERIC = {"position", "last", "count", "number", "string-length"}


def _uses_place(expr) -> bool:
    """True where ``position()`` or ``last()`` may stand in an expression."""
    if isinstance(expr, (list, tuple)):
        return expr[:2] in (("call", "position"), ("call", "last")) or any(map(_uses_place, expr))
    return False


def _placed(predicate) -> bool:
    """True for a predicate that may depend on a node's place among those of its step."""
    kind = predicate[0]
    return kind == "constant" and isinstance(predicate[1], float) or kind == "call" and predicate[1] in _NUMERIC or _uses_place(predicate)


class Evaluator:
    """Evaluates parsed expressions; ``prefixes`` binds name prefixes, None compares local names only."""

    def __init__(self, top: Node, prefixes: dict[str, str] | None):
        self.top, self.prefixes, self.tree = top, prefixes, top.tree
        self._fitting: dict = {}
        self._rooted: dict = {}

    def nodes(self, expr, context: Node | None = None) -> list[Node]:
        return self._value(expr, context or self.top, 1, 1)

    def _named(self, name: str, test) -> bool:
        """True where an element's or attribute's name fits a name test."""
        prefix, _, local = test[1].rpartition(":")
        if self.prefixes is None:
            return not prefix and _local(name) == local
        uri = self.prefixes.get(prefix) if prefix else None
        if prefix and uri is None:
            return False
        own = name[1:].split("}", 1)[0] if name[0] == "{" else None
        return own == uri and local in ("*", _local(name))

    def _fits(self, node: Node, test, principal: str) -> bool:
        if test[0] == "node":
            return True
        if test[0] == "text":
            return node.kind == "text"
        if node.kind != principal or test[0] == "any":
            return node.kind == principal
        return self._named(node.name, test)

    def _tags(self, test) -> set:
        """Tags of the document that fit a test of elements."""
        if test not in self._fitting:
            tags = self.tree.tags()
            self._fitting[test] = tags if test[0] == "any" else {tag for tag in tags if self._named(tag, test)}
        return self._fitting[test]

    def _elements(self, node: Node, test, deep: bool) -> list[Node]:
        """Child elements, or all below, that fit a test of elements; no other node is made."""
        if node.kind not in ("document", "element"):
            return []
        tags, tree = self._tags(test), self.tree
        if not deep:
            inside = [tree.root] if node.kind == "document" else node.item
            return [tree.element(item, node) for item in inside if item.tag in tags]
        top = tree.root if node.kind == "document" else node.item
        # The parser's own filter by one tag takes no time for the other elements.
        found = top.iter(*tags) if len(tags) == 1 else (item for item in top.iter() if item.tag in tags) if tags else ()
        return [tree.element(item) for item in found if node.kind == "document" or item is not top]

    def _axis(self, node: Node, axis: str):
        if axis == "child":
            return node.children
        if axis == "attribute":
            return node.attributes
        if axis == "self":
            return [node]
        if axis == "parent":
            return [node.parent] if node.parent else []
        if axis == "descendant":
            return node.below()
        if axis == "descendant-or-self":
            return [node, *node.below()]
        if axis == "ancestor":
            out = []
            while node.parent:
                node = node.parent
                out.append(node)
            return out
        if not node.parent or node.kind == "attribute":
            return []
        same, place = node.parent.children, node.place()
        turns = range(place + 1, len(same)) if axis == "following-sibling" else range(place - 1, -1, -1)
        return (same[i] for i in turns)

    def _outermost(self, now: list[Node]) -> list[Node]:
        """Nodes that lie in no other of the nodes, which are in document order."""
        if len(now) < 2:
            return now
        out, end = [], -1
        for node in now:
            if node.kind != "element":
                out.append(node)
                end = inf if node.kind == "document" else end
            elif self.tree.number(node.item) > end:
                out.append(node)
                end = self.tree.last(node.item)
        return out

    def _contexts(self, now: list[Node], axis: str) -> list[Node]:
        """Of the nodes those from which an axis reaches what it reaches from all of them, where places do not matter."""
        if axis in _DOWN:
            return self._outermost(now)
        if axis in _SIDE:
            # The first of the same parent, or for the axis that goes back the last, has all siblings of the others.
            outer = {}
            for node in now if axis == "preceding-sibling" else reversed(now):
                if node.parent and node.kind != "attribute":
                    outer[id(node.parent)] = node
            return list(outer.values())
        return now

    def _grouped(self, now: list[Node], test) -> list[list[Node]]:
        """All elements below the nodes that fit a test, those of one parent together."""
        groups: dict = {}
        for node in self._outermost(now):
            for found in self._elements(node, test, True):
                groups.setdefault(id(found.parent), []).append(found)
        return list(groups.values())

    def _steps(self, now: list[Node], steps: list) -> list[Node]:
        at = 0
        while at < len(steps):
            axis, test, predicates = steps[at]
            behind = steps[at + 1] if at + 1 < len(steps) else None
            at += 1
            placed = any(map(_placed, predicates))
            of_elements = test[0] in ("any", "named")
            if behind and axis == "descendant-or-self" and test == ("node",) and not predicates:
                if behind[0] == "child" and behind[1][0] in ("any", "named"):
                    # ``//name``: only elements of that name are met, by parent where predicates ask for places.
                    at += 1
                    if any(map(_placed, behind[2])):
                        found = [n for group in self._grouped(now, behind[1]) for n in self._keep(group, behind[2])]
                        now = sorted(found, key=_order)
                        continue
                    axis, test, predicates, placed, of_elements = "descendant", behind[1], behind[2], False, True
                elif behind[0] == "attribute":
                    # Only elements have attributes.
                    test, of_elements = ("any",), True
            if len(now) > 1 and not placed:
                now = self._contexts(now, axis)
            principal = "attribute" if axis == "attribute" else "element"
            found = {}
            for each in now:
                if of_elements and axis in ("child", *_DOWN):
                    chosen = self._elements(each, test, axis != "child")
                    if axis == "descendant-or-self" and self._fits(each, test, principal):
                        chosen.insert(0, each)
                else:
                    chosen = (n for n in self._axis(each, axis) if self._fits(n, test, principal))
                found.update((id(n), n) for n in self._keep(chosen, predicates))
            several = len(now) > 1 or axis in ("ancestor", "preceding-sibling")
            now = sorted(found.values(), key=_order) if several and len(found) > 1 else list(found.values())
        return now

    def _keep(self, found, predicates: list) -> list[Node]:
        for p in predicates:
            if p[0] == "constant" and isinstance(p[1], float):
                # One place: what lies behind it is not asked for.
                place = int(p[1]) if p[1] == int(p[1]) else 0
                found = list(islice(found, place - 1, place)) if place > 0 else []
                continue
            found = list(found)
            if p == ("call", "last", []):
                found = found[-1:]
                continue
            size, kept = len(found), []
            for place, node in enumerate(found, 1):
                value = self._value(p, node, place, size)
                if value == place if isinstance(value, float) else _truth(value):
                    kept.append(node)
            found = kept
        return list(found)

    def _value(self, expr, node: Node, place: int, size: int):
        kind = expr[0]
        if kind == "constant":
            return expr[1]
        if kind == "root":
            return [self.top]
        if kind == "context":
            return [node]
        if kind == "path":
            if expr[1] != ("root",):
                return self._steps(self._value(expr[1], node, place, size), expr[2])
            # The same from every node.
            if id(expr) not in self._rooted:
                self._rooted[id(expr)] = self._steps([self.top], expr[2])
            return self._rooted[id(expr)]
        if kind == "filter":
            return self._keep(self._value(expr[1], node, place, size), expr[2])
        if kind == "union":
            found = {id(n): n for branch in expr[1] for n in self._value(branch, node, place, size)}
            return sorted(found.values(), key=_order)
        if kind == "or":
            return _truth(self._value(expr[1], node, place, size)) or _truth(self._value(expr[2], node, place, size))
        if kind == "and":
            return _truth(self._value(expr[1], node, place, size)) and _truth(self._value(expr[2], node, place, size))
        if kind == "call":
            given = [self._value(e, node, place, size) for e in expr[2]]
            return _call(expr[1], given, place, size)
        return _compare(kind, self._value(expr[1], node, place, size), self._value(expr[2], node, place, size))


def _order(node: Node) -> tuple:
    return node.order


def _truth(value) -> bool:
    return bool(value) and value == value


def _string(value) -> str:
    if isinstance(value, list):
        return value[0].text() if value else ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return "NaN" if value != value else str(int(value)) if value == int(value) else repr(value)
    return value


def _number(value) -> float:
    if isinstance(value, (bool, float)):
        return float(value)
    text = _string(value).strip(" \t\r\n")
    return float(text) if re.fullmatch(r"-?(\d+(\.\d*)?|\.\d+)", text) else float("nan")


def _compare(sign: str, left, right) -> bool:
    for one, other in ((left, right), (right, left)):
        if isinstance(one, list):
            if isinstance(other, bool):
                return _holds(sign, *((bool(one), other) if one is left else (other, bool(one))))
            return any(_compare(sign, n.text(), right) if one is left else _compare(sign, left, n.text()) for n in one)
    return _holds(sign, left, right)


def _holds(sign: str, left, right) -> bool:
    if sign in ("=", "!="):
        if isinstance(left, bool) or isinstance(right, bool):
            left, right = _truth(left), _truth(right)
        elif isinstance(left, float) or isinstance(right, float):
            left, right = _number(left), _number(right)
        return (left == right) == (sign == "=")
    left, right = _number(left), _number(right)
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]


def _call(name: str, given: list, place: int, size: int):
    if name in ("position", "last"):
        return float(place if name == "position" else size)
    if name in ("true", "false"):
        return name == "true"
    if name == "not":
        return not _truth(given[0])
    if name == "boolean":
        return _truth(given[0])
    if name == "count":
        return float(len(given[0]))
    if name == "number":
        return _number(given[0])
    if name in ("local-name", "name"):
        named = given[0][0].name if given[0] else None
        return _local(named) if named else ""
    texts = [_string(g) for g in given]
    if name == "contains":
        return texts[1] in texts[0]
    if name == "starts-with":
        return texts[0].startswith(texts[1])
    if name == "normalize-space":
        return " ".join(texts[0].split())
    if name == "string-length":
        return float(len(texts[0]))
    return "".join(texts)
