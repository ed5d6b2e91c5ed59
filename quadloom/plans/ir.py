"""Algebra of graph queries: what is asked, before any DataFrame is built."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quadloom import model as m


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    lex: str
    dt: str = m.IRI
    lang: str = ""


def iri(text: str) -> Term:
    return Term(text)


def literal(text, dt: str | None = None, lang: str = "") -> Term:
    if lang:
        return Term(str(text), m.LANG_STRING, lang)
    if dt is None:
        dt = m.BOOLEAN if isinstance(text, bool) else m.INTEGER if isinstance(text, int) else m.DOUBLE if isinstance(text, float) else m.STRING
    return Term(str(text).lower() if isinstance(text, bool) else str(text), dt)


Slot = Var | Term | None


class Node:
    def children(self) -> list[Node]:
        return []


@dataclass(frozen=True)
class Pattern(Node):
    """A triple pattern; ``g`` is the graph (None: any or none). ``fixed`` keeps inference from expanding it."""

    s: Slot
    p: Slot
    o: Slot
    g: Slot = None
    fixed: bool = False

    def vars(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in (self.s, self.p, self.o, self.g) if isinstance(x, Var)))


@dataclass
class Join(Node):
    left: Node
    right: Node
    hint: str | None = None

    def children(self):
        return [self.left, self.right]


@dataclass
class LeftJoin(Node):
    left: Node
    right: Node

    def children(self):
        return [self.left, self.right]


@dataclass
class Union(Node):
    parts: list[Node]

    def children(self):
        return self.parts


@dataclass
class Minus(Node):
    left: Node
    right: Node

    def children(self):
        return [self.left, self.right]


@dataclass
class Filter(Node):
    condition: tuple
    arg: Node

    def children(self):
        return [self.arg]


@dataclass
class Project(Node):
    names: list[str] | None
    arg: Node
    distinct: bool = False

    def children(self):
        return [self.arg]


@dataclass
class OrderBy(Node):
    keys: list[tuple[str, bool]]  # variable, ascending
    arg: Node

    def children(self):
        return [self.arg]


@dataclass
class Slice(Node):
    arg: Node
    limit: int | None = None
    offset: int = 0

    def children(self):
        return [self.arg]


@dataclass
class Closure(Node):
    """Pairs of the transitive closure of a predicate, from or to a bound end."""

    pattern: Pattern


@dataclass
class Rows(Node):
    """Bindings that are there already: a materialised join or inferred rows, with the variables that are surely bound."""

    df: object
    sure: list[str]
    maybe: list[str] = field(default_factory=list)


@dataclass
class Unit(Node):
    """One row without variables."""


def patterns(node: Node) -> Iterator[Pattern]:
    if isinstance(node, Pattern):
        yield node
    if isinstance(node, Closure):
        yield node.pattern
    for c in node.children():
        yield from patterns(c)


def rewrite(node: Node, fn) -> Node:
    """Bottom-up; ``fn`` returns a node in place of each."""
    if isinstance(node, (Join, LeftJoin, Minus)):
        node = type(node)(rewrite(node.left, fn), rewrite(node.right, fn), *([node.hint] if isinstance(node, Join) else []))
    elif isinstance(node, Union):
        node = Union([rewrite(x, fn) for x in node.parts])
    elif isinstance(node, Filter):
        node = Filter(node.condition, rewrite(node.arg, fn))
    elif isinstance(node, Project):
        node = Project(node.names, rewrite(node.arg, fn), node.distinct)
    elif isinstance(node, OrderBy):
        node = OrderBy(node.keys, rewrite(node.arg, fn))
    elif isinstance(node, Slice):
        node = Slice(rewrite(node.arg, fn), node.limit, node.offset)
    return fn(node)


def join_all(nodes: list[Node]) -> Node:
    out: Node = Unit()
    for n in nodes:
        out = n if isinstance(out, Unit) else Join(out, n)
    return out


def projection(node: Node) -> list[str] | None:
    """Variables of the projection below slices, filters and orders; None where there is none."""
    while not isinstance(node, Project):
        if not isinstance(node, (Slice, Filter, OrderBy)):
            return None
        node = node.arg
    return node.names
