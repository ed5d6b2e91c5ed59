"""Query-time inference: class and property hierarchies, inverse, symmetric and transitive properties, sameAs.

What is declared about properties is collected (schemas are small); class
hierarchies and instances stay DataFrames, as classes can be data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators import closure
from quadloom.operators.scan import Options, restrict, scan
from quadloom.plans import ir
from quadloom.sources.store import QuadStore

SUB_CLASS, SUB_PROPERTY = m.RDFS + "subClassOf", m.RDFS + "subPropertyOf"
EQUIVALENT_PROPERTY, INVERSE, SAME_AS = m.OWL + "equivalentProperty", m.OWL + "inverseOf", m.OWL + "sameAs"
SYMMETRIC, TRANSITIVE = m.OWL + "SymmetricProperty", m.OWL + "TransitiveProperty"


@dataclass
class Properties:
    """What is declared about properties."""

    parents: dict[str, set[str]] = field(default_factory=dict)
    inverse: dict[str, set[str]] = field(default_factory=dict)
    symmetric: set[str] = field(default_factory=set)
    transitive: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, store: QuadStore, options: Options = Options()) -> Properties:
        out = cls()
        opts = Options(auths=options.auths)
        df = restrict(store.select({SUB_PROPERTY, EQUIVALENT_PROPERTY, INVERSE}), opts).where(F.col("p").isin(SUB_PROPERTY, EQUIVALENT_PROPERTY, INVERSE) & (F.col("o_dt") == m.IRI))
        for s, p, o in df.select("s", "p", "o").distinct().collect():
            if p == INVERSE:
                out.inverse.setdefault(s, set()).add(o)
                out.inverse.setdefault(o, set()).add(s)
            else:
                out.parents.setdefault(s, set()).add(o)
                if p == EQUIVALENT_PROPERTY:
                    out.parents.setdefault(o, set()).add(s)
        for kind, to in ((SYMMETRIC, out.symmetric), (TRANSITIVE, out.transitive)):
            to |= {r[0] for r in restrict(store.select(m.TYPE, kind), opts).where((F.col("p") == m.TYPE) & (F.col("o") == kind)).select("s").distinct().collect()}
        return out

    def descendants(self, p: str) -> set[str]:
        """Properties that imply ``p``; itself only where it is on a cycle."""
        children: dict[str, set[str]] = {}
        for c, ps in self.parents.items():
            for x in ps:
                children.setdefault(x, set()).add(c)
        seen, todo = set(), list(children.get(p, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += children.get(x, ())
        return seen


def class_edges(store: QuadStore, options: Options = Options()) -> DataFrame:
    """(x, y): x has the subclass y."""
    df = scan(store, p=SUB_CLASS, options=options).where(F.col("o_dt") == m.IRI)
    return df.select(F.col("o").alias("x"), F.col("s").alias("y"))


def class_descendants(store: QuadStore, cls: str, options: Options = Options()) -> DataFrame:
    """(x) of the transitive subclasses, the class itself only where it is on a cycle."""
    start = store.spark.createDataFrame([(cls,)], "x string")
    return closure.reachable(class_edges(store, options), start)


def instances_of(store: QuadStore, cls: str, options: Options = Options()) -> DataFrame:
    """(s, type): what has the class or one of its descendants as type, once for each; ``type`` is the class asked for."""
    classes = class_descendants(store, cls, options).unionByName(store.spark.createDataFrame([(cls,)], "x string")).distinct()
    types = scan(store, p=m.TYPE, options=options).where(F.col("o_dt") == m.IRI)
    return types.join(classes, F.col("o") == F.col("x"), "left_semi").select("s", F.lit(cls).alias("type"))


def same_as_groups(store: QuadStore, options: Options = Options()) -> DataFrame:
    """(x, root) of everything that is the same as something."""
    df = scan(store, p=SAME_AS, options=options).where(F.col("o_dt") == m.IRI)
    return closure.groups(df.select(F.col("s").alias("x"), F.col("o").alias("y")))


def same_as(store: QuadStore, x: str, options: Options = Options()) -> DataFrame:
    """(x) of all that is the same, itself included."""
    df = scan(store, p=SAME_AS, options=options).where(F.col("o_dt") == m.IRI).select(F.col("s").alias("x"), F.col("o").alias("y"))
    start = store.spark.createDataFrame([(x,)], "x string")
    return closure.reachable(df.unionByName(df.select(F.col("y").alias("x"), F.col("x").alias("y"))), start).unionByName(start).distinct()


def transitive(store: QuadStore, pattern: ir.Pattern, options: Options = Options()) -> tuple[DataFrame, list[str]]:
    """Bindings of a transitive pattern and their variables. Without a bound end it is the whole closure; with both a check."""
    edges = scan(store, p=pattern.p.lex, g=pattern.g.lex if isinstance(pattern.g, ir.Term) else None, options=options).where(F.col("o_dt") == m.IRI)
    forward = edges.select(F.col("s").alias("x"), F.col("o").alias("y"))
    backward = edges.select(F.col("o").alias("x"), F.col("s").alias("y"))
    start = lambda t: store.spark.createDataFrame([(t.lex,)], "x string")
    if isinstance(pattern.s, ir.Term):
        got = closure.reachable(forward, start(pattern.s))
        if isinstance(pattern.o, ir.Term):
            return got.where(F.col("x") == pattern.o.lex).select(F.lit(1).alias("_unit")), []
        return got.select(F.col("x").alias(pattern.o.name)), [pattern.o.name]
    if isinstance(pattern.o, ir.Term):
        return closure.reachable(backward, start(pattern.o)).select(F.col("x").alias(pattern.s.name)), [pattern.s.name]
    pairs = closure.closure(forward)
    if pattern.s == pattern.o:
        return pairs.where("x = y").select(F.col("x").alias(pattern.s.name)), [pattern.s.name]
    return pairs.select(F.col("x").alias(pattern.s.name), F.col("y").alias(pattern.o.name)), [pattern.s.name, pattern.o.name]


def expandable(p: str) -> bool:
    """Vocabulary of RDF, RDFS and OWL is never expanded."""
    return not p.startswith((m.RDF, m.RDFS, m.OWL))


def expand(node: ir.Node, store: QuadStore, options: Options = Options(), properties: Properties | None = None) -> ir.Node:
    """Rewrites each pattern into the union of those that imply it, before anything is lowered."""
    known = properties or Properties.of(store, options)

    def one(n: ir.Node) -> ir.Node:
        if not isinstance(n, ir.Pattern) or n.fixed or not isinstance(n.p, ir.Term):
            return n
        if n.p.lex == m.TYPE and isinstance(n.o, ir.Term) and n.g is None:
            got = instances_of(store, n.o.lex, options)
            if isinstance(n.s, ir.Var):
                return ir.Rows(got.select(F.col("s").alias(n.s.name)), [n.s.name])
            return ir.Rows(got.where(F.col("s") == n.s.lex).select(F.lit(1).alias("_unit")), [])
        if not expandable(n.p.lex):
            return n
        ways: dict[tuple[str, bool], None] = {}
        todo = [(n.p.lex, False)]
        while todo:
            p, swapped = todo.pop()
            if (p, swapped) in ways:
                continue
            ways[(p, swapped)] = None
            todo += [(x, swapped) for x in known.descendants(p)]
            todo += [(x, not swapped) for x in known.inverse.get(p, ())]
            if p in known.symmetric:
                todo.append((p, not swapped))
        parts: list[ir.Node] = []
        for p, swapped in sorted(ways):
            s, o = (n.o, n.s) if swapped else (n.s, n.o)
            if isinstance(s, ir.Term) and s.dt != m.IRI:
                continue  # a literal is no subject
            pattern = ir.Pattern(s, ir.iri(p), o, n.g, fixed=True)
            parts.append(ir.Closure(pattern) if p in known.transitive else pattern)
        return parts[0] if len(parts) == 1 else ir.Union(parts)

    return ir.rewrite(node, one)
