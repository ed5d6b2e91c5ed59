"""Forward-chaining OWL reasoning as a fixpoint of joins.

The schema (classes, properties, restrictions) is collected and closed on the
driver, then sent back as small tables. Facts stay distributed: each round
joins what was found last with the schema tables (broadcast) and, for rules of
two facts, with all facts; what is new is written as the round's table. Only rules
are run for which the facts have the schema's predicates and classes, and facts are never broadcast.

A fact keeps the rule and round that gave it, the size ``span`` of its smallest
derivation of that round, and its direct premises. Inconsistencies are a second result.
Premises are written as the up to three terms ``VIA`` that the fact itself lacks, and put together when they are read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators.scan import Options, restrict
from quadloom.scratch import Rounds
from quadloom.sources.store import QuadStore

THING, NOTHING = m.OWL + "Thing", m.OWL + "Nothing"
_R, _O = m.RDFS, m.OWL
SCHEMA_PREDICATES = {
    _R + "subClassOf", _R + "subPropertyOf", _R + "domain", _R + "range", _O + "equivalentClass", _O + "equivalentProperty", _O + "inverseOf", _O + "disjointWith", _O + "complementOf",
    _O + "propertyDisjointWith", _O + "onProperty", _O + "someValuesFrom", _O + "allValuesFrom", _O + "hasValue", _O + "maxCardinality", _O + "maxQualifiedCardinality", _O + "onClass",
}
PROPERTY_KINDS = {_O + k for k in ("TransitiveProperty", "SymmetricProperty", "AsymmetricProperty", "IrreflexiveProperty", "FunctionalProperty", "InverseFunctionalProperty")}
SCHEMA_TYPES = PROPERTY_KINDS | {_O + k for k in ("Class", "Restriction", "ObjectProperty", "DatatypeProperty")} | {_R + "Class", m.RDF + "Property"}
FACT = ["s", "p", "o", "o_dt", "o_lang"]
VIA = ["v1", "v2", "v3"]
#: The premises of each rule, by terms of the fact and of its VIA; ``a`` is rdf:type.
PREMISES = {
    "PrpDom": ["s v1 v2"], "PrpRng": ["v1 v2 s"], "PrpSpo1": ["s v1 o"], "PrpInv": ["o v1 s"], "PrpSymp": ["o p s"], "CaxSco": ["s a v1"], "ClsHv1": ["s a v1"], "ClsHv2": ["s v1 v2"], "ClsSvf2": ["s v1 v2"],
    "ClsAvf": ["v1 v2 s", "v1 a v3"], "ClsSvf1": ["s v1 v2", "v2 a v3"], "PrpTrp": ["s p v1", "v1 p o"],
}


def is_schema(p: Column, o: Column) -> Column:
    return p.isin(*sorted(SCHEMA_PREDICATES)) | ((p == m.TYPE) & o.isin(*sorted(SCHEMA_TYPES)))


def _close(edges: dict[str, set[str]]) -> dict[str, set[str]]:
    out = {}
    for x in edges:
        seen, todo = set(), list(edges[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += edges.get(y, ())
        out[x] = seen
    return out


@dataclass
class Schema:
    """The closed schema: each map holds everything that follows, not only what was said."""

    super_classes: dict = field(default_factory=lambda: defaultdict(set))
    super_properties: dict = field(default_factory=lambda: defaultdict(set))
    domain: dict = field(default_factory=lambda: defaultdict(set))
    range: dict = field(default_factory=lambda: defaultdict(set))
    inverse: dict = field(default_factory=lambda: defaultdict(set))
    disjoint: dict = field(default_factory=lambda: defaultdict(set))
    complement: dict = field(default_factory=lambda: defaultdict(set))
    disjoint_properties: dict = field(default_factory=lambda: defaultdict(set))
    kinds: dict = field(default_factory=lambda: defaultdict(set))
    on_property: dict = field(default_factory=lambda: defaultdict(set))
    some: dict = field(default_factory=lambda: defaultdict(set))
    all: dict = field(default_factory=lambda: defaultdict(set))
    value: dict = field(default_factory=lambda: defaultdict(set))
    most: dict = field(default_factory=dict)
    most_of: dict = field(default_factory=dict)
    on_class: dict = field(default_factory=lambda: defaultdict(set))

    @classmethod
    def build(cls, triples) -> Schema:
        """From (s, p, o, o_dt, o_lang)."""
        x = cls()
        one_way = {_R + "subClassOf": x.super_classes, _R + "subPropertyOf": x.super_properties, _R + "domain": x.domain, _R + "range": x.range, _O + "onProperty": x.on_property, _O + "someValuesFrom": x.some, _O + "allValuesFrom": x.all, _O + "onClass": x.on_class}
        both_ways = {_O + "equivalentClass": x.super_classes, _O + "equivalentProperty": x.super_properties, _O + "inverseOf": x.inverse, _O + "disjointWith": x.disjoint, _O + "complementOf": x.complement, _O + "propertyDisjointWith": x.disjoint_properties}
        for s, p, o, dt, lang in sorted(triples, key=lambda t: tuple(map(str, t))):
            if p in one_way:
                one_way[p][s].add(o)
            elif p in both_ways:
                both_ways[p][s].add(o)
                both_ways[p][o].add(s)
            elif p == _O + "hasValue":
                x.value[s].add((o, dt, lang or ""))
            elif p in (_O + "maxCardinality", _O + "maxQualifiedCardinality"):
                to, n = (x.most if p.endswith("maxCardinality") else x.most_of), int(o) if o.lstrip("-").isdigit() else None
                if n is not None and (s not in to or 0 <= n < to[s]):  # the first value stands even if negative
                    to[s] = n
            elif p == m.TYPE and o in PROPERTY_KINDS:
                x.kinds[o].add(s)
        x.close()
        return x

    def close(self) -> None:
        # restrictions are compared until nothing follows, as one comparison can make the next hold
        restrictions = sorted(self.on_property)
        changed = True
        while changed:
            changed = False
            classes, props = _close(self.super_classes), _close(self.super_properties)
            below = lambda a, b, up: a == b or b in up.get(a, ())
            for a in restrictions:
                for b in restrictions:
                    if a == b or b in classes.get(a, ()):
                        continue
                    pairs = [(p, q) for p in self.on_property[a] for q in self.on_property[b]]
                    wider_p = any(below(p, q, props) for p, q in pairs)
                    same_p = any(p == q for p, q in pairs)
                    narrower_p = any(below(q, p, props) for p, q in pairs)
                    sub = (
                        (wider_p and any(below(c, d, classes) for c in self.some.get(a, ()) for d in self.some.get(b, ())))
                        or (narrower_p and any(below(c, d, classes) for c in self.all.get(a, ()) for d in self.all.get(b, ())))
                        or (wider_p and bool(self.value.get(a, set()) & self.value.get(b, set())))
                        or (same_p and a in self.most and b in self.most and 0 <= self.most[a] <= self.most[b])
                    )
                    if sub:
                        self.super_classes[a].add(b)
                        changed = True
        self.super_classes, self.super_properties = _close(self.super_classes), _close(self.super_properties)
        for of in (self.domain, self.range):
            for p in set(of) | set(self.super_properties):
                got = set(of.get(p, ()))
                for q in self.super_properties.get(p, ()):
                    got |= of.get(q, set())
                for c in list(got):
                    got |= self.super_classes.get(c, set())
                if got:
                    of[p] = got

    def summary(self) -> dict[str, int]:
        """How much there is of each part."""
        return {
            "classes": len(set(self.super_classes) | set().union(*self.super_classes.values(), set())),
            "properties": len(set(self.super_properties) | set(self.domain) | set(self.range) | set(self.inverse) | set().union(*self.kinds.values(), set())),
            "restrictions": len(self.on_property),
        }

    def contains(self, s: str, p: str, o: str) -> bool:
        """Whether the closed schema says this triple."""
        where = {_R + "subClassOf": self.super_classes, _R + "subPropertyOf": self.super_properties, _R + "domain": self.domain, _R + "range": self.range, _O + "inverseOf": self.inverse, _O + "disjointWith": self.disjoint, _O + "onProperty": self.on_property, _O + "someValuesFrom": self.some, _O + "allValuesFrom": self.all}
        if p == m.TYPE:
            return s in self.kinds.get(o, ())
        return o in where.get(p, {}).get(s, ())


@dataclass
class Result:
    """``facts``: FACT, rule, iteration, span, premises (those given have rule 'given', iteration 0). ``conflicts``: node, rule, about."""

    facts: DataFrame
    conflicts: DataFrame
    schema: Schema
    rounds: int

    def inferred(self) -> DataFrame:
        return self.facts.where("iteration > 0")

    def explain(self, s: str, p: str, o: str, depth: int | None = None) -> list[tuple[str, str]]:
        """(fact, rule) from a fact down to what was given, or for ``depth`` steps; each premise is looked up when it is met."""
        out, todo, seen = [], [f"{s} {p} {o}"], set()
        while depth is None or depth > 0:
            depth = depth and depth - 1
            todo = [k for k in todo if k not in seen]
            if not todo:
                break
            rows = self.facts.where(_key().isin(todo)).select(_key().alias("k"), "rule", "premises").collect()
            seen |= set(todo)
            out += [(r["k"], r["rule"]) for r in rows]
            todo = sorted({x for r in rows for x in r["premises"]})
        return out


def _key(prefix: str = "") -> Column:
    return F.concat_ws(" ", F.col(prefix + "s"), F.col(prefix + "p"), F.col(prefix + "o"))


def schema_of(store: QuadStore, options: Options = Options()) -> Schema:
    df = restrict(store.select(SCHEMA_PREDICATES | {m.TYPE}), options).where(is_schema(F.col("p"), F.col("o")))
    return Schema.build([tuple(r) for r in df.select(*FACT).distinct().collect()])


def premises() -> Column:
    """The premises' keys, from a fact's rule and VIA."""
    term = lambda x: F.lit(m.TYPE) if x == "a" else F.col(x)
    out = F.array().cast("array<string>")
    for rule, keys in PREMISES.items():
        out = F.when(F.col("rule") == rule, F.array(*[F.concat_ws(" ", *[term(x) for x in k.split()]) for k in keys])).otherwise(out)
    return out


@dataclass
class Seen:
    """What some facts have of the schema: predicates and classes with the rules (and for PrpInv the predicate) that gave them.

    ``tagged`` are the predicates of IRIs that have a language.
    """

    predicates: dict = field(default_factory=lambda: defaultdict(set))
    classes: dict = field(default_factory=lambda: defaultdict(set))
    tagged: set = field(default_factory=set)

    def with_(self, other: Seen) -> Seen:
        both = lambda a, b: defaultdict(set, {k: a.get(k, set()) | b.get(k, set()) for k in a.keys() | b.keys()})
        return Seen(both(self.predicates, other.predicates), both(self.classes, other.classes), self.tagged | other.tagged)


@dataclass
class Derived:
    """Rows of a rule, the predicates (of types: classes) that they can have, and whether no fact is there twice."""

    df: DataFrame
    predicates: set
    classes: set
    once: bool = False

    def meets(self, predicates, classes) -> bool:
        # a rule that gives rdf:type as a predicate can give any class
        return not self.predicates.isdisjoint(predicates) or not self.classes.isdisjoint(classes) or m.TYPE in self.predicates or (bool(self.classes) and m.TYPE in predicates)


class Reasoner:
    def __init__(self, spark, schema: Schema):
        self.spark, self.schema = spark, schema
        x, pairs = schema, lambda d: sorted({(a, b) for a, bs in d.items() for b in bs})
        restriction = lambda d: sorted({(r, p, c) for r, cs in d.items() for c in cs for p in x.on_property.get(r, ())})
        self.rows = {
            "domain": pairs(x.domain),
            "range": pairs(x.range),
            "up": [(p, q) for p, q in pairs(x.super_properties) if p != q],
            "inverse": pairs(x.inverse),
            "super": [(a, b) for a, b in pairs(x.super_classes) if b != THING and a != b],
            "some": [t for t in restriction(x.some) if t[2] != THING],
            "some_thing": [(r, p) for r, p, c in restriction(x.some) if c == THING],
            "all": restriction(x.all),
            "value": [(r, p, *v) for r, p, v in restriction(x.value)],
            "disjoint": [(a, b) for a, b in pairs(x.disjoint) if a < b],
            "complement": [(a, b) for a, b in pairs(x.complement) if a < b],
            "apart": [(a, b) for a, b in pairs(x.disjoint_properties) if a < b],
            "none": sorted({(r, p) for r, n in x.most.items() if n == 0 for p in x.on_property.get(r, ())} | {(r, p) for r, n in x.most_of.items() if n == 0 and THING in x.on_class.get(r, ()) for p in x.on_property.get(r, ())}),
        }
        r = self.rows
        self.predicates = {p for n in ("domain", "range") for p, _ in r[n]} | {p for n in ("up", "inverse") for t in r[n] for p in t} | {t[1] for n in ("some", "some_thing", "all", "value") for t in r[n]} | set().union(*x.kinds.values(), set())
        self.classes = {c for n in ("domain", "range") for _, c in r[n]} | {c for t in r["super"] for c in t} | {c for n in ("some", "all") for t in r[n] for c in (t[0], t[2])} | {t[0] for n in ("some_thing", "value") for t in r[n]}
        # transitive properties of which no other rule gives a fact: a fact's span is then its path's length
        given_only = x.kinds.get(_O + "TransitiveProperty", set()) - {q for n in ("up", "inverse") for _, q in r[n]} - {t[1] for t in r["value"]} - x.kinds.get(_O + "SymmetricProperty", set()) - {m.TYPE}
        self.given_only = given_only

    NAMES = {"domain": "_p, _c", "range": "_p, _c", "up": "_p, _q", "inverse": "_p, _q", "super": "_c, _d", "some": "_r, _p, _c", "some_thing": "_r, _p", "all": "_r, _p, _c", "value": "_r, _p, _v, _dt, _lang", "disjoint": "_c, _d", "complement": "_c, _d", "apart": "_p, _q", "none": "_r, _p"}

    def _table(self, name: str, rows: list[tuple] | None = None) -> DataFrame | None:
        rows = self.rows[name] if rows is None else rows
        if not rows:
            return None
        return F.broadcast(self.spark.createDataFrame(rows, ", ".join(f"{n.strip()} string" for n in self.NAMES[name].split(","))))

    def _among(self, df: DataFrame, column: str, values: set) -> DataFrame:
        """Rows with one of these values, as a filter that reaches the scan where they are few."""
        if len(values) <= 200:
            return df.where(F.col(column).isin(*sorted(values)))
        return df.join(F.broadcast(self.spark.createDataFrame([(v,) for v in sorted(values)], "_among string")), F.col(column) == F.col("_among"), "left_semi")

    def _kind(self, kind: str) -> Column | None:
        names = sorted(self.schema.kinds.get(_O + kind, ()))
        return F.col("p").isin(names) if names else None

    def seen(self, d: DataFrame) -> Seen:
        """Read from the facts; what is collected is bounded by the schema."""
        c, out = F.col, Seen()
        typed = c("p") == m.TYPE
        tagged = F.coalesce((c("o_dt") == m.IRI) & (c("o_lang") != ""), F.lit(False))
        rows = d.select(F.coalesce(F.when(typed, c("o")), c("p")).alias("_t"), F.coalesce(typed, F.lit(False)).alias("_typed"), "rule", F.when(c("rule") == "PrpInv", c("v1")).alias("_from"), tagged.alias("_tagged"))
        terms = self.predicates | self.classes
        if terms:
            for t, is_type, rule, source, tag in self._among(rows, "_t", terms).distinct().collect():
                (out.classes if is_type else out.predicates)[t].add((rule, source))
                if tag:
                    out.tagged.add(m.TYPE if is_type else t)
        if m.TYPE in self.predicates:
            out.predicates[m.TYPE].add(("any", None))
        return out

    # rules of one fact and the schema

    def single(self, d: DataFrame, seen: Seen, tagged: set = frozenset()) -> list[Derived]:
        """``tagged``: predicates for which any fact has an IRI with a language; its inverse's inverse lacks it."""
        out: list[Derived] = []
        c, kind = F.col, F.lit(m.TYPE)
        typed, is_iri = c("p") == m.TYPE, c("o_dt") == m.IRI
        by = lambda x, but: {r for r, _ in x} - {but}

        def add(df: DataFrame, s: Column, p: Column, o: Column, rule: str, via: list[Column], predicates=(), classes=(), dt: Column | None = None, lang: Column | None = None, once: bool = False) -> None:
            out.append(Derived(df.select(*_row(s, p, o, rule, c("span") + 1, via, dt, lang)), set(predicates), set(classes), once))

        def sources(name: str, at: int = 0):
            rows = [t for t in self.rows[name] if t[at] in seen.predicates]
            return rows, self._table(name, rows), self._among(d, "p", {t[at] for t in rows})

        rows, table, f = sources("domain")
        if rows:
            add(f.join(table, c("p") == c("_p")), c("s"), kind, c("_c"), "PrpDom", [c("p"), c("o")], classes={x for _, x in rows})
        rows, table, f = sources("range")
        if rows:
            add(f.where(is_iri).join(table, c("p") == c("_p")), c("o"), kind, c("_c"), "PrpRng", [c("s"), c("p")], classes={x for _, x in rows})
        rows = [(p, q) for p, q in self.rows["up"] if p in seen.predicates and by(seen.predicates[p], "PrpSpo1")]
        if rows:
            f = self._among(d.where("rule <> 'PrpSpo1'"), "p", {p for p, _ in rows})
            add(f.join(self._table("up", rows), c("p") == c("_p")), c("s"), c("_q"), c("o"), "PrpSpo1", [c("p")], {q for _, q in rows}, dt=c("o_dt"), lang=c("o_lang"), once=_each_once(rows))
        # a fact that came from its inverse doesn't give that again
        back = lambda q: set() if q in tagged else {("PrpInv", q)}
        rows = [(p, q) for p, q in self.rows["inverse"] if p in seen.predicates and seen.predicates[p] - back(q)]
        if rows:
            f = self._among(d.where(is_iri), "p", {p for p, _ in rows}).join(self._table("inverse", rows), c("p") == c("_p")).where(~((c("rule") == "PrpInv") & c("v1").eqNullSafe(c("_q")) & ~c("_q").isin(*sorted(tagged))))
            add(f, c("o"), c("_q"), c("s"), "PrpInv", [c("p")], {q for _, q in rows}, once=_each_once(rows) and seen.tagged.isdisjoint({p for p, _ in rows}))
        names = {p for p in self.schema.kinds.get(_O + "SymmetricProperty", ()) if p in seen.predicates and (p in tagged or by(seen.predicates[p], "PrpSymp"))}
        if names:
            add(self._among(d.where(is_iri & ((c("rule") != "PrpSymp") | c("p").isin(*sorted(tagged)))), "p", names), c("o"), c("p"), c("s"), "PrpSymp", [], names, once=seen.tagged.isdisjoint(names))
        rows = [(a, b) for a, b in self.rows["super"] if a in seen.classes and by(seen.classes[a], "CaxSco")]
        if rows:
            f = self._among(d.where(typed & (c("rule") != "CaxSco")), "o", {a for a, _ in rows})
            add(f.join(self._table("super", rows), c("o") == c("_c")), c("s"), kind, c("_d"), "CaxSco", [c("o")], classes={b for _, b in rows})
        rows = [t for t in self.rows["value"] if t[0] in seen.classes]
        if rows:
            f = self._among(d.where(typed), "o", {t[0] for t in rows})
            add(f.join(self._table("value", rows), c("o") == c("_r")), c("s"), c("_p"), c("_v"), "ClsHv1", [c("o")], {t[1] for t in rows}, dt=c("_dt"), lang=c("_lang"))
        rows, table, f = sources("value", 1)
        if rows:
            add(f.join(table, (c("p") == c("_p")) & (c("o") == c("_v")) & (c("o_dt") == c("_dt")) & (c("o_lang") == c("_lang"))), c("s"), kind, c("_r"), "ClsHv2", [c("p"), c("o")], classes={t[0] for t in rows})
        rows, table, f = sources("some_thing", 1)
        if rows:
            add(f.join(table, c("p") == c("_p")), c("s"), kind, c("_r"), "ClsSvf2", [c("p"), c("o")], classes={t[0] for t in rows})
        return out

    # rules of two facts: either may be new

    def double(self, a: DataFrame, b: DataFrame, seen_a: Seen, seen_b: Seen, stepped: set) -> list[Derived]:
        """``a`` gives the left and ``b`` the right premise; the transitive properties ``stepped`` are left to ``paths``."""
        out: list[Derived] = []
        c = F.col
        right = b.select(*[c(x).alias(f"b_{x}") for x in (*FACT, "span")])
        is_iri = c("o_dt") == m.IRI

        def add(df: DataFrame, s: Column, p: Column, o: Column, rule: str, via: list[Column], predicates=(), classes=()) -> None:
            out.append(Derived(df.select(*_row(s, p, o, rule, c("span") + c("b_span"), via)), set(predicates), set(classes)))

        def sides(name: str, cls: int):
            rows = [t for t in self.rows[name] if t[1] in seen_a.predicates and t[cls] in seen_b.classes]
            left = self._among(a.where(is_iri), "p", {t[1] for t in rows})
            types = self._among(right.where(c("b_p") == m.TYPE), "b_o", {t[cls] for t in rows})
            return rows, (left.join(self._table(name, rows), c("p") == c("_p")) if rows else left), types.hint("merge")

        rows, left, types = sides("all", 0)  # x p y, x type R
        if rows:
            add(left.join(types, (c("s") == c("b_s")) & (c("_r") == c("b_o"))), c("o"), F.lit(m.TYPE), c("_c"), "ClsAvf", [c("s"), c("p"), c("_r")], classes={t[2] for t in rows})
        rows, left, types = sides("some", 2)  # x p y, y type C
        if rows:
            add(left.join(types, (c("o") == c("b_s")) & (c("_c") == c("b_o"))), c("s"), F.lit(m.TYPE), c("_r"), "ClsSvf1", [c("p"), c("o"), c("_c")], classes={t[0] for t in rows})
        names = {p for p in self.schema.kinds.get(_O + "TransitiveProperty", ()) if p in seen_a.predicates and p in seen_b.predicates} - stepped
        if names:
            onward = self._among(right.where(c("b_o_dt") == m.IRI), "b_p", names).hint("merge")
            add(self._among(a.where(is_iri), "p", names).join(onward, (c("p") == c("b_p")) & (c("o") == c("b_s"))), c("s"), c("p"), c("b_o"), "PrpTrp", [c("o")], names)
        return out

    def paths(self, new: DataFrame, total: DataFrame, names: set, k: int) -> DataFrame:
        """PrpTrp of round ``k`` for properties whose facts are given or paths, so that span is a shortest path's length.

        All paths up to n = 2^(k-1) are known. A longer one, up to 2n, begins with one of exactly n edges: it is put
        together at that one place, and not at each of its nodes.
        """
        c = F.col
        key = ["s", "o"] if len(names) == 1 else ["s", "o", "p"]
        facts = lambda d: self._among(d.where((c("o_dt") == m.IRI)), "p", names)
        left = facts(new).where(c("span") == 2 ** (k - 1)).select(*key, "span")
        right = facts(total).select(*[c(x).alias(f"b_{x}") for x in (*key, "span")]).hint("merge")
        on = c("o") == c("b_s")
        if "p" in key:
            on = on & (c("p") == c("b_p"))
        step = left.join(right, on).select(*[(c("b_o") if x == "o" else c(x)).alias(x) for x in key], (c("span") + c("b_span")).alias("span"), c("o").alias("v1"))
        best = step.groupBy(*key).agg(F.min(F.struct("span", "v1")).alias("_d"))
        fresh = best.join(facts(total).select(*key).hint("merge"), key, "left_anti")
        p = F.lit(next(iter(names))) if len(names) == 1 else c("p")
        return fresh.select(*_row(c("s"), p, c("o"), "PrpTrp", c("_d.span"), [c("_d.v1")]))

    def conflicts(self, f: DataFrame) -> DataFrame:
        """(node, rule, about) over all facts, once each."""
        t, out = {n: self._table(n) for n in ("disjoint", "complement", "apart", "none")}, []
        c = F.col
        other = f.select(*[c(x).alias(f"b_{x}") for x in FACT]).hint("merge")

        def add(df: DataFrame, node: Column, rule: str, about: Column) -> None:
            out.append(df.select(node.alias("node"), F.lit(rule).alias("rule"), about.alias("about")))

        typed, types = f.where(c("p") == m.TYPE), other.where(c("b_p") == m.TYPE).hint("merge")
        for name, rule in (("disjoint", "CaxDw"), ("complement", "ClsCom")):
            if t[name] is not None:
                add(typed.join(t[name], c("o") == c("_c")).join(types, (c("s") == c("b_s")) & (c("_d") == c("b_o"))), c("s"), rule, F.concat_ws(" ", "_c", "_d"))
        add(typed.where(c("o") == NOTHING), c("s"), "ClsNothing2", F.lit(NOTHING))
        if t["apart"] is not None:
            add(f.join(t["apart"], c("p") == c("_p")).join(other, (c("s") == c("b_s")) & (c("_q") == c("b_p")) & (c("o") == c("b_o")) & (c("o_dt") == c("b_o_dt")) & (c("o_lang") == c("b_o_lang"))), c("s"), "PrpPdw", F.concat_ws(" ", "_p", "_q"))
        if (asymmetric := self._kind("AsymmetricProperty")) is not None:
            add(f.where(asymmetric & (c("o_dt") == m.IRI)).join(other, (c("p") == c("b_p")) & (c("o") == c("b_s")) & (c("s") == c("b_o"))), c("s"), "PrpAsyp", c("p"))
        if (irreflexive := self._kind("IrreflexiveProperty")) is not None:
            add(f.where(irreflexive & (c("s") == c("o")) & (c("o_dt") == m.IRI)), c("s"), "PrpIrp", c("p"))
        if t["none"] is not None:
            add(f.join(t["none"], c("p") == c("_p")).join(types, (c("s") == c("b_s")) & (c("_r") == c("b_o"))), c("s"), "ClsMaxc1", c("_r"))
        return reduce(DataFrame.unionByName, out).distinct()

    def fresh(self, derived: list[Derived], total: DataFrame, known: Seen) -> list[DataFrame]:
        """What is derived and not known, each fact once with its smallest derivation."""
        out, several = [], []
        for i, x in enumerate(derived):
            alone = x.once and not any(x.meets(y.predicates, y.classes) or y.meets(x.predicates, x.classes) for j, y in enumerate(derived) if j != i)
            (out if alone else several).append(x)
        if several:
            rows = reduce(DataFrame.unionByName, [x.df for x in several])
            best = rows.groupBy(*FACT).agg(F.min(F.struct("span", "rule", *VIA)).alias("_d")).select(*FACT, *[f"_d.{x}" for x in ("rule", "span", *VIA)])
            out.append(Derived(best, set().union(*[x.predicates for x in several]), set().union(*[x.classes for x in several])))
        got = []
        for x in out:
            if x.meets(known.predicates, known.classes):
                typed = (F.col("p") == m.TYPE) if m.TYPE in x.predicates or len(x.classes) > 200 else (F.col("p") == m.TYPE) & F.col("o").isin(*sorted(x.classes))
                same = total.where(F.col("p").isin(*sorted(x.predicates)) | typed) if len(x.predicates) <= 200 else total
                x.df = x.df.join(same.select(*FACT).hint("merge"), FACT, "left_anti")
            got.append(x.df)
        return got

    def run(self, facts: DataFrame, most_rounds: int = 1000) -> Result:
        keep = Rounds(self.spark)
        given = facts.where(~is_schema(F.col("p"), F.col("o"))).select("s", "p", "o", "o_dt", F.coalesce("o_lang", F.lit("")).alias("o_lang")).distinct()
        no_via = [F.lit(None).cast("string").alias(x) for x in VIA]
        total = new = keep.write(given.select(*FACT, F.lit("given").alias("rule"), F.lit(1).cast("bigint").alias("span"), *no_via, F.lit(0).alias("iteration")))
        written, known = [total._written_to], self.seen(total)
        last = known
        for k in range(1, most_rounds + 1):
            stepped = {p for p in self.given_only if p in known.predicates} - known.tagged
            derived = self.single(new, last, known.tagged) + self.double(new, total, last, known, stepped)
            if k > 1:
                derived += self.double(total, new, known, last, stepped)
            got = self.fresh(derived, total, known)
            if on := {p for p in stepped if p in last.predicates}:
                got.append(self.paths(new, total, on, k))
            if not got:
                break
            found = keep.write(reduce(DataFrame.unionByName, got).select(*FACT, "rule", "span", *VIA, F.lit(k).alias("iteration")))
            if found.isEmpty():
                break
            last = self.seen(found)
            known = known.with_(last)
            written.append(found._written_to)
            total, new = self.spark.read.schema(total.schema).parquet(*written), found
        else:
            raise RuntimeError("the rules did not come to an end")
        return Result(total.select(*FACT, "rule", "span", premises().alias("premises"), "iteration"), self.conflicts(total), self.schema, k - 1)


def _row(s: Column, p: Column, o: Column, rule: str, span: Column, via: list[Column], dt: Column | None = None, lang: Column | None = None) -> list[Column]:
    via = [*via, *[F.lit(None)] * (len(VIA) - len(via))]
    return [
        s.alias("s"), p.alias("p"), o.alias("o"), (F.lit(m.IRI) if dt is None else dt).alias("o_dt"), (F.lit("") if lang is None else lang).alias("o_lang"),
        F.lit(rule).alias("rule"), span.cast("bigint").alias("span"), *[v.cast("string").alias(n) for v, n in zip(via, VIA)],
    ]


def _each_once(rows: list[tuple]) -> bool:
    """Whether no two rows give the same."""
    return len({q for _, q in rows}) == len(rows)


def reason(store: QuadStore, options: Options = Options(), predicates: set[str] | None = None) -> Result:
    """Everything that follows from a store's visible facts (of ``predicates`` only, if given)."""
    schema = schema_of(store, Options(auths=options.auths))
    facts = restrict(store.select(predicates), options)
    if predicates is not None:
        facts = facts.where(F.col("p").isin(*sorted(predicates)))
    return Reasoner(store.spark, schema).run(facts)
