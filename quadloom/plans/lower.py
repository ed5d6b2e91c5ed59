"""Algebra to DataFrames.

A variable is three columns: ``x`` (lexical form), ``x__dt`` and ``x__lang``.
An unbound variable is null in ``x``; datatype and language of what is bound are
never null, so equality of all three is a plain equi-join. Which variables are
surely bound is known from the algebra: only those that OPTIONAL or UNION may
leave open need more than an equi-join, and those inputs are split by which of
them are bound, so that no join ever has an OR in its condition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators import labels
from quadloom.operators.scan import Options, restrict
from quadloom.plans import ir
from quadloom.plans.ir import Term, Var
from quadloom.sources.store import QuadStore

VIS = "_vis"


@dataclass
class Bindings:
    df: DataFrame
    sure: set[str]
    maybe: set[str]

    @property
    def names(self) -> list[str]:
        return sorted(self.sure | self.maybe)


def triple(v: str) -> list[str]:
    return [v, f"{v}__dt", f"{v}__lang"]


def _columns(names, df: DataFrame) -> list[str]:
    return [c for v in names for c in triple(v)] + ([VIS] if VIS in df.columns else [])


def bindings_of(df: DataFrame, sure: list[str], maybe: list[str] = ()) -> Bindings:
    """Bindings from a table with a column for each variable; where datatype and language columns are absent these are IRIs."""
    cols = []
    for v in [*sure, *maybe]:
        for c, default in zip(triple(v), (None, m.IRI, "")):
            cols.append(F.col(c) if c in df.columns else F.lit(default).alias(c))
    if VIS in df.columns:
        cols.append(F.col(VIS))
    return Bindings(df.select(*cols), set(sure), set(maybe))


class Lowering:
    def __init__(self, store: QuadStore, options: Options = Options(), with_labels: bool = False):
        self.store, self.options, self.with_labels = store, options, with_labels

    def __call__(self, node: ir.Node) -> Bindings:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    # leaves

    def _unit(self, node: ir.Unit) -> Bindings:
        df = self.store.spark.range(1).select(*([F.lit("").alias(VIS)] if self.with_labels else []), F.lit(1).alias("_unit"))
        return Bindings(df, set(), set())

    def _rows(self, node: ir.Rows) -> Bindings:
        return bindings_of(node.df, node.sure, node.maybe)

    def _pattern(self, n: ir.Pattern) -> Bindings:
        constant = lambda x: x.lex if isinstance(x, Term) else None
        df = self.store.select(constant(n.p), constant(n.o), constant(n.g) or (True if isinstance(n.g, Var) else None), constant(n.s))
        cond: list[Column] = []
        seen: dict[str, list[Column]] = {}
        for slot, cols in ((n.s, [F.col("s"), F.lit(m.IRI), F.lit("")]), (n.p, [F.col("p"), F.lit(m.IRI), F.lit("")]), (n.o, [F.col("o"), F.col("o_dt"), F.coalesce("o_lang", F.lit(""))]), (n.g, [F.col("g"), F.lit(m.IRI), F.lit("")])):
            if isinstance(slot, Term):
                cond.append(cols[0] == slot.lex)
                if slot is n.o:
                    cond += [cols[1] == slot.dt, cols[2] == slot.lang]
            elif isinstance(slot, Var):
                if slot.name in seen:
                    cond += [a == b for a, b in zip(seen[slot.name], cols)]
                else:
                    seen[slot.name] = cols
                    if slot is n.g:
                        cond.append(cols[0].isNotNull())
        df = restrict(df, self.options)
        if cond:
            df = df.where(reduce(lambda a, b: a & b, cond))
        out = [c.alias(name) for v, cols in seen.items() for name, c in zip(triple(v), cols)]
        if self.with_labels:
            out.append(F.coalesce("vis", F.lit("")).alias(VIS))
        df = df.select(*out) if out else df.select(F.lit(1).alias("_unit"))
        return Bindings(df, set(seen), set())

    def _closure(self, node: ir.Closure) -> Bindings:
        from quadloom.operators.infer import transitive

        p = node.pattern
        return bindings_of(*transitive(self.store, p, self.options))

    # joins

    def _join(self, n: ir.Join) -> Bindings:
        return natural_join(self(n.left), self(n.right), n.hint)

    def _leftjoin(self, n: ir.LeftJoin) -> Bindings:
        return left_join(self(n.left), self(n.right))

    def _minus(self, n: ir.Minus) -> Bindings:
        left, right = self(n.left), self(n.right)
        shared = (left.sure | left.maybe) & (right.sure | right.maybe)
        return Bindings(_unmatched(left, right), left.sure, left.maybe) if shared else left

    def _union(self, n: ir.Union) -> Bindings:
        return union([self(x) for x in n.parts])

    # rows

    def _filter(self, n: ir.Filter) -> Bindings:
        b = self(n.arg)
        got = Bindings(b.df.where(condition(n.condition, set(b.names))), set(b.sure), set(b.maybe))
        return got

    def _project(self, n: ir.Project) -> Bindings:
        b = self(n.arg)
        return project(b, n.names if n.names is not None else b.names, n.distinct)

    def _orderby(self, n: ir.OrderBy) -> Bindings:
        b = self(n.arg)
        keys = []
        for name, up in n.keys:
            if name in b.sure | b.maybe:
                number = F.col(name).try_cast("double")
                for c in (number, *map(F.col, triple(name))):
                    keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        return Bindings(b.df.orderBy(*keys), b.sure, b.maybe) if keys else b

    def _slice(self, n: ir.Slice) -> Bindings:
        b = self(n.arg)
        df = b.df.offset(n.offset) if n.offset else b.df
        return Bindings(df if n.limit is None else df.limit(n.limit), b.sure, b.maybe)


def project(b: Bindings, names: list[str], distinct: bool = False) -> Bindings:
    have = b.sure | b.maybe
    cols = []
    for v in names:
        cols += [F.col(c) if v in have else F.lit(None).cast("string").alias(c) for c in triple(v)]
    if VIS in b.df.columns:
        cols.append(F.col(VIS))
    df = b.df.select(*cols)
    return Bindings(df.distinct() if distinct else df, b.sure & set(names), set(names) - b.sure)


def union(parts: list[Bindings], distinct: bool = False) -> Bindings:
    names = set().union(*(p.sure | p.maybe for p in parts))
    sure = set.intersection(*(p.sure for p in parts))
    dfs = []
    for p in parts:
        have = p.sure | p.maybe
        cols = [F.col(c) if v in have else F.lit(None).cast("string").alias(c) for v in sorted(names) for c in triple(v)]
        dfs.append(p.df.select(*cols, *([VIS] if VIS in p.df.columns else [])))
    df = reduce(DataFrame.unionByName, dfs)
    return Bindings(df.distinct() if distinct else df, sure, names - sure)


def _splits(b: Bindings, shared: set[str]):
    """Parts of the rows by which shared variables are bound: (DataFrame, bound ones). One part where all are sure."""
    open_ = sorted(shared & b.maybe)
    for k in range(len(open_) + 1):
        for unbound in combinations(open_, k):
            df = b.df
            for v in open_:
                df = df.where(F.col(v).isNull() if v in unbound else F.col(v).isNotNull())
            yield df, shared - set(unbound)


def _renamed(df: DataFrame, names: set[str]) -> DataFrame:
    cols = []
    for c in df.columns:
        v = c.removesuffix("__dt").removesuffix("__lang")
        cols.append(F.col(c).alias(f"r_{c}") if v in names or c in (VIS, "_unit") else F.col(c))
    return df.select(*cols)


def _equal(names: set[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"r_{c}") for v in sorted(names) for c in triple(v)])


def _joined(left: Bindings, right: Bindings, ldf: DataFrame, rdf: DataFrame, on: set[str], shared: set[str], how: str, hint: str | None = None) -> DataFrame:
    r = _renamed(rdf, shared)
    if hint:
        r = r.hint(hint)
    if on:
        df = ldf.join(r, _equal(on), how)
    elif how == "inner":
        df = ldf.crossJoin(r)
    else:
        df = ldf.join(r, F.lit(True), how)
    cols = []
    for v in sorted(left.sure | left.maybe | right.sure | right.maybe):
        for c in triple(v):
            if v in shared and v not in on:
                cols.append(F.coalesce(F.col(c), F.col(f"r_{c}")).alias(c))
            else:
                cols.append(F.col(c))
    if VIS in ldf.columns:
        cols.append(labels.conjunction(F.col(VIS), F.coalesce(f"r_{VIS}", F.lit(""))).alias(VIS))
    return df.select(*cols) if cols else df.select(F.lit(1).alias("_unit"))


def natural_join(left: Bindings, right: Bindings, hint: str | None = None, distinct: bool = False) -> Bindings:
    """All compatible pairs; an unbound variable is compatible with anything, without shared variables it is the product."""
    shared = (left.sure | left.maybe) & (right.sure | right.maybe)
    parts = []
    for ldf, lbound in _splits(left, shared):
        for rdf, rbound in _splits(right, shared):
            parts.append(_joined(left, right, ldf, rdf, lbound & rbound, shared, "inner", hint))
    df = reduce(DataFrame.unionByName, parts)
    sure = left.sure | right.sure
    return Bindings(df.distinct() if distinct else df, sure, (left.maybe | right.maybe) - sure)


def _unmatched(left: Bindings, right: Bindings) -> DataFrame:
    """Rows of the left side that are compatible with none of the right side."""
    shared = (left.sure | left.maybe) & (right.sure | right.maybe)
    parts = []
    for ldf, lbound in _splits(left, shared):
        for rdf, rbound in _splits(right, shared):
            on = lbound & rbound
            r = _renamed(rdf, shared)
            ldf = ldf.join(r, _equal(on) if on else F.lit(True), "left_anti")
        parts.append(ldf)
    return reduce(DataFrame.unionByName, parts)


def left_join(left: Bindings, right: Bindings, distinct: bool = False) -> Bindings:
    """OPTIONAL: compatible pairs, and the left rows without any as they are."""
    shared = (left.sure | left.maybe) & (right.sure | right.maybe)
    maybe = (left.maybe | right.sure | right.maybe) - left.sure
    if shared <= left.sure and shared <= right.sure:
        df = _joined(left, right, left.df, right.df, shared, shared, "left")
    else:
        both = natural_join(left, right).df
        alone = _unmatched(left, right)
        add = [F.lit(None).cast("string").alias(c) for v in sorted((right.sure | right.maybe) - shared) for c in triple(v)]
        df = both.unionByName(alone.select(*_columns(left.names, alone), *add))
    return Bindings(df.distinct() if distinct else df, set(left.sure), maybe)


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
NUMERIC = {m.INTEGER, m.DECIMAL, m.DOUBLE, m.XSD + "int", m.XSD + "long", m.XSD + "float"}


def condition(e: tuple, have: set[str]) -> Column:
    """A filter's condition. An error (unbound variable, text where a number is asked) is null, so the row goes."""
    op = e[0]
    if op in ("and", "or"):
        a, b = condition(e[1], have), condition(e[2], have)
        return a & b if op == "and" else a | b
    if op == "not":
        return ~condition(e[1], have)
    if op == "bound":
        return F.col(e[1].name).isNotNull() if e[1].name in have else F.lit(False)
    parts = lambda x: [F.lit(None).cast("string")] * 3 if isinstance(x, Var) and x.name not in have else [F.col(c) for c in triple(x.name)] if isinstance(x, Var) else [F.lit(x.lex), F.lit(x.dt), F.lit(x.lang)]
    if op == "regex":
        flags = f"(?{e[3]})" if len(e) > 3 and e[3] else ""
        return parts(e[1])[0].rlike(flags + e[2])
    if op in ("contains", "strstarts", "strends"):
        text = parts(e[1])[0]
        return {"contains": text.contains, "strstarts": text.startswith, "strends": text.endswith}[op](e[2])
    if op == "lang":
        return parts(e[1])[2] == e[2]
    _, sign, a, b = e
    numeric = any(isinstance(x, Term) and x.dt in NUMERIC for x in (a, b))
    pa, pb = parts(a), parts(b)
    if numeric:
        number = lambda x, p: F.lit(float(x.lex)) if isinstance(x, Term) and x.dt in NUMERIC else p[0].try_cast("double")
        return _COMPARE[sign](number(a, pa), number(b, pb))
    if sign in ("=", "!="):
        same = (pa[0] == pb[0]) & (pa[1] == pb[1]) & (pa[2] == pb[2])
        return same if sign == "=" else ~same
    return _COMPARE[sign](pa[0], pb[0])


def evaluate(store: QuadStore, node: ir.Node, options: Options = Options(), with_labels: bool = False) -> DataFrame:
    """One column for each variable with its lexical form, and ``_vis`` where labels are asked for."""
    b = Lowering(store, options, with_labels)(node)
    names = ir.projection(node)
    names = b.names if names is None else names
    return b.df.select(*names, *([VIS] if VIS in b.df.columns else []))
