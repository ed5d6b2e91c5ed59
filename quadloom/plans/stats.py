"""Cardinalities of terms and pairs of terms, and the estimates that join ordering works with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.plans import ir

KINDS = {"s": ["s"], "p": ["p"], "o": ["o"], "sp": ["s", "p"], "so": ["s", "o"], "po": ["p", "o"]}
EMPTY_TYPE, UNBOUND = float("inf"), 1e300


def prospects(quads: DataFrame, kinds: list[str] | None = None, by_graph: bool = False) -> DataFrame:
    """(kind, a, b, g, n): how many statements have each term or pair.

    One pass: every statement is expanded into its keys and counted with map-side
    combining; ``GROUPING SETS`` in SQL terms.
    """
    keys = [F.struct(F.lit(k).alias("kind"), F.col(KINDS[k][0]).alias("a"), (F.col(KINDS[k][1]) if len(KINDS[k]) > 1 else F.lit("")).alias("b")) for k in (kinds or list(KINDS))]
    g = F.coalesce("g", F.lit("")) if by_graph else F.lit("")
    return quads.select(F.explode(F.array(*keys)).alias("e"), g.alias("g")).groupBy("e.kind", "e.a", "e.b", "g").agg(F.count("*").alias("n"))


@dataclass
class Statistics:
    """Counts of the constants of one query, looked up in a prospects table; ``selectivity`` of pairs of terms is given by the caller."""

    counts: dict[tuple[str, str, str, str], int] = field(default_factory=dict)
    table_size: float = 0.0
    selectivity: dict[tuple[str, str], float] = field(default_factory=dict)
    composite: bool = True
    type_last: bool = True

    @classmethod
    def of(cls, table: DataFrame, node: ir.Node, table_size: float | None = None) -> Statistics:
        """Only the keys that the query's patterns have are collected."""
        keys = {(k, a, b) for p in ir.patterns(node) for k, a, b in [_key(p, c) for c in (True, False)] if k}
        out = cls(table_size=table_size or 0.0)
        if keys:
            wanted = F.broadcast(table.sparkSession.createDataFrame(sorted(keys), "kind string, a string, b string"))
            out.counts = {(r.kind, r.a, r.b, r.g): r.n for r in table.join(wanted, ["kind", "a", "b"]).select("kind", "a", "b", "g", "n").collect()}
        if table_size is None:
            out.table_size = float(table.where("kind = 'p'").agg(F.sum("n")).first()[0] or 0)
        return out

    def cardinality(self, n: ir.Node) -> float:
        if isinstance(n, ir.Filter):
            return self.cardinality(n.arg) / 10
        if isinstance(n, ir.Pattern):
            got = self.pattern(n)
            return self.table_size if got >= UNBOUND else got
        if isinstance(n, ir.Join):
            l, r = self.cardinality(n.left), self.cardinality(n.right)
            return r + l + l * r * self.selectivity.get((repr(n.left), repr(n.right)), 0.0)
        if isinstance(n, ir.Union):
            return sum(map(self.cardinality, n.parts))
        if isinstance(n, ir.Project):
            return self.cardinality(n.arg) - 1
        if isinstance(n, ir.Slice):
            return float(n.limit) if n.limit is not None else self.cardinality(n.arg)
        if isinstance(n, (ir.LeftJoin, ir.Minus)):
            return self.cardinality(n.left)
        if isinstance(n, ir.OrderBy):
            return self.cardinality(n.arg)
        return 1.0

    def pattern(self, n: ir.Pattern) -> float:
        """0 for fixed ones; nothing is worse than all types of everything; a term that was never counted is 1."""
        if n.fixed:
            return 0.0
        if self.type_last and isinstance(n.p, ir.Term) and n.p.lex == m.TYPE and not isinstance(n.s, ir.Term) and not isinstance(n.o, ir.Term):
            return EMPTY_TYPE
        kind, a, b = _key(n, self.composite)
        if not kind:
            return UNBOUND
        g = n.g.lex if isinstance(n.g, ir.Term) else ""
        return float(self.counts.get((kind, a, b, g), self.counts.get((kind, a, b, ""), 1)))


def _key(n: ir.Pattern, composite: bool) -> tuple[str, str, str]:
    s, p, o = (x.lex if isinstance(x, ir.Term) else None for x in (n.s, n.p, n.o))
    if s is not None:
        if composite and p is not None:
            return "sp", s, p
        if composite and o is not None:
            return "so", s, o
        return "s", s, ""
    if p is not None:
        return ("po", p, o) if composite and o is not None else ("p", p, "")
    return ("o", o, "") if o is not None else ("", "", "")
