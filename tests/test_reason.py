"""One small case for each rule of the reasoner, and closures against brute force."""

import random

import pytest

from quadloom import catalog
from quadloom import model as m
from quadloom.operators import closure, reason
from quadloom.operators.reason import Reasoner, Schema

O, R, T = m.OWL, m.RDFS, m.TYPE
ON = O + "onProperty"
CASES = [
    ("PrpDom", [("p", R + "domain", "C")], [("x", "p", "y")], ("x", T, "C")),
    ("PrpRng", [("p", R + "range", "C")], [("x", "p", "y")], ("y", T, "C")),
    ("PrpSpo1", [("p", R + "subPropertyOf", "q"), ("q", R + "subPropertyOf", "r")], [("x", "p", "y")], ("x", "r", "y")),
    ("PrpInv", [("p", O + "inverseOf", "q")], [("x", "q", "y")], ("y", "p", "x")),
    ("PrpSymp", [("p", T, O + "SymmetricProperty")], [("x", "p", "y")], ("y", "p", "x")),
    ("PrpTrp", [("p", T, O + "TransitiveProperty")], [("x", "p", "y"), ("y", "p", "z"), ("z", "p", "w")], ("x", "p", "w")),
    ("CaxSco", [("C", R + "subClassOf", "D"), ("D", R + "subClassOf", "E")], [("x", T, "C")], ("x", T, "E")),
    ("ClsHv1", [("V", ON, "p"), ("V", O + "hasValue", "v")], [("x", T, "V")], ("x", "p", "v")),
    ("ClsHv2", [("V", ON, "p"), ("V", O + "hasValue", "v")], [("x", "p", "v")], ("x", T, "V")),
    ("ClsSvf1", [("V", ON, "p"), ("V", O + "someValuesFrom", "C")], [("x", "p", "y"), ("y", T, "C")], ("x", T, "V")),
    ("ClsSvf2", [("V", ON, "p"), ("V", O + "someValuesFrom", O + "Thing")], [("x", "p", "y")], ("x", T, "V")),
    ("ClsAvf", [("V", ON, "p"), ("V", O + "allValuesFrom", "C")], [("x", "p", "y"), ("x", T, "V")], ("y", T, "C")),
    ("domain is inherited", [("p", R + "subPropertyOf", "q"), ("q", R + "domain", "C"), ("C", R + "subClassOf", "D")], [("x", "p", "y")], ("x", T, "D")),
    ("restrictions compare", [("V", ON, "p"), ("V", O + "someValuesFrom", "C"), ("W", ON, "p"), ("W", O + "someValuesFrom", "D"), ("C", R + "subClassOf", "D")], [("x", T, "V")], ("x", T, "W")),
]
CONFLICTS = [
    ("CaxDw", [("C", O + "disjointWith", "D")], [("x", T, "C"), ("x", T, "D")], "x"),
    ("ClsCom", [("C", O + "complementOf", "D")], [("x", T, "C"), ("x", T, "D")], "x"),
    ("ClsNothing2", [], [("x", T, O + "Nothing")], "x"),
    ("PrpPdw", [("p", O + "propertyDisjointWith", "q")], [("x", "p", "y"), ("x", "q", "y")], "x"),
    ("PrpAsyp", [("p", T, O + "AsymmetricProperty")], [("x", "p", "y"), ("y", "p", "x")], "x"),
    ("PrpIrp", [("p", T, O + "IrreflexiveProperty")], [("x", "p", "x")], "x"),
    ("ClsMaxc1", [("V", ON, "p"), ("V", O + "maxCardinality", "0")], [("x", "p", "y"), ("x", T, "V")], "x"),
]


def run(spark, schema, facts):
    df = spark.createDataFrame([(s, p, o, m.IRI, "") for s, p, o in facts], "s string, p string, o string, o_dt string, o_lang string")
    return Reasoner(spark, Schema.build([(s, p, o, m.IRI, "") for s, p, o in schema])).run(df)


@pytest.mark.parametrize("name,schema,facts,want", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, name, schema, facts, want):
    got = run(spark, schema, facts)
    assert want in {tuple(r) for r in got.inferred().select("s", "p", "o").collect()}
    if name == "PrpTrp":
        chain = got.explain(*want)
        assert [k for k, rule in chain if rule == "given"] and got.facts.where("iteration > 0").count() == 3


@pytest.mark.parametrize("name,schema,facts,node", CONFLICTS, ids=[c[0] for c in CONFLICTS])
def test_conflict(spark, name, schema, facts, node):
    assert (node, name) in {(r.node, r.rule) for r in run(spark, schema, facts).conflicts.collect()}
    assert not run(spark, schema, facts[:1]).conflicts.where(f"rule = '{name}'").count() or len(facts) == 1


def test_closures(spark):
    draw = random.Random(3)
    edges = {(draw.randrange(15), draw.randrange(15)) for _ in range(18)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in edges], "x string, y string")
    assert {tuple(map(int, r)) for r in closure.closure(df).collect()} == want
    start = spark.createDataFrame([("03",), ("07",)], "x string")
    assert {int(r.x) for r in closure.reachable(df, start).collect()} == {b for a, b in want if a in (3, 7)}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {int(r.x): int(r.root) for r in closure.groups(df).collect()} == root
    none = df.limit(0)
    assert closure.closure(none).count() == closure.reachable(none, start).count() == closure.groups(none).count() == 0


def chain(n):
    return [(f"x{i:02d}", "p", f"x{i + 1:02d}") for i in range(n)]


def written(monkeypatch, go):
    """What ``go`` gives, and the physical plans of the tables that it wrote."""
    plans, write = [], reason.Rounds.write

    def watch(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(reason.Rounds, "write", watch)
    return go(), plans


def test_only_rules_that_can_fire_are_planned(spark, small, monkeypatch):
    r, plans = written(monkeypatch, lambda: catalog._reasoned(spark, small, [T]))
    assert r.inferred().count() and sum(p.count("BroadcastHashJoin") for p in plans) <= 1
    # no fact is broadcast, however small
    _, plans = written(monkeypatch, lambda: catalog._reasoned(spark, small, ["hasSupplier", "placedBy"]))
    assert not any("BroadcastHashJoin [s#" in p or "BroadcastHashJoin [coalesce(s#" in p for p in plans)


def test_paths_are_put_together_once(spark):
    got = run(spark, [("p", T, O + "TransitiveProperty")], chain(20)).facts.where("iteration > 0").select("s", "o", "span", "iteration", "premises").collect()
    at = lambda x: int(x[1:])
    assert len(got) == 21 * 20 // 2 - 20 and all(r.span == at(r.o) - at(r.s) for r in got)
    for r in got:  # the first premise has 2^k edges, wherever else the path could be cut
        assert r.premises[0] == f"{r.s} p x{at(r.s) + 2 ** (r.iteration - 1):02d}"


def test_facts_are_written_once(spark, small, monkeypatch):
    for names, most in ((["placedBy"], 2), (["hasSupplier", "placedBy"], 4)):
        r, plans = written(monkeypatch, lambda: catalog._reasoned(spark, small, names))
        assert len(plans) <= most and r.inferred().count()
        monkeypatch.undo()
