"""Compatible-mapping joins against brute force, rewrites against what they rewrite, and the parser."""

import itertools
import random

import pytest

from quadloom import model as m
from quadloom.operators import infer, pcj
from quadloom.plans import ir, lower, optimize, sparql, stats
from quadloom.sources.store import QuadStore

PAIRS = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "c"), ("d", "a")]


def table(spark, names, rows, sure):
    cols = ", ".join(f"{v} string" for v in names)
    df = spark.createDataFrame(rows, cols)
    return lower.bindings_of(df.selectExpr(*[x for v in names for x in (v, f"if({v} is null, null, '{m.IRI}') as {v}__dt", f"if({v} is null, null, '') as {v}__lang")]), [v for v in names if v in sure], [v for v in names if v not in sure])


def merged(a, b):
    shared = set(a) & set(b)
    if any(a[k] is not None and b[k] is not None and a[k] != b[k] for k in shared):
        return None
    return {k: a.get(k) if a.get(k) is not None else b.get(k) for k in {**a, **b}}


def brute(left, right, outer):
    out = []
    for a in left:
        hits = [x for b in right if (x := merged(a, b)) is not None]
        out += hits or ([{**{k: None for b in right for k in b}, **a}] if outer else [])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_joins(spark, seed):
    draw = random.Random(seed)
    some = lambda null: draw.choice("xyz" + "_" * null)
    rows = lambda n, nulls: [tuple(None if (c := some(k)) == "_" else c for k in nulls) for _ in range(n)]
    left, right = rows(7, (0, 2, 1)), rows(8, (0, 1, 0))
    a, b = table(spark, ["p", "q", "r"], left, {"p"}), table(spark, ["p", "q", "t"], right, {"p", "t"})
    l, r = [dict(zip("pqr", x)) for x in left], [dict(zip("pqt", x)) for x in right]
    for got, outer in ((lower.natural_join(a, b), False), (lower.left_join(a, b), True)):
        have = sorted(map(repr, (tuple(x) for x in got.df.select("p", "q", "r", "t").collect())))
        assert have == sorted(repr(tuple(x[k] for k in "pqrt")) for x in brute(l, r, outer))


def graph(spark, pairs=PAIRS):
    rows = [(f"u:{x}", f"u:{p}", f"u:{y}", m.IRI, "") for p in ("p", "q") for x, y in pairs]
    return QuadStore.of(spark.createDataFrame(rows, "s string, p string, o string, o_dt string, o_lang string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_no_or_in_join_conditions(spark):
    node = sparql.parse("SELECT * { ?a <u:p> ?b OPTIONAL { ?b <u:q> ?c } ?c <u:p> ?d }")
    plan = lower.evaluate(graph(spark), node)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(" OR " in line for line in plan.splitlines() if "Join" in line)


def test_repeated_variable_and_literals(spark):
    assert rows(lower.evaluate(graph(spark), sparql.parse("SELECT ?x { ?x <u:p> ?x }"))) == [("u:c",)]
    df = spark.createDataFrame([("u:a", "u:n", v, dt, lang) for v, dt, lang in (("1", m.INTEGER, ""), ("1", m.STRING, ""), ("01", m.INTEGER, ""), ("x", m.LANG_STRING, "en"), ("x", m.STRING, ""))], "s string, p string, o string, o_dt string, o_lang string")
    s = QuadStore.of(df)
    count = lambda t: lower.evaluate(s, sparql.parse("SELECT ?s { ?s <u:n> %s }" % t)).count()
    assert [count(t) for t in ("1", '"1"', '"x"', '"x"@en', '"01"^^<%s>' % m.INTEGER)] == [1, 1, 1, 1, 1]
    assert lower.evaluate(s, sparql.parse("SELECT ?v { ?s <u:n> ?v FILTER(?v <= 1) }")).count() == 3


def test_join_order_and_views_change_nothing(spark, tmp_path):
    s = graph(spark)
    text = "SELECT ?a ?d { ?a <u:p> ?b . ?c <u:q> ?d . ?b <u:p> ?c }"
    node = sparql.parse(text)
    want = rows(lower.evaluate(s, node))
    assert want
    table_ = stats.prospects(s.quads)
    ordered = optimize.order_joins(node, stats.Statistics.of(table_, node))
    assert rows(lower.evaluate(s, ordered)) == want
    terms = optimize._terms(ordered.arg)
    for before, now in zip(itertools.accumulate((set(t.vars()) for t in terms), set.union), terms[1:]):
        assert before & set(now.vars())
    catalog = pcj.Catalog(spark, f"file://{tmp_path}/views")
    catalog.create("SELECT ?x ?y ?z { ?x <u:p> ?y . ?y <u:p> ?z }", s, "two", with_labels=False)
    catalog.create("SELECT ?x { ?x <u:p> ?y . ?y <u:q> ?z }", s, "hides", with_labels=False)
    used = optimize.use_views(node, catalog.views())
    assert len(list(ir.patterns(used))) == 1
    assert rows(lower.evaluate(s, used)) == want
    assert catalog.cardinality("two") == catalog.rows("two").count() > 0
    assert catalog.find("SELECT ?x ?y ?z\n{ ?x <u:p> ?y.\n?y <u:p> ?z }") == "two"
    catalog.append("two", catalog.rows("two"))
    assert catalog.cardinality("two") == catalog.rows("two").count()
    assert catalog.ordered("two", "y;z;x").count() == catalog.rows("two").count()
    catalog.purge("two")
    assert catalog.rows("two").count() == catalog.cardinality("two") == 0
    catalog.drop("two")
    assert catalog.list() == ["hides"]


def test_report(spark):
    got = {r.node: r.n for r in pcj.report(graph(spark), sparql.parse("SELECT ?x { ?x <u:p> ?y FILTER(?y = <u:c>) }")).collect()}
    assert got == {"0 Project": 3, "0.0 Filter": 3, "0.0.0 Pattern": 5}


def test_parser():
    n = sparql.parse('PREFIX e: <http://x.y/z.> SELECT DISTINCT ?a { ?a a e:T ; e:p "a\\"b"@en , 1.5 . FILTER(?a != e:q) } LIMIT 3')
    assert isinstance(n, ir.Slice) and n.limit == 3 and n.arg.distinct
    ps = list(ir.patterns(n))
    assert [p.o for p in ps] == [ir.iri("http://x.y/z.T"), ir.literal('a"b', lang="en"), ir.Term("1.5", m.DECIMAL)]
    u = sparql.parse("INSERT DATA { <u:a> <u:p> 1 . GRAPH <u:g> { <u:b> <u:p> <u:c> } }")
    assert u.insert == [("u:a", "u:p", ir.Term("1", m.INTEGER), None), ("u:b", "u:p", ir.iri("u:c"), "u:g")]
    for bad in ("SELECT ?a {", "SELECT ?a { ?a ?b }", "SELECT { }", "SELECT ?a { ?a x:y ?b }", "INSERT DATA { ?a <u:p> 1 }", "SELECT ?a { ?a <u:p> ?b } nonsense"):
        with pytest.raises(ValueError):
            sparql.parse(bad)


def test_cardinality_model():
    v = ir.Var
    st = stats.Statistics({("p", "u:p", "", ""): 50, ("po", "u:p", "u:o", ""): 5}, table_size=1000)
    p = ir.Pattern(v("a"), ir.iri("u:p"), v("b"))
    assert st.cardinality(p) == 50
    assert st.cardinality(ir.Pattern(v("a"), ir.iri("u:p"), ir.iri("u:o"))) == 5
    assert st.cardinality(ir.Pattern(v("a"), ir.iri("u:none"), v("b"))) == 1
    assert st.cardinality(ir.Pattern(v("a"), v("p"), v("b"))) == 1000
    assert st.pattern(ir.Pattern(v("a"), ir.iri(m.TYPE), v("b"))) > st.pattern(ir.Pattern(v("a"), v("p"), v("b")))
    assert st.cardinality(ir.Filter((), p)) == 5 and st.cardinality(ir.Union([p, p])) == 100


def test_inference(spark):
    rows_ = [("u:b", infer.SUB_CLASS, "u:a"), ("u:c", infer.SUB_CLASS, "u:b"), ("u:a", infer.SUB_CLASS, "u:c"), ("u:x", m.TYPE, "u:c"), ("u:y", m.TYPE, "u:a"), ("u:p", infer.EQUIVALENT_PROPERTY, "u:q"), ("u:r", infer.INVERSE, "u:p"), ("u:1", "u:q", "u:2"), ("u:3", "u:r", "u:4"), ("u:s", infer.SAME_AS, "u:t"), ("u:t", infer.SAME_AS, "u:w")]
    s = QuadStore.of(spark.createDataFrame([(*r, m.IRI, "") for r in rows_], "s string, p string, o string, o_dt string, o_lang string"))
    assert rows(infer.class_descendants(s, "u:a")) == [("u:a",), ("u:b",), ("u:c",)]
    assert rows(infer.instances_of(s, "u:b")) == [("u:x", "u:b"), ("u:y", "u:b")]
    node = infer.expand(sparql.parse("SELECT ?a ?b { ?a <u:p> ?b }"), s)
    assert rows(lower.evaluate(s, node)) == [("u:1", "u:2"), ("u:4", "u:3")]
    assert rows(infer.same_as(s, "u:w")) == [("u:s",), ("u:t",), ("u:w",)]
