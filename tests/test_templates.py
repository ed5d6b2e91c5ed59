"""Bound IRIs as conditions on keys, the default time of a TTL, and intervals as single expressions."""

import pytest
from pyspark.sql import functions as F

from quadloom.functions import times
from quadloom.operators import scan
from quadloom.plans import ir, lower, sparql
from quadloom.sources import codefacts
from quadloom.sources.mapping import P, store
from quadloom.sources.store import Template


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("iri, want", [("urn:a:7", "(k) = 7"), ("urn:a:-7", "(k) = -7"), ("urn:a:0", "(k) = 0"), ("urn:a:07", None), ("urn:a:x", None), ("urn:a:", None), ("urn:a", None), ("urn:ab:7", None), ("urn:a:7:8", None), ("urn:a:1; drop", None), ("urn:a:" + "9" * 30, None)])
def test_condition(iri, want):
    assert Template("urn:a", ("k",)).condition(iri) == want


def test_two_keys():
    assert Template("urn:t", ("a", "b - 1")).condition("urn:t:3:4") == "(a) = 3 and (b - 1) = 4"


def test_keys_reach_the_scan(spark, small):
    s = store(spark, small)
    one = scan.scan(s, s="urn:customer:7", p=P + "inNation")
    assert "EqualTo(c_custkey,7)" in plan(one) and plan(one).count("FileScan") == 1
    by_object = scan.scan(s, o="urn:nation:3")
    assert plan(by_object).count("EqualTo(c_nationkey,3)") == 2 and "EqualTo(s_nationkey,3)" in plan(by_object)
    asked = lower.evaluate(s, sparql.parse("SELECT ?o { ?o p:placedBy <urn:customer:5> }", {"p": P}))
    assert "EqualTo(o_custkey,5)" in plan(asked)
    assert scan.scan(s, s="urn:customer:7x").count() == 0 and scan.scan(s, s="urn:customer:7").count() == s.quads.where("s = 'urn:customer:7'").count() > 0
    assert scan.scan(s, o=ir.iri("urn:part:3"), p=P + "partOf").count() == s.select(P + "partOf").where("o = 'urn:part:3'").count()


def test_latest(spark, small):
    s = store(spark, small)
    assert s.latest() == s.quads.agg(F.max("ts")).first()[0]
    assert s.map(lambda df: df.where("s like 'urn:customer:%'")).latest() == 0
    assert s.map(lambda df: df.where("false")).latest() is None
    clocks = {p.clock for p in s.parts if p.ts is None}
    assert len(clocks) == 2


def test_interval_values(spark):
    rows = [("[2020-01-01T00:00:00Z,2020-01-02T00:00:00+01:00]",), ("[2020-01-02T00:00:00Z,2020-01-01T00:00:00Z]",), ("2020-01-01",), ("2020-13-01",), (None,), ("",)]
    got = spark.createDataFrame(rows, "o string").select("o", times.interval(F.col("o")).alias("i"), times.marker(F.col("o"), True).alias("m")).collect()
    assert [(r.i and tuple(r.i), r.m) for r in got] == [(("2020-01-01T00:00:00Z", "2020-01-01T23:00:00Z"), None), (None, None), (None, "2020-01-01T23:59:59Z"), (None, None), (None, None), (None, None)]


def test_findings_have_no_cap(spark):
    df = spark.createDataFrame([("a.js", "\n".join("let token = 1" for _ in range(500)))], "path string, content string")
    assert codefacts.findings(df).count() == 500 and codefacts.findings(df, cap=80).count() == 80
