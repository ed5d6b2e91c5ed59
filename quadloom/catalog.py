"""The engine's registered queries over the mapped tables, each with SQL over the relational tables as an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.functions import times, values
from quadloom.operators import entity, geo, infer, merge, pcj, reason, records, scan, temporal, text
from quadloom.operators.scan import BoundPattern, Options
from quadloom.plans import ir, lower, optimize, sparql, stats
from quadloom.scratch import shared_dir
from quadloom.sources import codefacts, rdfio
from quadloom.sources.mapping import C, P, Star, millis, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PREFIXES = {"p": P, "c": C, "g": "urn:g:"}
DAY = 86_400_000


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def ask(spark: SparkSession, sf_dir: str, text_: str, options: Options = Options(), with_labels: bool = False) -> DataFrame:
    return lower.evaluate(store(spark, sf_dir), sparql.parse(text_, PREFIXES), options, with_labels)


# scans


@query("SELECT 'urn:customer:' || c_custkey AS s, 'urn:nation:' || c_nationkey AS o FROM customer WHERE c_custkey = 7")
def scan_sp(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), s="urn:customer:7", p=P + "inNation").select("s", "o")


@query("SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_po(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), p=P + "segment", o=ir.literal("BUILDING")).select("s")


@query(
    """SELECT 'urn:customer:' || c_custkey AS s, 'urn:p:inNation' AS p FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:p:inNation' FROM supplier WHERE s_nationkey = 3
UNION ALL SELECT 'urn:customer:' || c_custkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' FROM customer WHERE c_nationkey = 3"""
)
def scan_o(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), o="urn:nation:3").select("s", "p")


@query(
    """SELECT 3 * (SELECT count(*) FROM region) + 4 * (SELECT count(*) FROM nation) + 8 * (SELECT count(*) FROM customer) + 5 * (SELECT count(*) FROM supplier)
+ 4 * (SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE p_partkey > 0) + 6 * (SELECT count(*) FROM orders)
+ (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))
+ (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) + 4 * (SELECT count(*) FROM events) + 2 * (SELECT count(*) FROM documents)
+ (SELECT count(*) FROM conversations) + (SELECT count(*) FROM conversations WHERE turn > 0) + 14 AS n"""
)
def scan_all_count(spark, sf_dir):
    return store(spark, sf_dir).quads.agg(F.count("*").alias("n"))


@query("SELECT 'urn:event:' || event_id AS s, 'urn:user:' || user_id AS o FROM events WHERE event_type = 'purchase'")
def scan_graph(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), p=P + "user", g="urn:g:purchase").select("s", "o")


@query("SELECT 'urn:part:' || p_partkey AS s, p_type AS o FROM part WHERE contains(p_type, 'A')")
def scan_regex_contains(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), p=P + "kind", options=Options(o_like=".*A.*")).select("s", "o")


@query("SELECT 'urn:part:' || p_partkey AS s, p_brand AS o FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#1-', 'Brand#13')")
def scan_regex_class(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), p=P + "brand", options=Options(o_like="Brand#1[12-3]")).select("s", "o")


def _visible(auths: tuple[str, ...]):
    def run(spark, sf_dir):
        return scan.scan(store(spark, sf_dir), p=P + "kind", options=Options(auths=auths)).where(F.col("s").startswith("urn:event:")).select("s", "o")

    return run


for _name, _auths, _kinds in (("scan_visibility_ops", ("ops",), "'error', 'signup', 'view'"), ("scan_visibility_fin_ops", ("fin", "ops"), "'error', 'purchase', 'signup', 'view'"), ("scan_visibility_none", (), "'view'")):
    QUERIES[_name] = _visible(_auths)
    ORACLE[_name] = f"SELECT 'urn:event:' || event_id AS s, event_type AS o FROM events WHERE event_type IN ({_kinds})"


@query("SELECT 'urn:event:' || event_id AS s FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def scan_tx_window(spark, sf_dir):
    start, end = (1_704_844_800_000 + k * DAY for k in (0, 2))
    return scan.scan(store(spark, sf_dir), p=P + "user", options=Options(start=start, end=end)).select("s")


@query("SELECT 'urn:event:' || event_id AS s FROM events, (SELECT max(ts) AS now FROM events) WHERE epoch_ms(now) - epoch_ms(ts) < 86400000")
def scan_ttl_default_now(spark, sf_dir):
    return scan.scan(store(spark, sf_dir), p=P + "user", options=Options(ttl=DAY)).select("s")


@query(
    """SELECT v.tag, 'urn:customer:' || c_custkey AS s FROM customer JOIN (VALUES ('b', 'BUILDING'), ('m', 'MACHINERY'), ('b2', 'BUILDING')) v(tag, o) ON c_mktsegment = v.o
UNION ALL SELECT 'n', 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey = 1"""
)
def scan_bound_batch(spark, sf_dir):
    seg = lambda tag, x: BoundPattern(tag, p=P + "segment", o=ir.literal(x))
    pats = [seg("b", "BUILDING"), seg("m", "MACHINERY"), seg("b2", "BUILDING"), BoundPattern("n", p=P + "inRegion", o=ir.iri("urn:region:1"))]
    return scan.batch_scan(store(spark, sf_dir), pats).select("tag", "s")


@query("SELECT 'urn:customer:' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION SELECT 'urn:customer:' || c_custkey, c_mktsegment FROM customer WHERE c_custkey < 3")
def batch_query_dedup(spark, sf_dir):
    pats = [BoundPattern("", p=P + "segment", o=ir.literal(x)) for x in ("BUILDING", "MACHINERY", "BUILDING")]
    pats += [BoundPattern("", s=f"urn:customer:{k}", p=P + "segment") for k in range(3)]
    return scan.batch_distinct(store(spark, sf_dir), pats).select("s", "o")


@query("SELECT user_id, event_type, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY ALL")
def upsert_last_write(spark, sf_dir):
    e = Star(spark, sf_dir).table("events")
    rows = e.select(F.concat(F.lit("urn:user:"), "user_id").alias("s"), F.lit("urn:p:did").alias("p"), F.col("event_type").alias("o"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), "user_id")
    kept = m.latest(rows, ["s", "p", "o"], [F.col("ts").desc(), F.col("seq").desc()])
    return kept.select("user_id", F.col("o").alias("event_type"), F.col("seq").alias("event_id"))


@query("SELECT 'urn:customer:' || c_custkey AS s, min(p) AS p FROM customer, (VALUES ('urn:p:inNation'), ('urn:p:knows'), ('urn:p:segment')) v(p) GROUP BY ALL")
def first_entry_per_subject(spark, sf_dir):
    df = store(spark, sf_dir).select({P + "segment", P + "inNation", P + "knows"}).where(F.col("s").startswith("urn:customer:"))
    return scan.apply_iterators(df, [(1, "first")]).select("s", "p")


@query("SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5 ")
def star_property_object(spark, sf_dir):
    return scan.star_objects(store(spark, sf_dir), [(P + "segment", ir.literal("BUILDING")), (P + "inNation", "urn:nation:5"), (m.TYPE, C + "Customer")])


@query("SELECT 'urn:order:' || o_orderkey AS s, o_orderpriority AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def star_predicate(spark, sf_dir):
    return scan.star_predicates(store(spark, sf_dir), [P + "priority", P + "placedBy", P + "hasPart"]).select("s", "o")


# graph patterns


@query("SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || n_nationkey AS n, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING'")
def bgp_customer_region(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?c ?n ?region WHERE { ?c p:segment "BUILDING" ; p:inNation ?n . ?n p:inRegion ?r . ?r p:name ?region }')


@query("SELECT 'urn:order:' || o_orderkey AS o, n_name AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderpriority = '1-URGENT'")
def bgp_order_chain(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?o ?nation ?region { ?o p:priority "1-URGENT" ; p:placedBy ?c . ?c p:inNation ?n . ?n p:name ?nation ; p:inRegion ?r . ?r p:name ?region }')


@query(
    """SELECT 'urn:order:' || a.l_orderkey AS o, 'urn:part:' || a.l_partkey AS part, 'urn:supplier:' || b.l_suppkey AS supplier
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b USING (l_orderkey) JOIN part ON p_partkey = a.l_partkey WHERE p_size = 10"""
)
def bgp_part_supplier(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?o ?part ?supplier { ?o p:hasPart ?part ; p:hasSupplier ?supplier . ?part p:size 10 }")


@query("SELECT 'urn:customer:' || c_custkey AS x FROM customer WHERE c_custkey = (c_custkey * c_custkey) % 100")
def bgp_repeated_var(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?x { ?x p:knows ?x }")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def bgp_cross(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?a ?b { ?x a c:Region ; p:name ?a . ?y a c:Region ; p:name ?b }")


@query("SELECT 'urn:supplier:' || s_suppkey AS s, CASE WHEN n_regionkey = 2 THEN n_name END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def optional_segment(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?s ?name { ?s a c:Supplier ; p:inNation ?n OPTIONAL { ?n p:inRegion <urn:region:2> ; p:name ?name } }")


@query(
    """SELECT 'urn:customer:' || c_custkey AS c, o_orderstatus AS status, CASE WHEN c_nationkey < 5 THEN n_name END AS name FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '5-LOW' LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'MACHINERY'"""
)
def optional_group(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?c ?status ?name { ?c p:segment "MACHINERY" OPTIONAL { ?o p:placedBy ?c ; p:priority "5-LOW" ; p:status ?status } OPTIONAL { ?c p:inNation ?n . ?n p:name ?name FILTER(?n = <urn:nation:0> || ?n = <urn:nation:1> || ?n = <urn:nation:2> || ?n = <urn:nation:3> || ?n = <urn:nation:4>) } }')


@query(
    """WITH l AS (SELECT n_nationkey AS n, CASE WHEN n_regionkey = 1 THEN n_regionkey END AS r FROM nation)
SELECT 'urn:nation:' || n AS n, r_name AS name, 'urn:region:' || r_regionkey AS r FROM l JOIN region ON l.r = r_regionkey
UNION ALL SELECT 'urn:nation:' || n, r_name, 'urn:region:' || r_regionkey FROM l CROSS JOIN region WHERE l.r IS NULL"""
)
def optional_then_join_null(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?n ?r ?name { ?n a c:Nation OPTIONAL { ?n p:inRegion ?r FILTER(?r = <urn:region:1>) } ?r a c:Region ; p:name ?name }")


@query("SELECT 'urn:nation:' || n_nationkey AS n FROM nation WHERE n_regionkey <> 1")
def minus_pattern(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?n { ?n a c:Nation MINUS { ?n p:inRegion <urn:region:1> } }")


@query("SELECT 'urn:order:' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def filter_eq(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?o { ?o p:status ?s ; p:priority "2-HIGH" FILTER(?s = "F") }')


@query("SELECT 'urn:part:' || p_partkey AS x, p_size::VARCHAR AS size FROM part WHERE p_size < 5")
def filter_lt_int(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?x ?size { ?x p:size ?size FILTER(?size < 5) }")


@query("SELECT 'urn:part:' || p_partkey AS x FROM part WHERE (p_size >= 45 OR p_size <= 2) AND NOT regexp_matches(p_brand, '1$') AND p_type <> 'ECONOMY'")
def filter_compound(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?x { ?x p:size ?size ; p:brand ?b ; p:kind ?k FILTER((?size >= 45 || ?size <= 2) && !regex(?b, "1$") && ?k != "ECONOMY") }')


@query("SELECT 'urn:customer:' || c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'urn:customer:' || c_custkey FROM customer WHERE c_nationkey < 13 AND c_nationkey = 12")
def union_bag(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?x { { ?x p:segment "BUILDING" } UNION { ?x p:inNation <urn:nation:12> . ?x a c:Customer } }')


@query("SELECT 'urn:customer:' || c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 12")
def union_set(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT DISTINCT ?x { { ?x p:segment "BUILDING" } UNION { ?x p:inNation <urn:nation:12> . ?x a c:Customer } }')


@query("SELECT 'urn:nation:' || n AS n FROM (SELECT c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier)")
def intersect_subjects(spark, sf_dir):
    a = ask(spark, sf_dir, 'SELECT ?n { ?c p:segment "BUILDING" ; p:inNation ?n }')
    return a.intersect(ask(spark, sf_dir, "SELECT ?n { ?s a c:Supplier ; p:inNation ?n }"))


@query("SELECT 'urn:nation:' || n AS n FROM (SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE CAST(s_acctbal AS DECIMAL(18,2)) > 9000)")
def minus_subjects(spark, sf_dir):
    a = ask(spark, sf_dir, "SELECT ?n { ?n a c:Nation }")
    return a.exceptAll(ask(spark, sf_dir, "SELECT DISTINCT ?n { ?s a c:Supplier ; p:inNation ?n ; p:acctbal ?b FILTER(?b > 9000) }"))


@query("SELECT count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def named_graph_join(spark, sf_dir):
    df = ask(spark, sf_dir, "SELECT DISTINCT ?u { GRAPH g:view { ?a p:user ?u } GRAPH g:click { ?b p:user ?u } GRAPH g:purchase { ?c p:user ?u } }")
    return df.agg(F.count("*").alias("n"))


@query("SELECT 'urn:g:' || event_type AS g, count(*) AS n FROM events GROUP BY ALL")
def graph_variable(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?g ?e { GRAPH ?g { ?e p:user ?u } }").groupBy("g").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'ops' WHEN 'purchase' THEN 'fin&ops' WHEN 'signup' THEN 'fin|ops' WHEN 'click' THEN 'mkt' ELSE '' END AS l FROM events)
SELECT 'urn:event:' || a.event_id AS a, 'urn:event:' || b.event_id AS b, CASE WHEN a.l = '' THEN b.l WHEN b.l = '' THEN a.l ELSE '(' || a.l || ')&(' || b.l || ')' END AS label
FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.event_type = 'error' AND b.event_type <> 'view' AND b.event_type <> 'click'"""
)
def join_labels(spark, sf_dir):
    once = ask(spark, sf_dir, 'SELECT ?a ?b { GRAPH g:error { ?a p:user ?u } ?b p:user ?u }', with_labels=True)
    kinds = ask(spark, sf_dir, 'SELECT ?b ?k { ?b p:kind ?k FILTER(?k != "view" && ?k != "click") }').select("b")
    return once.join(kinds.where(F.col("b").startswith("urn:event:")), "b", "left_semi").select("a", "b", F.col("_vis").alias("label"))


@query("SELECT DISTINCT c_mktsegment AS seg, 'urn:nation:' || c_nationkey AS n FROM customer")
def project_distinct(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT DISTINCT ?seg ?n { ?c p:segment ?seg ; p:inNation ?n }")


@query("SELECT 'urn:order:' || o_orderkey AS o, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS price FROM orders ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey::VARCHAR LIMIT 10 OFFSET 5")
def slice_limit_sorted(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?o ?price { ?o p:totalprice ?price } ORDER BY DESC(?price) ?o LIMIT 10 OFFSET 5")


# statistics and rewrites


@query("SELECT 'po' AS kind, 'urn:p:segment' AS a, c_mktsegment AS b, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'po', 'urn:p:inNation', 'urn:nation:' || k, count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL")
def prospects_po(spark, sf_dir):
    df = store(spark, sf_dir).select({P + "segment", P + "inNation"})
    return stats.prospects(df, ["po"]).select("kind", "a", "b", "n")


@query(
    """WITH q AS (SELECT 'urn:customer:' || c_custkey AS s, 'urn:p:segment' AS p, c_mktsegment AS o FROM customer UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:p:brand', p_brand FROM part)
SELECT kind, count(*) AS keys, sum(n)::BIGINT AS n FROM (
SELECT 's' AS kind, count(*) AS n FROM q GROUP BY s UNION ALL SELECT 'p', count(*) FROM q GROUP BY p UNION ALL SELECT 'o', count(*) FROM q GROUP BY o
UNION ALL SELECT 'sp', count(*) FROM q GROUP BY s, p UNION ALL SELECT 'so', count(*) FROM q GROUP BY s, o UNION ALL SELECT 'po', count(*) FROM q GROUP BY p, o) GROUP BY kind"""
)
def prospects_all(spark, sf_dir):
    df = stats.prospects(store(spark, sf_dir).select({P + "segment", P + "brand"}))
    return df.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


@query(ORACLE["bgp_order_chain"])
def join_order_by_statistics(spark, sf_dir):
    s = store(spark, sf_dir)
    node = sparql.parse('SELECT ?o ?nation ?region { ?r p:name ?region . ?n p:name ?nation ; p:inRegion ?r . ?c p:inNation ?n . ?o p:placedBy ?c ; p:priority "1-URGENT" }', PREFIXES)
    table = stats.prospects(s.select({P + x for x in ("name", "inRegion", "inNation", "placedBy", "priority")}), ["p", "po"])
    return lower.evaluate(s, optimize.order_joins(node, stats.Statistics.of(table, node)))


VIEW = "SELECT ?c ?n ?r { ?c <urn:p:inNation> ?n . ?n <urn:p:inRegion> ?r }"


def _view(spark, s, sub: str) -> pcj.Catalog:
    import uuid

    catalog = pcj.Catalog(spark, f"{shared_dir(spark)}/views-{sub}-{uuid.uuid4().hex}")
    catalog.create(VIEW, s, "chain", with_labels=False)
    return catalog


@query("SELECT 'urn:customer:' || c_custkey AS cust, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING'")
def pcj_materialised(spark, sf_dir):
    s = store(spark, sf_dir)
    views = _view(spark, s, "plain").views()
    node = sparql.parse('SELECT ?cust ?region { ?cust p:segment "BUILDING" ; p:inNation ?y . ?y p:inRegion ?z . ?z p:name ?region }', PREFIXES)
    rewritten = optimize.use_views(node, views)
    assert not any(p.p == ir.iri(P + "inNation") for p in ir.patterns(rewritten)), "the view covers this pattern"
    return lower.evaluate(s, rewritten)


@query("SELECT 'urn:customer:' || c_custkey AS cust FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3 UNION ALL SELECT 'urn:supplier:' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 3")
def pcj_join_constants(spark, sf_dir):
    s = store(spark, sf_dir)
    node = sparql.parse("SELECT ?cust { ?cust p:inNation ?n . ?n p:inRegion <urn:region:3> }", PREFIXES)
    return lower.evaluate(s, optimize.use_views(node, _view(spark, s, "const").views()))


@query(
    """SELECT 'urn:customer:' || c_custkey AS c, coalesce(CASE WHEN c_nationkey = 0 THEN 'urn:nation:0' END, 'urn:nation:' || c_nationkey) AS n, 'urn:region:' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'"""
)
def pcj_unassured(spark, sf_dir):
    s = store(spark, sf_dir)
    view = _view(spark, s, "open").view("chain")
    inputs = lower.Lowering(s)(sparql.parse('SELECT ?c ?n { ?c p:segment "BUILDING" OPTIONAL { ?c p:inNation ?n FILTER(?n = <urn:nation:0>) } }', PREFIXES))
    return pcj.index_join(inputs, view, unassured={"n"}).df.select("c", "n", "r")


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
def pcj_cardinality(spark, sf_dir):
    catalog = _view(spark, store(spark, sf_dir), "count")
    return spark.createDataFrame([(catalog.cardinality("chain"),)], "n bigint")


# inference


@query("SELECT 'urn:customer:' || c_custkey AS s, 'urn:region:2' AS type FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def infer_subclass_instances(spark, sf_dir):
    return infer.instances_of(store(spark, sf_dir), "urn:region:2").where(F.col("s").startswith("urn:customer:"))


def _inferred(spark, sf_dir, text_: str) -> DataFrame:
    s = store(spark, sf_dir)
    return lower.evaluate(s, infer.expand(sparql.parse(text_, PREFIXES), s))


@query(
    """SELECT 'urn:customer:' || c_custkey AS x, 'urn:nation:' || c_nationkey AS y FROM customer UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation"""
)
def infer_subproperty(spark, sf_dir):
    return _inferred(spark, sf_dir, "SELECT ?x ?y { ?x p:within ?y }")


@query("SELECT 'urn:customer:' || o_custkey AS c, 'urn:order:' || o_orderkey AS o FROM orders")
def infer_inverse(spark, sf_dir):
    return _inferred(spark, sf_dir, "SELECT ?c ?o { ?c p:hasOrder ?o }")


@query("SELECT 'urn:customer:' || c_custkey AS a, 'urn:customer:' || (c_custkey * c_custkey) % 100 AS b FROM customer UNION ALL SELECT 'urn:customer:' || (c_custkey * c_custkey) % 100, 'urn:customer:' || c_custkey FROM customer")
def infer_symmetric(spark, sf_dir):
    return _inferred(spark, sf_dir, "SELECT ?a ?b { ?a p:knows ?b }")


@query("WITH RECURSIVE r(y) AS (SELECT 100 UNION SELECT y // 2 FROM r WHERE y > 0) SELECT 'urn:part:' || y AS y FROM r WHERE y <> 100")
def infer_transitive_from(spark, sf_dir):
    return _inferred(spark, sf_dir, "SELECT ?y { <urn:part:100> p:partOf ?y }")


@query("WITH RECURSIVE r(x) AS (SELECT p_partkey FROM part WHERE p_partkey > 0 AND p_partkey // 2 = 3 UNION SELECT p_partkey FROM r JOIN part ON p_partkey // 2 = x) SELECT 'urn:part:' || x AS x FROM r")
def infer_transitive_to(spark, sf_dir):
    return _inferred(spark, sf_dir, "SELECT ?x { ?x p:partOf <urn:part:3> }")


@query("WITH RECURSIVE r(x, y) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT r.x, r.y // 2 FROM r WHERE r.y > 0) SELECT 'urn:part:' || x AS x, 'urn:part:' || y AS y FROM r")
def infer_transitive_all(spark, sf_dir):
    s = store(spark, sf_dir)
    df, _ = infer.transitive(s, ir.Pattern(ir.Var("x"), ir.iri(P + "partOf"), ir.Var("y")))
    return df


@query("SELECT 'urn:customer:' || k AS x, least('urn:customer:' || k, 'urn:customer:' || xor(k, 1::BIGINT)) AS root FROM (SELECT c_custkey AS k FROM customer UNION SELECT xor(c_custkey, 1::BIGINT) FROM customer)")
def infer_same_as(spark, sf_dir):
    return infer.same_as_groups(store(spark, sf_dir))


def _reasoned(spark, sf_dir, names: list[str]) -> reason.Result:
    """Reasoning over the statements of some predicates (the schema is always all of it)."""
    return reason.reason(store(spark, sf_dir), predicates={x if ":" in x else P + x for x in names})


def _types(r: reason.Result, kind: str) -> DataFrame:
    return r.inferred().where((F.col("p") == m.TYPE) & (F.col("o") == kind)).select("s")


@query("SELECT 'urn:order:' || o_orderkey AS s, 'urn:c:Order' AS type FROM orders UNION ALL SELECT DISTINCT 'urn:customer:' || o_custkey, 'urn:c:Customer' FROM orders")
def owl_domain_range(spark, sf_dir):
    r = _reasoned(spark, sf_dir, ["placedBy"])
    return r.inferred().where((F.col("p") == m.TYPE) & F.col("o").isin(C + "Order", C + "Customer")).select("s", F.col("o").alias("type"))


@query("SELECT 'urn:order:' || o_orderkey AS s FROM orders WHERE o_orderpriority = '1-URGENT'")
def owl_hasvalue(spark, sf_dir):
    return _types(_reasoned(spark, sf_dir, ["priority"]), C + "Urgent")


@query("SELECT DISTINCT 'urn:supplier:' || l_suppkey AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def owl_avf(spark, sf_dir):
    return _types(_reasoned(spark, sf_dir, ["hasSupplier", "placedBy"]), C + "Vendor")


def _with_rows(spark, sf_dir, names: list[str], rows: DataFrame, schema_rows: list[tuple]) -> reason.Result:
    from quadloom.sources.store import QuadStore

    base = store(spark, sf_dir)
    extra = m.conform(spark.createDataFrame([(*r, m.IRI, "") for r in schema_rows], "s string, p string, o string, o_dt string, o_lang string"))
    schema = reason.schema_of(base.plus(QuadStore.of(extra)))
    facts = base.select({P + x for x in names}).unionByName(m.conform(rows))
    return reason.Reasoner(spark, schema).run(facts)


@query("SELECT 'urn:order:' || o_orderkey AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def owl_svf(spark, sf_dir):
    builders = scan.scan(store(spark, sf_dir), p=P + "segment", o=ir.literal("BUILDING")).select("s", F.lit(m.TYPE).alias("p"), F.lit(C + "Builder").alias("o"), F.lit(m.IRI).alias("o_dt"), F.lit("").alias("o_lang"))
    return _types(_with_rows(spark, sf_dir, ["placedBy"], builders, []), C + "BuildingOrder")


@query("SELECT 'urn:customer:' || c_custkey AS node, 'CaxDw' AS rule FROM customer WHERE c_nationkey = 4")
def owl_disjoint(spark, sf_dir):
    odd = scan.scan(store(spark, sf_dir), p=P + "inNation", o="urn:nation:4").where(F.col("s").startswith("urn:customer:"))
    both = [odd.select("s", F.lit(m.TYPE).alias("p"), F.lit(C + k).alias("o"), F.lit(m.IRI).alias("o_dt"), F.lit("").alias("o_lang")) for k in ("Customer", "Supplier")]
    return _with_rows(spark, sf_dir, [], both[0].unionByName(both[1]), []).conflicts.select("node", "rule")


@query("SELECT 'urn:customer:' || c_custkey AS node, 'PrpIrp' AS rule FROM customer WHERE c_custkey = (c_custkey * c_custkey) % 100")
def owl_irreflexive(spark, sf_dir):
    r = _with_rows(spark, sf_dir, ["knows"], spark.createDataFrame([], m.QUADS), [(P + "knows", m.TYPE, m.OWL + "IrreflexiveProperty")])
    return r.conflicts.where("rule = 'PrpIrp'").select("node", "rule")


@query("WITH RECURSIVE r(x, y) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT r.x, r.y // 2 FROM r WHERE r.y > 0) SELECT 'urn:part:' || x AS s, 'urn:part:' || y AS o FROM r")
def owl_transitive(spark, sf_dir):
    return _reasoned(spark, sf_dir, ["partOf"]).facts.where(F.col("p") == P + "partOf").select("s", "o")


@query("SELECT DISTINCT 'urn:customer:' || x AS s, 'urn:customer:' || y AS o FROM (SELECT c_custkey AS x, (c_custkey * c_custkey) % 100 AS y FROM customer UNION SELECT (c_custkey * c_custkey) % 100, c_custkey FROM customer)")
def owl_symmetric(spark, sf_dir):
    return _reasoned(spark, sf_dir, ["knows"]).facts.where(F.col("p") == P + "knows").select("s", "o")


@query("SELECT 'urn:customer:' || o_custkey AS s, 'urn:order:' || o_orderkey AS o FROM orders")
def owl_inverse(spark, sf_dir):
    return _reasoned(spark, sf_dir, ["placedBy"]).inferred().where(F.col("p") == P + "hasOrder").select("s", "o")


@query("SELECT 'urn:customer:' || c_custkey AS s, 'urn:nation:' || c_nationkey AS o FROM customer UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation")
def owl_subproperty(spark, sf_dir):
    return _reasoned(spark, sf_dir, ["inNation", "inRegion"]).inferred().where(F.col("p") == P + "within").select("s", "o")


@query("SELECT 'urn:customer:' || c_custkey AS s, 'urn:region:' || n_regionkey AS type FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:c:World' FROM customer JOIN nation ON n_nationkey = c_nationkey")
def owl_subclass(spark, sf_dir):
    r = _reasoned(spark, sf_dir, [m.TYPE])
    return r.inferred().where((F.col("p") == m.TYPE) & F.col("s").startswith("urn:customer:")).select("s", F.col("o").alias("type"))


# secondary indexes

_TOKENS = "list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9*_]+'), lambda x: x <> ''))"


def _text_query(words: str):
    def run(spark, sf_dir):
        return text.search(store(spark, sf_dir).select(P + "text"), words).select("s")

    return run


for _name, _words, _cond in (
    ("text_and", "the and", "list_contains(t, 'the') AND list_contains(t, 'and')"),
    ("text_not", "the !and", "list_contains(t, 'the') AND NOT list_contains(t, 'and')"),
    ("text_prefix", "con*", "len(list_filter(t, lambda x: starts_with(x, 'con'))) > 0"),
    ("text_suffix", "*ing !the", "len(list_filter(t, lambda x: ends_with(x, 'ing'))) > 0 AND NOT list_contains(t, 'the')"),
    ("text_contains", "*an* *er", "len(list_filter(t, lambda x: contains(x, 'an'))) > 0 AND len(list_filter(t, lambda x: ends_with(x, 'er'))) > 0"),
):
    QUERIES[_name] = _text_query(_words)
    ORACLE[_name] = f"SELECT 'urn:doc:' || doc_id AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE {_cond}"


@query(f"SELECT 'urn:doc:' || doc_id AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 're'))) > 0 AND NOT list_contains(t, 'of')")
def text_postings_lookup(spark, sf_dir):
    return text.lookup(text.postings(store(spark, sf_dir).select(P + "text")), "the re* !of").select("s")


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_dictionary(spark, sf_dir):
    return text.dictionary(text.postings(store(spark, sf_dir).select(P + "text")))


_XY = "(SELECT s_suppkey, ((s_suppkey * 37) % 360) - 180 AS x, ((s_suppkey * 17) % 180) - 90 AS y FROM supplier)"


def _locations(spark, sf_dir):
    return geo.index(store(spark, sf_dir).select(P + "loc"))


@query(f"SELECT 'urn:supplier:' || s_suppkey AS s FROM {_XY} WHERE x >= -100 AND x < 100 AND y >= -50 AND y < 60")
def geo_within_box(spark, sf_dir):
    return geo.within(_locations(spark, sf_dir), "POLYGON((-100 -50, 100 -50, 100 60, -100 60, -100 -50))").select("s")


@query(f"SELECT 'urn:supplier:' || s_suppkey AS s FROM {_XY} WHERE x >= -150 AND x < 150 AND y >= -80 AND y < 80 AND NOT (x >= -20 AND x < 40 AND y >= -10 AND y < 30)")
def geo_within_hole(spark, sf_dir):
    return geo.within(_locations(spark, sf_dir), "POLYGON((-150 -80, 150 -80, 150 80, -150 80, -150 -80), (-20 -10, 40 -10, 40 30, -20 30, -20 -10))").select("s")


@query(f"SELECT 'urn:supplier:' || s_suppkey AS s FROM {_XY} WHERE x = 5 AND y = -5")
def geo_equals(spark, sf_dir):
    return geo.equals(_locations(spark, sf_dir), "POINT(5.0 -5)").select("s")


_SEP = "chr(0)"


@query(
    """WITH e AS (SELECT event_id, 'urn:event:' || event_id AS s, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS t FROM events)
SELECT s, row_start FROM (SELECT s, unnest(['o|' || t, 's|' || s || '|' || t, 'p|urn:p:at|' || t, 'sp|' || s || '|urn:p:at|' || t]) AS row_start FROM e)"""
)
def temporal_entries(spark, sf_dir):
    df = temporal.entries(store(spark, sf_dir).select(P + "at"))
    s = F.split("statement", values.NUL)[1]
    return df.select(s.alias("s"), F.substring("row", F.lit(1), F.length("row") - F.length("statement") - 1).alias("row_start"))


_VALID = "(SELECT o_orderkey AS k, o_orderdate AS a, greatest(o_orderdate, l) AS b FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query(f"SELECT 'urn:order:' || k AS s, v.q AS kind, CASE WHEN v.q = 'begin' THEN x || '/' || y ELSE y || '/' || x END AS row_start FROM (SELECT k, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS x, strftime(b, '%Y-%m-%dT%H:%M:%SZ') AS y FROM {_VALID}), (VALUES ('begin'), ('end')) v(q)")
def temporal_intervals(spark, sf_dir):
    df = temporal.entries(store(spark, sf_dir).select(P + "validity"))
    return df.select(F.split("statement", values.NUL)[1].alias("s"), F.col("qualifier").alias("kind"), F.substring("row", F.lit(1), F.length("row") - F.length("statement") - 1).alias("row_start"))


@query("SELECT 'urn:event:' || event_id AS s FROM events WHERE date_trunc('second', ts) < TIMESTAMP '2024-01-05 12:00:00'")
def temporal_before(spark, sf_dir):
    return temporal.instants(store(spark, sf_dir).select(P + "at"), "before", "2024-01-05T14:00:00+02:00").select("s")


@query(f"SELECT 'urn:order:' || k AS s FROM {_VALID} WHERE a <= TIMESTAMP '1998-01-01' AND b >= TIMESTAMP '1997-06-01'")
def temporal_overlaps(spark, sf_dir):
    return temporal.intervals(store(spark, sf_dir).select(P + "validity"), "overlaps", "1997-06-01T00:00:00Z", "1998-01-01T00:00:00Z").select("s")


@query(f"SELECT 'urn:order:' || k AS s FROM {_VALID} WHERE a <= TIMESTAMP '1997-06-15 12:00:00' AND b >= TIMESTAMP '1997-06-15 12:00:00'")
def valid_at(spark, sf_dir):
    rows = store(spark, sf_dir).select(P + "validity")
    return temporal.valid_time(rows, rows, at="1997-06-15T12:00:00Z").select("s")


def _with_validity(spark, sf_dir):
    """Order statuses, with validFrom and validTo statements about the orders."""
    s = store(spark, sf_dir)
    dates = s.select(P + "validity").select("s", times.interval(F.col("o")).alias("i"), "g")
    meta = [dates.select("s", F.lit(P + name).alias("p"), F.substring(F.col(f"i.{part}"), 1, 10).alias("o"), F.lit(m.DATE).alias("o_dt"), "g") for name, part in (("validFrom", "begin"), ("validTo", "end"))]
    return s.select(P + "status"), m.conform(meta[0].unionByName(meta[1]))


@query(f"SELECT 'urn:order:' || k AS s, o_orderstatus AS o FROM {_VALID} JOIN orders ON o_orderkey = k WHERE date_trunc('day', a) <= TIMESTAMP '1998-03-31 23:59:59' AND date_trunc('day', b) + INTERVAL 86399 SECOND >= TIMESTAMP '1998-01-01'")
def valid_overlap(spark, sf_dir):
    rows, meta = _with_validity(spark, sf_dir)
    return temporal.valid_time(rows, meta, start="1998-01-01", end="1998-03-31").select("s", "o")


@query(
    """SELECT 'urn:customer:' || c_custkey AS row, 'urn:p:inNation' AS family, 'object' AS role FROM customer UNION ALL SELECT 'urn:nation:' || c_nationkey, 'urn:p:inNation', 'subject' FROM customer
UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:p:inNation', 'object' FROM supplier UNION ALL SELECT 'urn:nation:' || s_nationkey, 'urn:p:inNation', 'subject' FROM supplier"""
)
def entity_rows(spark, sf_dir):
    return entity.rows(store(spark, sf_dir).select(P + "inNation")).select("row", "family", F.split("qualifier", values.NUL)[1].alias("role"))


@query("SELECT 'urn:customer:' || c_custkey AS s, 'urn:p:segment' AS p, c_mktsegment AS o FROM customer UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:p:segment', c_mktsegment FROM customer")
def entity_decode(spark, sf_dir):
    return entity.decode(entity.rows(store(spark, sf_dir).select(P + "segment"))).select("s", "p", "o")


# functions


@query("SELECT md5('urn:customer:' || c_custkey) || chr(0) || 'urn:customer:' || c_custkey || chr(0) || 'urn:p:segment' || chr(0) || c_mktsegment || chr(1) || chr(3) AS spo, c_mktsegment || chr(0) || 'urn:customer:' || c_custkey || chr(0) || 'urn:p:segment' || chr(1) || chr(3) AS osp FROM customer")
def layout_rows_md5(spark, sf_dir):
    return store(spark, sf_dir).select(P + "segment").select(values.layout_row("spo", hashed=True).alias("spo"), values.layout_row("osp").alias("osp"))


@query("SELECT 'urn:customer:' || c_custkey AS s, 'urn:p:segment' AS p, c_mktsegment AS o FROM customer")
def layout_round_trip(spark, sf_dir):
    df = store(spark, sf_dir).select(P + "segment").select(values.layout_row("po", hashed=True).alias("r"))
    return df.select(values.read_layout_row(F.col("r"), "po", hashed=True).alias("q")).select("q.s", "q.p", "q.o")


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.000Z') AS t FROM orders")
def datetime_normalise(spark, sf_dir):
    o = Star(spark, sf_dir).table("orders")
    return o.select("o_orderkey", times.normalise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0004567+05:30"))).alias("t"))


@query(
    """WITH v AS (SELECT c_custkey, 'urn:customer:' || c_custkey || ' ' || c_name AS value FROM customer),
h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(value, ''), lambda x: ord(x)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM v)
SELECT c_custkey, '19700101_' || abs((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 50) AS shard FROM h"""
)
def shard_value(spark, sf_dir):
    c = Star(spark, sf_dir).table("customer")
    return c.select("c_custkey", values.shard(F.lit(0).cast("bigint"), F.concat(F.lit("urn:customer:"), "c_custkey", F.lit(" "), "c_name")).alias("shard"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, (o_orderkey % 50)::VARCHAR AS n FROM orders")
def shard_split(spark, sf_dir):
    cut = values.split_shard(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey") % 50))
    return Star(spark, sf_dir).table("orders").select("o_orderkey", cut.alias("c")).select("o_orderkey", "c.day", "c.n")


@query("SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) AS day, epoch_ms(o_orderdate) + 7 AS at FROM orders")
def date_to_millis(spark, sf_dir):
    day, at = F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0071Z"))
    return Star(spark, sf_dir).table("orders").select("o_orderkey", times.date_millis(day).alias("day"), times.date_millis(at).alias("at"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate) + ((365 + 2 * 31 + 3) * 86400 + 4 * 3600) * 1000::BIGINT AS at FROM orders")
def calendar_offset(spark, sf_dir):
    return Star(spark, sf_dir).table("orders").select("o_orderkey", values.add_calendar(millis("o_orderdate"), years=1, months=2, days=3, hours=4).alias("at"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size * 5 // 2)::VARCHAR || '.0' ELSE (p_size * 2.5)::DECIMAL(18,1)::VARCHAR END AS size FROM part")
def record_convert(spark, sf_dir):
    return Star(spark, sf_dir).table("part").select("p_partkey", records.convert(F.col("p_size").cast("string"), "conversion.size * 2.5").alias("size"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus <> 'F'")
def date_validity(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when(F.col("o_orderstatus") == "F", "1996-06-01T00:00:00.000Z")
    fields = F.create_map(F.lit("date-start"), day, F.lit("date-end"), end, F.lit("version"), F.lit("1"))
    return Star(spark, sf_dir).table("orders").where(records.date_valid(fields, "1997-01-01T00:00:00.000Z")).select("o_orderkey")


@query(
    """WITH q AS (SELECT s_suppkey, radians(((s_suppkey * 37) % 360) - 180) AS a, radians(((s_suppkey * 17) % 180) - 90) AS b, radians(s_suppkey % 360) AS t, 250.0 / 6371.0 AS d FROM supplier),
e AS (SELECT *, asin(sin(b) * cos(d) + cos(b) * sin(d) * cos(t)) AS y FROM q)
SELECT s_suppkey, round(degrees(y), 6) AS lat, round(degrees(x - 2 * pi() * floor((x + pi()) / (2 * pi()))), 6) AS lon
FROM (SELECT *, a + atan2(sin(t) * sin(d) * cos(b), cos(d) - sin(b) * sin(y)) AS x FROM e)"""
)
def great_circle(spark, sf_dir):
    s = Star(spark, sf_dir).table("supplier")
    lon, lat = F.expr("cast((s_suppkey * 37) % 360 - 180 as double)"), F.expr("cast((s_suppkey * 17) % 180 - 90 as double)")
    end = values.end_location(lon, lat, F.lit(250.0), (F.col("s_suppkey") % 360).cast("double"))
    return s.select("s_suppkey", F.round(end["lat"], 6).alias("lat"), F.round(end["lon"], 6).alias("lon"))


@query("SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_custkey::VARCHAR LIKE '%7'")
def scan_row_regex(spark, sf_dir):
    row = values.layout_row("spo")
    return store(spark, sf_dir).select(P + "segment").where(scan.row_regex(row, "urn:customer:[0-9]*7\x00.*\x00(BUILDING|FURNITURE)\x01.")).select("s")


@query(
    """SELECT o_orderkey, lower(lpad(to_hex((o_custkey::HUGEINT + 9223372036854775808)::UBIGINT), 16, '0')) AS long_key,
lower(lpad(to_hex(2147483648::BIGINT - o_custkey), 8, '0')) AS int_key, lower(lpad(to_hex(18446744073709551615::UBIGINT - epoch_ms(o_orderdate)::UBIGINT), 16, '0')) AS date_key,
CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS boolean_key FROM orders"""
)
def keys_upgraded(spark, sf_dir):
    o = Star(spark, sf_dir).table("orders")
    cust = F.col("o_custkey").cast("string")
    key = lambda c, mark, name: values.upgrade_key(c, F.lit(mark)).alias(name)
    return o.select(
        "o_orderkey", key(cust, 4, "long_key"), key((-F.col("o_custkey")).cast("string"), 5, "int_key"), key(millis("o_orderdate").cast("string"), 7, "date_key"), key((F.col("o_orderstatus") == "F").cast("string"), 10, "boolean_key")
    )


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey || '<<~>>xsd:long' AS a, CASE WHEN o_orderstatus = 'F' THEN chr(0) ELSE o_orderpriority || '<<~>>xsd:string' END AS b FROM orders)
SELECT o_orderkey, a || ':::' || b AS ab, b || ':::' || a AS ba FROM o"""
)
def binding_orders(spark, sf_dir):
    o = Star(spark, sf_dir).table("orders")
    b = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    rows = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.lit("xsd:long").alias("a__dt"), b.alias("b"), F.lit("xsd:string").alias("b__dt"))
    return rows.select("o_orderkey", *[values.binding_text(["a", "b"], x).alias(x.replace(";", "")) for x in values.orders(["a", "b"])])


@query(
    """SELECT DISTINCT o_orderpriority AS name, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
array_to_string(list_transform(list_filter(regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS pascal FROM orders"""
)
def names_slug_pascal(spark, sf_dir):
    o = Star(spark, sf_dir).table("orders").select(F.col("o_orderpriority").alias("name")).distinct()
    return o.select("name", values.slug(F.col("name")).alias("slug"), values.pascal(F.col("name")).alias("pascal"))


@query(
    """SELECT '{"subject":"urn:event:' || event_id || '","predicate":"urn:p:user","object":"urn:user:' || user_id || '","objectType":"IRI_TYPE","context":"urn:g:' || event_type || '","visibility":"'
|| CASE event_type WHEN 'error' THEN 'ops' WHEN 'purchase' THEN 'fin&ops' WHEN 'signup' THEN 'fin|ops' WHEN 'click' THEN 'mkt' ELSE '' END || '","timestamp":' || (epoch_us(ts) // 1000) || '}' AS row FROM events""".replace("IRI_TYPE", m.IRI)
)
def result_rows_json(spark, sf_dir):
    return store(spark, sf_dir).select(P + "user").select(values.result_json().alias("row"))


def _fields():
    return F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("lon"), ((F.col("p_partkey") * 37) % 720 - 360).cast("string"), F.lit("lat"), ((F.col("p_partkey") * 17) % 180 - 90).cast("string"))


@query("SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 30 OR p_brand = 'Brand#11') AND lower(p_brand) LIKE 'brand#%2%' AND NOT p_size < 5")
def ogc_filters(spark, sf_dir):
    cond = records.ogc('and(or(between(size,10,30),eq(brand,"Brand#11")),like(brand,"BRAND#*2*"),not(lt(size,5)),is_null(absent))', _fields())
    return Star(spark, sf_dir).table("part").where(cond).select("p_partkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, (p_partkey * 37) % 720 - 360 AS x, (p_partkey * 17) % 180 - 90 AS y FROM part) WHERE (x BETWEEN 100 AND 200 OR x + 360 BETWEEN 100 AND 200 OR x - 360 BETWEEN 100 AND 200) AND y BETWEEN -20 AND 40")
def ogc_bbox(spark, sf_dir):
    return Star(spark, sf_dir).table("part").where(records.ogc("bbox(100,-20,200,40)", _fields())).select("p_partkey")


@query("SELECT event_id FROM events WHERE 1705276800000 - epoch_ms(ts) BETWEEN 0 AND 172800000")
def time_range_filter(spark, sf_dir):
    e = Star(spark, sf_dir).table("events")
    return e.where(records.time_range(millis("ts"), 1_705_276_800_000, 2 * DAY)).select("event_id")


@query("SELECT p_partkey FROM part WHERE abs(p_retailprice - 950.0) <= p_size / 2.0")
def frequency_filter(spark, sf_dir):
    f = F.create_map(F.lit("frequency"), F.col("p_retailprice").cast("string"), F.lit("bandwidth"), F.col("p_size").cast("string"))
    return Star(spark, sf_dir).table("part").where(records.frequency(f, 950.0)).select("p_partkey")


@query("SELECT p_partkey, p_size::VARCHAR AS size, p_brand AS brand FROM part")
def record_parse(spark, sf_dir):
    text_ = F.concat(F.lit("size �"), F.col("p_size").cast("string"), F.lit(" \x00brand�"), F.col("p_brand"), F.lit("�cut\x00junk"))
    df = Star(spark, sf_dir).table("part").select("p_partkey", records.parse_record(text_).alias("r"))
    return df.select("p_partkey", F.col("r.size").alias("size"), F.col("r.brand").alias("brand"))


# stores


def _parent_child(spark, sf_dir):
    """Statements about orders in two stores: those with status O or F in the parent, O or P in the child, the child's with other labels."""
    o = Star(spark, sf_dir).table("orders")
    row = lambda vis: [F.concat(F.lit("urn:order:"), "o_orderkey").alias("s"), F.lit(P + "status").alias("p"), F.col("o_orderstatus").alias("o"), vis.alias("vis"), millis("o_orderdate").alias("ts")]
    parent = o.where("o_orderstatus <> 'P'").select(*row(F.when(F.col("o_orderkey") % 2 == 0, "p").otherwise("")))
    child = o.where("o_orderstatus <> 'F'").select(*row(F.when(F.col("o_orderkey") % 3 == 0, "c").otherwise("")))
    return m.conform(parent), m.conform(child)


_START = 883_612_800_000  # 1998-01-01


@query(
    f"""SELECT 'urn:order:' || o_orderkey AS s,
CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 <> 0 THEN 'kept' ELSE 'relabelled' END WHEN o_orderstatus = 'F' THEN CASE WHEN epoch_ms(o_orderdate) < {_START} THEN 'deleted' ELSE 'kept' END
ELSE CASE WHEN epoch_ms(o_orderdate) >= {_START} THEN 'added' ELSE 'ignored' END END AS action,
CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN '(p)|(c)' WHEN o_orderkey % 3 = 0 THEN 'c' WHEN o_orderkey % 2 = 0 THEN 'p' ELSE '' END
WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE '' END WHEN o_orderkey % 3 = 0 THEN 'c' ELSE '' END AS label FROM orders"""
)
def merge_stores(spark, sf_dir):
    parent, child = _parent_child(spark, sf_dir)
    return merge.merge(parent, child, _START).rows.select("s", "action", F.col("vis").alias("label"))


@query(f"SELECT 'urn:order:' || o_orderkey AS s FROM orders WHERE o_orderstatus <> 'P' AND epoch_ms(o_orderdate) >= {_START}")
def copy_since(spark, sf_dir):
    return merge.copy_since(_parent_child(spark, sf_dir)[0], _START).select("s")


@query("SELECT 'urn:event:' || event_id AS s, g FROM (SELECT event_id, unnest(['urn:g:all', 'urn:g:audit', 'urn:g:' || event_type]) AS g FROM events)")
def context_fanout(spark, sf_dir):
    return merge.fan_out(store(spark, sf_dir).select(P + "user"), ["urn:g:all", "urn:g:audit"]).select("s", "g")


@query("SELECT 'urn:part:' || p_partkey AS s, 'urn:p:size' AS p, p_size::VARCHAR AS o, '' AS g, 'http://www.w3.org/2001/XMLSchema#anyURI' AS s_type, 'http://www.w3.org/2001/XMLSchema#anyURI' AS p_type, 'http://www.w3.org/2001/XMLSchema#integer' AS o_type FROM part")
def pig_tuple(spark, sf_dir):
    return store(spark, sf_dir).select(P + "size").select(*values.pig_tuple())


@query("SELECT count(*) - count(CASE WHEN event_type = 'view' THEN 1 END) AS n FROM events")
def delete_by_pattern(spark, sf_dir):
    stay, _ = scan.delete_matching(store(spark, sf_dir).select(P + "user"), g="urn:g:view")
    return stay.where(F.col("s").startswith("urn:event:")).agg(F.count("*").alias("n"))


@query("SELECT 'urn:customer:' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment <> 'BUILDING'")
def delete_exact(spark, sf_dir):
    rows = store(spark, sf_dir).select(P + "segment")
    return scan.delete_exact(rows, rows.where("o = 'BUILDING'")).select("s", "o")


@query("SELECT 'urn:event:' || event_id AS s, 'urn:g:' || event_type AS g, 'urn:user:' || user_id AS o FROM events")
def rdf_round_trip(spark, sf_dir):
    lines = rdfio.to_lines(store(spark, sf_dir).select(P + "user"))
    return rdfio.parse_lines(lines).where("bad is null").select("s", "g", "o")


@query("SELECT 'urn:doc:' || doc_id AS s, lang, text AS o FROM documents WHERE text NOT LIKE '%' || chr(0) || '%'")
def rdf_round_trip_text(spark, sf_dir):
    lines = rdfio.to_lines(store(spark, sf_dir).select(P + "text"), graphs=False)
    return rdfio.parse_lines(lines, graphs=False).where("bad is null").select("s", F.col("o_lang").alias("lang"), "o")


_LINES = "(SELECT page_id, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line, unnest(string_split(html, chr(10))) AS raw FROM pages)"


@query(
    f"""WITH l AS (SELECT *, lower(raw) AS t FROM {_LINES})
SELECT page_id, line, 'SecretExposureCandidate' AS kind FROM l WHERE regexp_matches(t, 'password|secret|api_key|apikey|token') AND regexp_matches(t, '=|:|const|let|var')
UNION ALL SELECT page_id, line, 'SPARQLInjectionCandidate' FROM l WHERE (contains(t, 'sparql') OR contains(t, 'select ')) AND (contains(t, 'where') OR contains(t, 'query'))
UNION ALL SELECT page_id, line, 'NetworkRequestSurface' FROM l WHERE regexp_matches(t, 'reqwest|fetch\\(|http\\.get|requests\\.get|urlopen')
UNION ALL SELECT page_id, line, 'MemorySafetyReviewSurface' FROM l WHERE regexp_matches(t, 'unsafe|transmute|from_raw')
UNION ALL SELECT page_id, line, 'CommandExecutionSurface' FROM l WHERE regexp_matches(t, 'command::new|std::process|system\\(|exec\\(|popen\\(')
UNION ALL SELECT page_id, line, 'DynamicQueryConstruction' FROM l WHERE (contains(t, 'select ') OR contains(t, 'where ')) AND (contains(raw, 'format!(') OR contains(raw, ' + ') OR contains(raw, '${{'))"""
)
def code_findings(spark, sf_dir):
    pages = Star(spark, sf_dir).table("pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    return codefacts.findings(pages, cap=None).select("page_id", F.col("line").cast("bigint").alias("line"), "kind")


# streams


@query("SELECT 'urn:event:' || a.event_id AS a, 'urn:event:' || b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'error' AND b.event_type = 'signup'")
def stream_pcj_equals_batch(spark, sf_dir):
    """Statements arrive as a stream of two files; the view that is kept current is read at the end."""
    import uuid

    from quadloom.streaming.views import Maintainer

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = store(spark, sf_dir).select({P + "user"})
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("s"), F.lit(2)) == half).coalesce(4).write.mode("append").parquet(f"{base}/in")
    keep = Maintainer(spark, f"{base}/state")
    id_ = keep.register("SELECT ?a ?b { GRAPH <urn:g:error> { ?a <urn:p:user> ?u } GRAPH <urn:g:signup> { ?b <urn:p:user> ?u } }")
    stream = spark.readStream.schema(m.QUADS).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    run = keep.run(stream, f"{base}/checkpoint")
    run.awaitTermination()
    return keep.results(id_).select("a", "b")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windows(spark, sf_dir):
    from quadloom.streaming.views import windowed_counts

    df = windowed_counts(Star(spark, sf_dir).table("events"), "6 hours")
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k"""
)
def events_sessions(spark, sf_dir):
    from quadloom.streaming.views import sessions

    df = sessions(Star(spark, sf_dir).table("events"), "12 hours")
    return df.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")

