"""The star schema and its companions as quads.

Every predicate is a projection of one table, built only when a scan can touch
it, so nothing is materialised and each pattern prunes columns of one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.sources.store import Part, QuadStore, Template

P, C, G = "urn:p:", "urn:c:", "urn:g:"
#: Visibility of events by type.
EVENT_LABELS = {"error": "ops", "purchase": "fin&ops", "signup": "fin|ops", "click": "mkt"}

ONTOLOGY = [
    (P + "inNation", m.RDFS + "subPropertyOf", P + "within"),
    (P + "inRegion", m.RDFS + "subPropertyOf", P + "within"),
    (P + "placedBy", m.OWL + "inverseOf", P + "hasOrder"),
    (P + "knows", m.TYPE, m.OWL + "SymmetricProperty"),
    (P + "partOf", m.TYPE, m.OWL + "TransitiveProperty"),
    (P + "placedBy", m.RDFS + "domain", C + "Order"),
    (P + "placedBy", m.RDFS + "range", C + "Customer"),
    (C + "Urgent", m.OWL + "onProperty", P + "priority"),
    (C + "Urgent", m.OWL + "hasValue", "1-URGENT"),
    (C + "BuildingOrder", m.OWL + "onProperty", P + "placedBy"),
    (C + "BuildingOrder", m.OWL + "someValuesFrom", C + "Builder"),
    (C + "Order", m.OWL + "onProperty", P + "hasSupplier"),
    (C + "Order", m.OWL + "allValuesFrom", C + "Vendor"),
    (C + "Customer", m.OWL + "disjointWith", C + "Supplier"),
]


def millis(c: Column | str) -> Column:
    """Epoch milliseconds of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(c) if isinstance(c, str) else c)


class Iri(str):
    """SQL of an IRI, and the template that it follows."""

    template: Template


def _iri(kind: str, *keys: str) -> Iri:
    out = Iri(f"concat('urn:{kind}'" + "".join(f", ':', cast({k} as string)" for k in keys) + ")")
    out.template = Template(f"urn:{kind}", keys)
    return out


def _millis(c: str) -> str:
    return f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {c})"


_TEXT_MS, _TEXT_S = "yyyy-MM-dd\\'T\\'HH:mm:ss.SSS\\'Z\\'", "yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\\'"


class Star:
    """Lazily read tables of a folder, as a store."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._tables = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def edges(self, other: str) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", other).distinct()

    def valid_orders(self) -> DataFrame:
        last = self.table("lineitem").groupBy(F.col("l_orderkey").alias("_k")).agg(F.max("l_shipdate").alias("_last"))
        return self.table("orders").join(last, F.col("_k") == F.col("o_orderkey"))

    def store(self) -> QuadStore:
        """All of it. A predicate's DataFrame is a plan over one table that is opened when a scan needs it; expressions are SQL."""
        out: list[Part] = []

        def add(table, s: str, p: str, o: str, dt: str = m.STRING, lang: str = "''", g: str = "null", vis: str = "null", ts: str = "0", fixed_o: str | None = None, where: str = "true") -> None:
            def build(condition: str = "true") -> DataFrame:
                df = self.table(table) if isinstance(table, str) else table()
                return df.where(where).where(condition).selectExpr(
                    f"{s} as s", f"'{p}' as p", f"cast({o} as string) as o", f"'{dt}' as o_dt", f"{lang} as o_lang", f"cast({g} as string) as g", "cast(null as string) as qual",
                    f"cast({vis} as string) as vis", "cast(null as binary) as val", f"cast({ts} as bigint) as ts", "cast(0 as bigint) as seq",
                )

            # the rows of valid_orders are some of those of orders
            clock = (table if isinstance(table, str) else "orders", vis, ts) if ts != "0" else None
            constant = 0 if ts == "0" else None
            out.append(Part(build, p, None if g != "null" else False, fixed_o, getattr(s, "template", None), getattr(o, "template", None), constant, clock))

        def typed(table: str, s: str, cls: str, ts: str = "0") -> None:
            add(table, s, m.TYPE, f"'{C + cls}'", m.IRI, ts=ts, fixed_o=C + cls)

        region, nation = _iri("region", "r_regionkey"), _iri("nation", "n_nationkey")
        typed("region", region, "Region")
        add("region", region, P + "name", "r_name")
        add("region", region, m.RDFS + "subClassOf", f"'{C}World'", m.IRI, fixed_o=C + "World")
        typed("nation", nation, "Nation")
        add("nation", nation, P + "name", "n_name")
        add("nation", nation, P + "inRegion", _iri("region", "n_regionkey"), m.IRI)
        add("nation", nation, m.RDFS + "subClassOf", _iri("region", "n_regionkey"), m.IRI)

        c = _iri("customer", "c_custkey")
        typed("customer", c, "Customer")
        add("customer", c, P + "name", "c_name")
        add("customer", c, P + "inNation", _iri("nation", "c_nationkey"), m.IRI)
        add("customer", c, P + "segment", "c_mktsegment")
        add("customer", c, P + "acctbal", "cast(c_acctbal as decimal(18,2))", m.DECIMAL)
        add("customer", c, m.TYPE, _iri("nation", "c_nationkey"), m.IRI)
        add("customer", c, P + "knows", _iri("customer", "(c_custkey * c_custkey) % 100"), m.IRI)
        add("customer", c, m.OWL + "sameAs", _iri("customer", "c_custkey ^ 1"), m.IRI)

        s = _iri("supplier", "s_suppkey")
        typed("supplier", s, "Supplier")
        add("supplier", s, P + "name", "s_name")
        add("supplier", s, P + "inNation", _iri("nation", "s_nationkey"), m.IRI)
        add("supplier", s, P + "acctbal", "cast(s_acctbal as decimal(18,2))", m.DECIMAL)
        add("supplier", s, P + "loc", "concat('POINT(', (s_suppkey * 37) % 360 - 180, ' ', (s_suppkey * 17) % 180 - 90, ')')", m.WKT)

        p = _iri("part", "p_partkey")
        typed("part", p, "Part")
        add("part", p, P + "brand", "p_brand")
        add("part", p, P + "kind", "p_type")
        add("part", p, P + "size", "p_size", m.INTEGER)
        add("part", p, P + "partOf", _iri("part", "p_partkey div 2"), m.IRI, where="p_partkey > 0")

        o, ts = _iri("order", "o_orderkey"), _millis("o_orderdate")
        typed("orders", o, "Order", ts)
        add("orders", o, P + "placedBy", _iri("customer", "o_custkey"), m.IRI, ts=ts)
        add("orders", o, P + "status", "o_orderstatus", ts=ts)
        add("orders", o, P + "priority", "o_orderpriority", ts=ts)
        add("orders", o, P + "totalprice", "cast(o_totalprice as decimal(18,2))", m.DECIMAL, ts=ts)
        add("orders", o, P + "orderDate", f"date_format(o_orderdate, '{_TEXT_MS}')", m.DATETIME, ts=ts)
        line = _iri("order", "l_orderkey")
        add(lambda: self.edges("l_partkey"), line, P + "hasPart", _iri("part", "l_partkey"), m.IRI)
        add(lambda: self.edges("l_suppkey"), line, P + "hasSupplier", _iri("supplier", "l_suppkey"), m.IRI)
        valid = f"concat('[', date_format(o_orderdate, '{_TEXT_S}'), ',', date_format(greatest(o_orderdate, _last), '{_TEXT_S}'), ']')"
        add(self.valid_orders, o, P + "validity", valid, P + "interval", ts=ts)

        e, g = _iri("event", "event_id"), f"concat('{G}', event_type)"
        vis = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_LABELS.items()) + " else '' end"
        for pred, value, dt in (("user", _iri("user", "user_id"), m.IRI), ("kind", "event_type", m.STRING), ("value", "value", m.DOUBLE), ("at", f"date_format(ts, '{_TEXT_MS}')", m.DATETIME)):
            add("events", e, P + pred, value, dt, g=g, vis=vis, ts=_millis("ts"))

        d = _iri("doc", "doc_id")
        add("documents", d, P + "text", "text", m.LANG_STRING, lang="lang")
        add("documents", d, P + "source", "source")

        turn = _iri("turn", "conv_id", "turn")
        add("conversations", turn, P + "role", "role")
        add("conversations", turn, P + "replyTo", _iri("turn", "conv_id", "turn - 1"), m.IRI, where="turn > 0")

        for pred in sorted({b for _, b, _ in ONTOLOGY}):
            rows = [(a, b, v, m.IRI if ":" in v else m.STRING, "") for a, b, v in ONTOLOGY if b == pred]
            out.append(Part(lambda *_, rows=rows: m.conform(self.spark.createDataFrame(rows, "s string, p string, o string, o_dt string, o_lang string")), pred, False, ts=0))
        return QuadStore(self.spark, out)


def store(spark: SparkSession, sf_dir: str) -> QuadStore:
    return Star(spark, sf_dir).store()

