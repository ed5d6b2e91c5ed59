"""The quads table, its vocabulary and the identity of a statement.

A statement is one row. Subjects, predicates and graphs are IRIs and so plain
strings; an object has its lexical form, datatype and language side by side,
which keeps Parquet statistics and pushed filters usable on each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"
IRI, STRING, LANG_STRING = XSD + "anyURI", XSD + "string", RDF + "langString"
INTEGER, DECIMAL, DOUBLE, BOOLEAN = XSD + "integer", XSD + "decimal", XSD + "double", XSD + "boolean"
DATE, DATETIME = XSD + "date", XSD + "dateTime"
WKT = "http://www.opengis.net/ont/geosparql#wktLiteral"

QUADS = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("o_dt", T.StringType()),
        T.StructField("o_lang", T.StringType()),
        T.StructField("g", T.StringType()),
        T.StructField("qual", T.StringType()),
        T.StructField("vis", T.StringType()),
        T.StructField("val", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
COLUMNS = QUADS.fieldNames()
#: What makes two rows the same statement; neither time nor payload does.
IDENTITY = ["s", "p", "o", "o_dt", "o_lang", "g", "qual", "vis"]


def conform(df: DataFrame) -> DataFrame:
    """All quads columns in order; missing ones are null, but an object's datatype is xsd:string and its language ''."""
    have = set(df.columns)
    default = {"o_dt": F.lit(STRING), "o_lang": F.lit(""), "ts": F.lit(0), "seq": F.lit(0)}
    return df.select(*[(F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in QUADS.fields])


def is_iri(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) > 0) & (F.instr(c, ":") > 0)


def value_order(lex: str, dt: str, lang: str) -> list[Column]:
    """Lexical form, then datatype, then language; what is missing comes first."""
    return [F.col(lex).asc_nulls_first(), F.col(dt).asc_nulls_first(), F.col(lang).asc_nulls_first()]


def parts_order(lex: str, dt: str, lang: str) -> list[Column]:
    """The same with what is missing last."""
    return [F.col(lex).asc_nulls_last(), F.col(dt).asc_nulls_last(), F.col(lang).asc_nulls_last()]


def latest(quads: DataFrame, key: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Upsert: of the rows of one identity the one that came last."""
    w = Window.partitionBy(*(key or IDENTITY)).orderBy(*(order or [F.col("seq").desc(), F.col("ts").desc()]))
    return quads.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_entry(quads: DataFrame, pattern_has: str = "s") -> DataFrame:
    """First statement of each row of a layout: rows of subjects, of predicate and object, or of predicates, as the pattern binds."""
    key = {"s": ["s"], "p": ["p"], "o": ["o", "o_dt", "o_lang"], "po": ["p", "o", "o_dt", "o_lang"], "sp": ["s", "p"]}[pattern_has]
    return latest(quads, key, [F.col("seq").asc(), *[F.col(c).asc_nulls_first() for c in ("s", "p", "o", "o_dt", "o_lang", "g", "qual", "vis")]])


def identity_equal(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of identities; a plain hash join, as ``<=>`` is an equi-join key."""
    cond = a["s"].eqNullSafe(b["s"])
    for c in IDENTITY[1:]:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def parse_auths(text: str | None) -> list[str]:
    """Comma-separated authorisations, trimmed, without empty ones."""
    return [a.strip() for a in (text or "").split(",") if a.strip()]
