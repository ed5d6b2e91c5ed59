"""RDF text readers and writers: N-Triples, N-Quads and TriG to quads and back.

N-Triples and N-Quads are split anywhere between lines and parsed by JVM
expressions. TriG has blocks and prefixes, so a file is read whole, by Arrow batches of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.plans import sparql

_SUBJECT = r"(?:<([^<>\s]*)>|(_:[A-Za-z0-9_.-]+))"
_LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?'
_LINE = rf"^\s*{_SUBJECT}\s*<([^<>\s]*)>\s*(?:{_SUBJECT}|{_LITERAL})\s*(?:{_SUBJECT})?\s*\.\s*(?:#.*)?$"


def _unescape(c: Column) -> Column:
    """``\\n`` and the like, and ``\\uXXXX``; texts without a backslash are left alone."""

    @F.pandas_udf("string")
    def slow(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sparql.unescape(t))

    has = F.instr(c, "\\") > 0
    return F.when(has, slow(F.when(has, c))).otherwise(c)


def parse_lines(lines: DataFrame, graphs: bool = True, c: str = "value") -> DataFrame:
    """(s, p, o, o_dt, o_lang, g, bad) of lines; ``bad`` has a line that can't be read, comments and blank lines are dropped."""
    line = F.col(c)
    df = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.nullif(F.regexp_extract(line, _LINE, k), F.lit(""))
    ok = line.rlike(_LINE)
    node = F.coalesce(part(4), part(5))
    text = _unescape(F.regexp_extract(line, _LINE, 6))
    dt = F.when(node.isNotNull(), F.lit(m.IRI)).when(part(7).isNotNull(), F.lit(m.LANG_STRING)).otherwise(F.coalesce(part(8), F.lit(m.STRING)))
    g = F.coalesce(part(9), part(10))
    if not graphs:
        ok = ok & g.isNull()
    keep = lambda x: F.when(ok, x)
    return df.select(
        keep(F.coalesce(part(1), part(2))).alias("s"), keep(part(3)).alias("p"), keep(F.coalesce(node, text)).alias("o"), keep(dt).alias("o_dt"), keep(F.coalesce(part(7), F.lit(""))).alias("o_lang"), keep(g).alias("g"), F.when(~ok, line).alias("bad")
    )


def read(spark: SparkSession, path: str, kind: str, strict: bool = True) -> DataFrame:
    """Quads of N-Triples (``nt``), N-Quads (``nq``) or TriG (``trig``) files; ``strict`` fails on what can't be read, else it is left out."""
    if kind == "trig":
        return _read_trig(spark, path)
    if kind not in ("nt", "nq"):
        raise ValueError(f"no reader for {kind}")
    rows = parse_lines(spark.read.text(path), kind == "nq")
    if strict:
        rows = rows.withColumn("s", F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("can't read: "), F.col("bad")))).otherwise(F.col("s")))
    else:
        rows = rows.where("bad is null")
    return m.conform(rows.drop("bad"))


def parse_trig(text: str) -> list[tuple]:
    """(s, p, o, o_dt, o_lang, g) of a document: prefixes, default and named blocks, ``;`` and ``,`` lists."""
    text = re.sub(r"@prefix\s+([\w-]*:)\s*(<[^<>]*>)\s*\.", r"PREFIX \1 \2 ", text)
    text = re.sub(r"(?m)PREFIX\s+:\s*<", "PREFIX default: <", text) if re.search(r"PREFIX\s+:\s*<", text) else text
    p = sparql.Parser(text)
    rows: list[tuple] = []

    def triples(g: str | None) -> None:
        for x in p.triples(None):
            rows.append((x.s.lex, x.p.lex, x.o.lex, x.o.dt, x.o.lang, g))

    def block(g: str | None) -> None:
        while not p.sign("}"):
            if p.peek()[0] == "end":
                raise sparql.SyntaxProblem("} expected at the end")
            triples(g)
            p.sign(".")

    while p.peek()[0] != "end":
        p.prologue()
        if p.peek()[0] == "end":
            break
        if p.sign("{"):
            block(None)
        else:
            p.word("GRAPH")
            at = p.i
            name = p.term()
            if p.sign("{"):
                block(name.lex)
            else:
                p.i = at
                triples(None)
        p.sign(".")
    return rows


def _read_trig(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                yield pd.DataFrame(parse_trig(text), columns=["s", "p", "o", "o_dt", "o_lang", "g"])

    return m.conform(files.mapInPandas(run, "s string, p string, o string, o_dt string, o_lang string, g string"))


def to_lines(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """(value): N-Quads or N-Triples lines."""
    iri = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    o = F.when(F.col("o_dt") == m.IRI, iri(F.col("o"))).when(F.col("o_lang") != "", F.concat(quoted, F.lit("@"), F.col("o_lang"))).when(F.col("o_dt") == m.STRING, quoted).otherwise(F.concat(quoted, F.lit("^^<"), F.col("o_dt"), F.lit(">")))
    parts = [iri(F.col("s")), iri(F.col("p")), o] + ([iri(F.col("g"))] if graphs else [])
    return quads.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, kind: str = "nq") -> None:
    to_lines(quads, kind == "nq").write.mode("overwrite").text(path)


def with_defaults(quads: DataFrame, vis: str | None = None, g: str | None = None) -> DataFrame:
    """A load's default label and graph where a statement has none."""
    out = quads
    if vis is not None:
        out = out.withColumn("vis", F.coalesce(F.nullif(F.col("vis"), F.lit("")), F.lit(vis)))
    if g is not None:
        out = out.withColumn("g", F.coalesce("g", F.lit(g)))
    return out


def load(quads: DataFrame, path: str, layouts: tuple[str, ...] = ("spo", "po", "osp"), text: bool = False, geo: bool = False, temporal: bool = False, entity: bool = False, partitions: int | None = None) -> None:
    """Writes a store's sorted copies and the secondary indexes that are asked for, each from one pass over the quads."""
    from quadloom.operators import entity as ent
    from quadloom.operators import geo as geometry
    from quadloom.operators import temporal as times
    from quadloom.operators import text as words
    from quadloom.sources.store import write_layout

    for layout in layouts:
        write_layout(quads, f"{path}/{layout}", layout, partitions)
    if text:
        words.write_postings(words.postings(quads), f"{path}/text", partitions)
    if geo:
        geometry.index(quads).write.mode("overwrite").parquet(f"{path}/geo")
    if temporal:
        times.entries(quads).write.mode("overwrite").parquet(f"{path}/temporal")
    if entity:
        rows = ent.rows(quads)
        n = [partitions] if partitions else []
        rows.repartitionByRange(*n, "row").sortWithinPartitions("row").write.mode("overwrite").parquet(f"{path}/entity")


def mutations(quads: DataFrame, prefix: str = "") -> DataFrame:
    """(table, row, family, qualifier, vis, ts): each statement's row in every layout."""
    from quadloom.functions.values import layout_row

    rows = F.array(*[F.struct(F.lit(f"{prefix}{k}").alias("table"), layout_row(k).alias("row")) for k in ("spo", "po", "osp")])
    return quads.select(F.explode(rows).alias("e"), F.coalesce("g", F.lit("")).alias("family"), F.coalesce("qual", F.lit("")).alias("qualifier"), F.coalesce("vis", F.lit("")).alias("vis"), "ts").select("e.table", "e.row", "family", "qualifier", "vis", "ts")
