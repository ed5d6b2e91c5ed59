"""Materialised joins: the result of a query as a Parquet table, kept up to date and used by other queries."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import values
from quadloom.operators import labels
from quadloom.operators.scan import Options
from quadloom.plans import ir, lower, sparql
from quadloom.sources.store import QuadStore


@dataclass
class View:
    """A materialised basic graph pattern: its patterns, the variables that it keeps, and its rows."""

    patterns: list[ir.Pattern]
    names: list[str]
    df: DataFrame

    def rows(self, mapping: dict[str, ir.Slot]) -> ir.Rows:
        """Its rows as a query sees them: variables renamed, constants selected, variables that fall together compared."""
        df, cols, seen = self.df, [], {}
        for v in self.names:
            q = mapping[v]
            c = lower.triple(v)
            if isinstance(q, ir.Term):
                df = df.where((F.col(c[0]) == q.lex) & (F.col(c[1]) == q.dt) & (F.col(c[2]) == q.lang))
            elif q.name in seen:
                for a, b in zip(lower.triple(seen[q.name]), c):
                    df = df.where(F.col(a) == F.col(b))
            else:
                seen[q.name] = v
                cols += [F.col(a).alias(b) for a, b in zip(c, lower.triple(q.name))]
        if lower.VIS in df.columns:
            cols.append(F.col(lower.VIS))
        return ir.Rows(df.select(*cols), list(seen))


def index_join(inputs: lower.Bindings, view: View, renames: dict[str, str] | None = None, constants: dict[str, ir.Term] | None = None, unassured: set[str] = frozenset(), keep: list[str] | None = None, auths=None) -> lower.Bindings:
    """Bindings joined with a view's rows, each result once.

    ``renames`` maps query variables to the view's. ``unassured`` ones are not compared: the input's value stays
    where it has one, else the view's is taken. ``constants`` restrict the view's rows.
    """
    renames = renames or {}
    back = {t: q for q, t in renames.items()}
    df = view.df if auths is None or lower.VIS not in view.df.columns else labels.visible(view.df, auths, lower.VIS)
    for name, term in (constants or {}).items():
        c = lower.triple(renames.get(name, name))
        df = df.where((F.col(c[0]) == term.lex) & (F.col(c[1]) == term.dt) & (F.col(c[2]) == term.lang))
    names = [back.get(v, v) for v in view.names]
    right = lower.bindings_of(df.select(*[F.col(a).alias(b) for v, q in zip(view.names, names) for a, b in zip(lower.triple(v), lower.triple(q))]), names)
    loose = [v for v in names if v in unassured and v in inputs.names]
    if loose:  # joined on the others; then the input's value, else the view's
        renamed = right.df.select(*[F.col(c).alias(c if v not in loose else f"u_{c}") for v in names for c in lower.triple(v)])
        tight = [v for v in names if v not in loose]
        hidden = [f"u_{v}" for v in loose]
        joined = lower.natural_join(inputs, lower.Bindings(renamed, set(tight + hidden), set()))
        cols = []
        for v in sorted(set(inputs.names) | set(tight)):
            cols += [F.coalesce(F.col(c), F.when(F.col(v).isNull(), F.col(f"u_{c}"))).alias(c) if v in loose else F.col(c) for c in lower.triple(v)]
        out = lower.Bindings(joined.df.select(*cols), joined.sure - set(hidden) | set(loose), joined.maybe - set(loose))
    else:
        out = lower.natural_join(inputs, right)
    if keep is not None:
        out = lower.project(out, sorted(set(inputs.names) | set(keep)))
    return lower.Bindings(out.df.distinct(), out.sure, out.maybe)


@dataclass
class Metadata:
    id: str
    sparql: str
    names: list[str]
    orders: list[str]
    cardinality: int = 0


class Catalog:
    """Materialised joins in one folder: ``<id>/rows``, ``<id>/log`` (an append log of counts) and ``<id>.json``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _save(self, meta: Metadata) -> None:
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/{meta.id}.json"), True)
        out.write(bytearray(json.dumps(asdict(meta)).encode()))
        out.close()

    @staticmethod
    def normal(text: str) -> str:
        return " ".join(t for _, t in sparql.tokens(text))

    def list(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(path(self.path)) if s.getPath().getName().endswith(".json"))

    def metadata(self, id_: str) -> Metadata:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/{id_}.json"))
        try:
            return Metadata(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def find(self, text: str) -> str | None:
        """The id of a materialised query, whatever the white space of its text."""
        wanted = self.normal(text)
        return next((i for i in self.list() if self.normal(self.metadata(i).sparql) == wanted), None)

    def create(self, text: str, store: QuadStore | None = None, id_: str | None = None, with_labels: bool = True) -> str:
        """Registers a query and, given a store, fills its table. Nothing happens where the id is there already."""
        id_ = id_ or uuid.uuid4().hex
        if id_ in self.list():
            return id_
        node = sparql.parse(text)
        names = ir.projection(node) or sorted({v for p in ir.patterns(node) for v in p.vars()})
        self._save(Metadata(id_, text, names, values.orders(names)))
        if store is not None:
            self.refresh(id_, store, with_labels)
        return id_

    def refresh(self, id_: str, store: QuadStore, with_labels: bool = True) -> None:
        """Computes the table anew, sorted by its first variable's order, and swaps it in."""
        meta = self.metadata(id_)
        b = lower.Lowering(store, Options(), with_labels)(sparql.parse(meta.sparql))
        self.replace(id_, lower.project(b, meta.names).df)

    def replace(self, id_: str, rows: DataFrame) -> None:
        meta = self.metadata(id_)
        fresh = f"{self.path}/{id_}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(fresh)
        n = self.spark.read.parquet(fresh).count()
        fs, path = self._fs()
        old = path(f"{self.path}/{id_}/rows")
        fs.delete(old, True)
        fs.rename(path(fresh), old)
        meta.cardinality = 0
        self._save(meta)
        fs.delete(path(f"{self.path}/{id_}/log"), True)
        self._log(id_, n)

    def append(self, id_: str, rows: DataFrame) -> None:
        """More rows; the count grows by all of them, repeated ones included."""
        part = f"{self.path}/{id_}/new-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        new = self.spark.read.parquet(part)
        new.write.mode("append").parquet(f"{self.path}/{id_}/rows")
        self._log(id_, new.count())
        fs, path = self._fs()
        fs.delete(path(part), True)

    def _log(self, id_: str, n: int) -> None:
        self.spark.createDataFrame([(n,)], "n bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/{id_}/log")

    def cardinality(self, id_: str) -> int:
        fs, path = self._fs()
        log = f"{self.path}/{id_}/log"
        return int(self.spark.read.parquet(log).agg(F.sum("n")).first()[0] or 0) if fs.exists(path(log)) else 0

    def rows(self, id_: str, auths=None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{id_}/rows")
        return labels.visible(df, auths, lower.VIS) if auths is not None and lower.VIS in df.columns else df

    def ordered(self, id_: str, order: str, auths=None) -> DataFrame:
        """Results as texts in one of the variable orders."""
        return self.rows(id_, auths).select(values.binding_text(self.metadata(id_).names, order).alias("row"))

    def view(self, id_: str) -> View:
        meta = self.metadata(id_)
        return View(list(ir.patterns(sparql.parse(meta.sparql))), meta.names, self.rows(id_))

    def views(self) -> list[View]:
        """Those that are plain joins and filled: what other queries can be answered from."""
        fs, path = self._fs()
        return [self.view(i) for i in self.list() if _plain(sparql.parse(self.metadata(i).sparql)) and fs.exists(path(f"{self.path}/{i}/rows"))]

    def purge(self, id_: str) -> None:
        rows = self.rows(id_)
        self.replace(id_, self.spark.createDataFrame([], rows.schema))

    def drop(self, id_: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/{id_}"), True)
        fs.delete(path(f"{self.path}/{id_}.json"), False)


def _plain(node: ir.Node) -> bool:
    """A join of patterns under a projection that keeps repeated rows: only that can stand for its patterns."""
    if isinstance(node, ir.Project) and not node.distinct:
        return _plain(node.arg)
    if isinstance(node, ir.Join):
        return _plain(node.left) and _plain(node.right)
    return isinstance(node, ir.Pattern)


def report(store: QuadStore, node: ir.Node) -> DataFrame:
    """(node, n): how many rows each part of a query gives; one job for all of them."""
    run, out = lower.Lowering(store), []

    def walk(n: ir.Node, name: str) -> None:
        out.append(run(n).df.agg(F.count("*").alias("n")).select(F.lit(f"{name} {type(n).__name__}").alias("node"), "n"))
        for i, c in enumerate(n.children()):
            walk(c, f"{name}.{i}")

    walk(node, "0")
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df


def explain(node: ir.Node, depth: int = 0) -> str:
    """The algebra as indented text."""
    pad = "  " * depth
    head = {ir.Pattern: lambda: f"Pattern {_slot(node.s)} {_slot(node.p)} {_slot(node.o)}" + (f" in {_slot(node.g)}" if node.g else ""), ir.Project: lambda: f"Project {node.names} distinct={node.distinct}", ir.Filter: lambda: f"Filter {node.condition}", ir.Slice: lambda: f"Slice {node.limit} {node.offset}"}
    lines = [pad + head.get(type(node), lambda: type(node).__name__)()]
    return "\n".join(lines + [explain(c, depth + 1) for c in node.children()])


def _slot(x: ir.Slot) -> str:
    return "*" if x is None else f"?{x.name}" if isinstance(x, ir.Var) else x.lex
