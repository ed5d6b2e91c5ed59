"""A quad store as vertical partitions: DataFrames by predicate.

A scan with a bound predicate touches the partitions that can have it and no
other, so a pattern over a mapped star schema reads one table with the columns
it needs. A store loaded from RDF is one partition of any predicate, where
Parquet statistics and partition pruning do the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import COLUMNS, QUADS, conform


@dataclass(frozen=True)
class Template:
    """IRIs ``urn:<kind>:<key>:...`` made of whole-number keys; ``keys`` are SQL expressions over the table behind a part."""

    prefix: str
    keys: tuple[str, ...]

    def condition(self, iri: str) -> str | None:
        """What the keys have to be for this IRI; None where they can't make it."""
        if not iri.startswith(self.prefix + ":"):
            return None
        given = iri[len(self.prefix) + 1 :].split(":")
        if len(given) != len(self.keys) or not all(re.fullmatch(r"0|-?[1-9]\d{0,17}", x) for x in given):
            return None
        return " and ".join(f"({k}) = {x}" for k, x in zip(self.keys, given))


@dataclass
class Part:
    """Rows of quads, built when a scan first touches them.

    ``p``, ``g`` and ``o`` are given where all rows share them (``g`` is False where no row has one).
    ``s_template`` and ``o_template`` say how subject and object are made: ``build`` then takes a condition on
    their keys, which reaches the scan as a filter on columns. ``ts`` is given where all rows have that one, and
    parts of equal ``clock`` have the same times and labels.
    """

    build: Callable[..., DataFrame]
    p: str | None = None
    g: str | bool | None = None
    o: str | None = None
    s_template: Template | None = None
    o_template: Template | None = None
    ts: int | None = None
    clock: object = None

    @cached_property
    def df(self) -> DataFrame:
        return self.build()

    def rows(self, s: str | None, o: str | None) -> DataFrame | None:
        """The rows that can have this subject and object, perhaps with others; None where there can't be any."""
        found = []
        for template, value in ((self.s_template, s), (self.o_template, o)):
            if template is not None and value is not None:
                condition = template.condition(value)
                if condition is None:
                    return None
                found.append(condition)
        return self.build(" and ".join(found)) if found else self.df


@dataclass
class QuadStore:
    spark: SparkSession
    parts: list[Part] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame) -> QuadStore:
        return cls(df.sparkSession, [Part(lambda: conform(df))])

    def select(self, p: str | Iterable[str] | None = None, o: str | None = None, g: str | bool | None = None, s: str | None = None) -> DataFrame:
        """All partitions that can have these constants; the caller still filters rows."""
        wanted = None if p is None else {p} if isinstance(p, str) else set(p)
        got = [
            x.rows(s, o)
            for x in self.parts
            if (wanted is None or x.p is None or x.p in wanted) and (o is None or x.o is None or x.o == o) and not (g and x.g is False) and not (isinstance(g, str) and isinstance(x.g, str) and x.g != g)
        ]
        got = [x for x in got if x is not None]
        if not got:
            return self.spark.createDataFrame([], QUADS)
        return reduce(DataFrame.unionByName, got)

    def latest(self, visible: Callable[[DataFrame], DataFrame] = lambda df: df) -> int | None:
        """The greatest ts of all visible rows; parts of one time are read only where that could be it, and equal clocks once."""
        varying = {(k if x.clock is None else ("clock", x.clock)): x for k, x in enumerate(self.parts) if x.ts is None}
        greatest = lambda parts: visible(reduce(DataFrame.unionByName, [x.df for x in parts]).select(*COLUMNS)).agg(F.max("ts")).first()[0] if parts else None
        found = greatest(list(varying.values()))
        rest = greatest([x for x in self.parts if x.ts is not None and (found is None or x.ts > found)])
        return rest if found is None else found if rest is None else max(found, rest)

    @property
    def quads(self) -> DataFrame:
        return self.select()

    def plus(self, *more: QuadStore) -> QuadStore:
        return QuadStore(self.spark, [*self.parts, *(x for m in more for x in m.parts)])

    def map(self, fn) -> QuadStore:
        """The same partitions with each one's rows changed (filters, say); what all rows share has to stay true."""
        return QuadStore(self.spark, [Part(lambda *c, x=x: fn(x.build(*c)), x.p, x.g, x.o, x.s_template, x.o_template) for x in self.parts])


LAYOUTS = {"spo": ["s", "p", "o"], "po": ["p", "o", "s"], "osp": ["o", "s", "p"]}


def write_layout(quads: DataFrame, path: str, layout: str = "po", partitions: int | None = None) -> None:
    """A sorted copy: range-partitioned by the layout's key and sorted by it, so that row groups have narrow statistics.

    ``po`` is written in folders by predicate, so that a bound predicate prunes folders.
    """
    key = LAYOUTS[layout]
    n = [partitions] if partitions else []
    out = quads.repartitionByRange(*n, *key).sortWithinPartitions(*key)
    if layout == "po":
        out.withColumn("p_key", F.col("p")).write.mode("overwrite").partitionBy("p_key").parquet(path)
    else:
        out.write.mode("overwrite").parquet(path)


def read_layout(spark: SparkSession, path: str) -> QuadStore:
    df = spark.read.parquet(path)
    if "p_key" in df.columns:
        df = df.withColumn("p", F.col("p_key").cast("string")).drop("p_key")
    return QuadStore(spark, [Part(lambda: df.select(*COLUMNS))])


def choose_layout(s: bool, p: bool, o: bool) -> str:
    """The layout whose key begins with what a pattern binds; all statements in subject order where it binds nothing."""
    if s and o and not p:
        return "osp"
    if s:
        return "spo"
    if p:
        return "po"
    return "osp" if o else "spo"
