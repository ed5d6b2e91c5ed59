"""Pattern scans over a store, with labels, time windows and limited regular expressions."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators import labels
from quadloom.plans.ir import Term
from quadloom.sources.store import QuadStore


@dataclass(frozen=True)
class Options:
    """What a scan lets through.

    ``auths`` None turns label checks off (an engine-side caller); an empty tuple sees public rows only.
    ``start`` is exclusive and ``end`` inclusive; with ``ttl`` a row lives while ``now - ts < ttl``
    and must not lie in the future. ``now`` defaults to the latest visible timestamp.
    """

    limit: int | None = None
    auths: tuple[str, ...] | None = None
    start: int | None = None
    end: int | None = None
    ttl: int | None = None
    now: int | None = None
    s_like: str | None = None
    p_like: str | None = None
    o_like: str | None = None


def expand_classes(pattern: str) -> list[str]:
    """Every literal that a pattern of plain text and ``[abc]`` classes stands for; in a class ``-`` is itself."""
    parts = re.split(r"\[([^\]]*)\]", pattern)
    choices = [list(dict.fromkeys(x)) if i % 2 else [x] for i, x in enumerate(parts)]
    return ["".join(x) for x in itertools.product(*choices)]


def like(c: Column, pattern: str) -> Column:
    """``.*x.*`` contains x; anything else is full equality with one of the expanded literals."""
    if pattern.startswith(".*") and pattern.endswith(".*") and len(pattern) >= 4:
        return reduce(lambda a, b: a | b, [c.contains(x) for x in expand_classes(pattern[2:-2])])
    return c.isin(expand_classes(pattern))


def row_regex(c: Column, pattern: str) -> Column:
    """A regular expression over a whole serialised row."""
    return c.rlike(f"^(?:{pattern})$")


def term_is(df: DataFrame | None, o: Term) -> Column:
    return (F.col("o") == o.lex) & (F.col("o_dt") == o.dt) & (F.coalesce("o_lang", F.lit("")) == o.lang)


def matches(s: str | None = None, p: str | None = None, o: Term | str | None = None, g: str | None = None, qual: str | None = None) -> Column:
    """Equality with what is given; a bound graph or qualifier never matches a row without one."""
    cond = F.lit(True)
    for name, value in (("s", s), ("p", p), ("g", g), ("qual", qual)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    if o is not None:
        cond = cond & term_is(None, Term(o) if isinstance(o, str) else o)
    return cond


def restrict(df: DataFrame, options: Options) -> DataFrame:
    """Labels, regular expressions and time; not the limit."""
    if options.auths is not None:
        df = labels.visible(df, options.auths)
    visible = df
    for name, pattern in (("s", options.s_like), ("p", options.p_like), ("o", options.o_like)):
        if pattern is not None:
            df = df.where(like(F.col(name), pattern))
    if options.start is not None:
        df = df.where(F.col("ts") > options.start)
    if options.end is not None:
        df = df.where(F.col("ts") <= options.end)
    if options.ttl is not None:
        if options.now is not None:
            df = df.where((F.col("ts") <= options.now) & (F.lit(options.now) - F.col("ts") < options.ttl))
        else:
            latest = visible.agg(F.max("ts").alias("_now"))  # one row
            df = df.crossJoin(F.broadcast(latest)).where((F.col("ts") <= F.col("_now")) & (F.col("_now") - F.col("ts") < options.ttl)).drop("_now")
    return df


def scan(store: QuadStore, s: str | None = None, p: str | None = None, o: Term | str | None = None, g: str | None = None, qual: str | None = None, options: Options = Options()) -> DataFrame:
    """Statements that match. The default of ``now`` is taken over the whole store, as far as it is visible."""
    if options.ttl is not None and options.now is None:
        now = store.latest() if options.auths is None else store.latest(lambda df: labels.visible(df, options.auths))
        options = replace(options, now=0 if now is None else now)
    o_lex = o.lex if isinstance(o, Term) else o
    df = store.select(p, o_lex, g, s).where(matches(s, p, o, g, qual))
    df = restrict(df, options)
    return df if options.limit is None else df.limit(options.limit)


@dataclass(frozen=True)
class BoundPattern:
    """A pattern with a payload that tags its rows, and a limit of its own."""

    tag: str
    s: str | None = None
    p: str | None = None
    o: Term | None = None
    g: str | None = None
    limit: int | None = None


def batch_scan(store: QuadStore, patterns: list[BoundPattern], options: Options = Options()) -> DataFrame:
    """Rows of every pattern with its ``tag``; a row that several match is there for each.

    The patterns are a literal table, so their number is the caller's and not the
    data's. Patterns that bind the same positions are one equi-join with it.
    """
    per_limit = [x for x in patterns if x.limit is not None]
    groups: dict[tuple, list[BoundPattern]] = {}
    for x in patterns:
        if x.limit is None:
            groups.setdefault(tuple(v is not None for v in (x.s, x.p, x.o, x.g)), []).append(x)
    out = [scan(store, x.s, x.p, x.o, x.g, options=replace(options, limit=x.limit)).withColumn("tag", F.lit(x.tag)) for x in per_limit]
    spark = store.spark
    for (has_s, has_p, has_o, has_g), some in groups.items():
        rows = [(x.tag, x.s, x.p, x.o and x.o.lex, x.o and x.o.dt, x.o and x.o.lang, x.g) for x in some]
        wanted = F.broadcast(spark.createDataFrame(rows, "tag string, _s string, _p string, _o string, _dt string, _lang string, _g string"))
        df = restrict(store.select({x.p for x in some} if has_p else None), replace(options, limit=None))
        on = [F.col(a) == F.col(b) for a, b, has in (("s", "_s", has_s), ("p", "_p", has_p), ("o", "_o", has_o), ("o_dt", "_dt", has_o), ("o_lang", "_lang", has_o), ("g", "_g", has_g)) if has]
        joined = df.join(wanted, on) if on else df.crossJoin(wanted)
        out.append(joined.select(*m.COLUMNS, "tag"))
    got = reduce(DataFrame.unionByName, out)
    return got if options.limit is None else got.limit(options.limit)


def batch_distinct(store: QuadStore, patterns: list[BoundPattern], options: Options = Options()) -> DataFrame:
    """Statements that any of the patterns matches, each once."""
    once = [replace(x, tag="") for x in patterns]
    return batch_scan(store, list(dict.fromkeys(once)), options).drop("tag").dropDuplicates(m.IDENTITY)


def star_objects(store: QuadStore, pairs: list[tuple[str, Term | str]], options: Options = Options(), hint: str | None = None) -> DataFrame:
    """(s) of the subjects that have all (predicate, object) pairs, each once."""
    out = None
    for p, o in pairs:
        one = scan(store, p=p, o=o, options=replace(options, limit=None)).select("s")
        out = one.distinct() if out is None else out.join(one.hint(hint) if hint else one, "s", "left_semi")
    return out if options.limit is None else out.limit(options.limit)


def star_predicates(store: QuadStore, predicates: list[str], options: Options = Options(), hint: str | None = None) -> DataFrame:
    """Statements of the first predicate whose subject has all the others."""
    out = scan(store, p=predicates[0], options=replace(options, limit=None))
    for p in predicates[1:]:
        one = scan(store, p=p, options=replace(options, limit=None)).select("s")
        out = out.join(one.hint(hint) if hint else one, "s", "left_semi")
    return out if options.limit is None else out.limit(options.limit)


def delete_matching(quads: DataFrame, **pattern) -> tuple[DataFrame, DataFrame]:
    """(what stays, what went) of a delete by pattern."""
    cond = F.coalesce(matches(**pattern), F.lit(False))
    return quads.where(~cond), quads.where(cond)


def delete_exact(quads: DataFrame, gone: DataFrame, with_time: bool = False) -> DataFrame:
    """Without the statements of ``gone``, by identity and, if asked, timestamp."""
    cond = m.identity_equal(quads, gone)
    if with_time:
        cond = cond & (quads["ts"] == gone["ts"])
    return quads.join(gone, cond, "left_anti")


def insert(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Append in order: later rows get higher ``seq``. With ``model.latest`` this is an upsert."""
    top = quads.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    added = m.conform(new).crossJoin(F.broadcast(top)).withColumn("seq", F.col("_top") + F.col("seq") + 1).select(*m.COLUMNS)
    return quads.select(*m.COLUMNS).unionByName(added)


ITERATORS = {"first": m.first_entry, "latest": m.latest}


def apply_iterators(quads: DataFrame, settings: list[tuple[int, str]]) -> DataFrame:
    """Named row transforms in order of priority; an unknown name is an error."""
    for _, name in sorted(settings, key=lambda x: x[0]):
        if name not in ITERATORS:
            raise ValueError(f"no iterator is called {name}")
        quads = ITERATORS[name](quads)
    return quads
