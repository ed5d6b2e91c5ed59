"""Free-text index: postings of terms by statement, and its query language.

Terms are runs of ``[A-Za-z0-9*_]`` in lower case. A query's words must all
match; ``!x`` excludes, ``x*`` and ``*x`` match beginnings and ends, ``*x*``
anything that contains x. A query with exclusions only starts from all documents.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.functions.values import statement_text
from quadloom.operators import labels


def tokens(text: Column) -> Column:
    """Distinct terms of a text."""
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(ascii_lower, "[^a-z0-9*_]+"), lambda t: t != ""))


def indexable(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Statements with a literal object, of the given predicates if any are given."""
    df = quads.where(F.col("o_dt") != m.IRI)
    return df.where(F.col("p").isin(predicates)) if predicates else df


def postings(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(term, doc, s, p, g, vis): one row for each term of each statement, without a shuffle."""
    df = indexable(quads, predicates)
    return df.select(F.explode(tokens(F.col("o"))).alias("term"), statement_text().alias("doc"), "s", "p", "g", "vis")


def write_postings(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by term, so that a lookup reads the row groups of its terms alone."""
    n = [partitions] if partitions else []
    index.repartitionByRange(*n, "term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def dictionary(index: DataFrame) -> DataFrame:
    """(term, n): in how many statements each term occurs."""
    return index.groupBy("term").agg(F.count("*").alias("n"))


def parse(query: str) -> tuple[list[str], list[str]]:
    """(required, excluded) words."""
    need, out = [], []
    for w in query.split():
        w = w.lower()
        (out if w.startswith("!") else need).append(w.removeprefix("!"))
    return [w for w in need if w], [w for w in out if w]


def word_matches(term: Column, word: str) -> Column:
    core = word.strip("*")
    if word.startswith("*") and word.endswith("*") and len(word) > 1:
        return term.contains(core)
    if word.endswith("*"):
        return term.startswith(word[:-1])
    if word.startswith("*"):
        return term.endswith(word[1:])
    return term == word


def text_matches(text: Column, word: str) -> Column:
    """Whether any term of a text matches a word: found in the text itself, up to the first match, without cutting it into terms."""
    anywhere = word.startswith("*") and word.endswith("*") and len(word) > 1
    core = word.strip("*") if anywhere else word[:-1] if word.endswith("*") else word.removeprefix("*")
    if not re.fullmatch("[a-z0-9*_]*", core):
        return F.when(text.isNotNull(), F.lit(False))  # no term has such a character
    begins, ends = not anywhere and (word.endswith("*") or not word.startswith("*")), not anywhere and not word.endswith("*")
    pattern = ("(?<![a-z0-9*_])" if begins else "") + core.replace("*", r"\*") + ("(?![a-z0-9*_])" if ends else "")
    return text.rlike("(?i)" + (pattern if core else "[a-z0-9*_]"))


def search(quads: DataFrame, query: str, predicates: list[str] | None = None, subject: str | None = None, graph: str | None = None, auths=None) -> DataFrame:
    """Statements that match, straight from their text: one scan without a shuffle, as each statement holds all its terms."""
    need, out = parse(query)
    df = indexable(quads, predicates)
    has = lambda w: text_matches(F.col("o"), w)
    cond = [has(w) for w in need] + [~has(w) for w in out]
    if cond:
        df = df.where(reduce(lambda a, b: a & b, cond))
    return constrain(df, subject, None, graph, auths)


def lookup(index: DataFrame, query: str, subject: str | None = None, graph: str | None = None, auths=None) -> DataFrame:
    """(doc, s, p, g, vis) from postings: only rows of terms that some word matches are read and grouped."""
    need, out = parse(query)
    words = need + out
    keys = ["doc", "s", "p", "g", "vis"]
    index = constrain(index, subject, None, graph, auths)
    if not words:
        return index.select(*keys).distinct()
    any_word = reduce(lambda a, b: a | b, [word_matches(F.col("term"), w) for w in words])
    hits = index.where(any_word).groupBy(*keys).agg(*[F.max(word_matches(F.col("term"), w)).alias(f"_w{i}") for i, w in enumerate(words)])
    if need:
        good = [F.col(f"_w{i}") for i in range(len(need))] + [~F.col(f"_w{i}") for i in range(len(need), len(words))]
        return hits.where(reduce(lambda a, b: a & b, good)).select(*keys)
    return index.select(*keys).distinct().join(hits.select("doc"), "doc", "left_anti").select(*keys)


def constrain(df: DataFrame, subject: str | None = None, predicates: list[str] | None = None, graph: str | None = None, auths=None) -> DataFrame:
    if subject is not None:
        df = df.where(F.col("s") == subject)
    if predicates:
        df = df.where(F.col("p").isin(predicates))
    if graph is not None:
        df = df.where(F.col("g") == graph)
    return df if auths is None else labels.visible(df, auths)
