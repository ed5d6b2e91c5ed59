"""Fixpoints over edges. Every round is a written table, so plans stay short and a lost executor costs one round's tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.scratch import Rounds

#: Rounds after which a fixpoint is taken to be an error.
MOST_ROUNDS = 10_000


def closure(edges: DataFrame) -> DataFrame:
    """(x, y) for every pair joined by a path of one edge or more.

    A round joins the pairs found last with all pairs: path lengths double, so
    a chain of n edges takes log2(n) rounds, and old pairs are never joined with each other again.
    """
    keep = Rounds(edges.sparkSession)
    total = keep.write(edges.select("x", "y").where("x is not null and y is not null").distinct())
    new = total
    for _ in range(MOST_ROUNDS):
        step = new.select("x", F.col("y").alias("_via")).join(total.select(F.col("x").alias("_via"), "y"), "_via").select("x", "y").distinct()
        found = keep.write(step.join(total, ["x", "y"], "left_anti"))
        if found.isEmpty():
            return total
        grown = keep.write(total.unionByName(found))
        keep.drop(total, new)
        total, new = grown, found
    raise RuntimeError("the closure did not end")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(x) of all that is reached from ``start`` (x) over one edge or more; the start itself only where it is on a cycle."""
    keep = Rounds(edges.sparkSession)
    edges = edges.select("x", "y")
    step = lambda front: front.join(edges, "x").select(F.col("y").alias("x")).distinct()
    seen = front = keep.write(step(start.select("x")))
    for _ in range(MOST_ROUNDS):
        found = keep.write(step(front).join(seen, "x", "left_anti"))
        if found.isEmpty():
            return seen
        grown = keep.write(seen.unionByName(found))
        if front is not seen:
            keep.drop(front)
        keep.drop(seen)
        seen, front = grown, found
    raise RuntimeError("the search did not end")


def groups(edges: DataFrame) -> DataFrame:
    """(x, root): connected groups of an undirected graph, named by their least member.

    Large-star and small-star steps in turn: O(log² n) rounds whatever the shape,
    and no vertex ever gathers its whole group in one row.
    """
    keep = Rounds(edges.sparkSession)
    now = keep.write(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u is not null and v is not null").distinct())
    state = None
    alone = keep.write(now.where("u = v").select(F.col("u").alias("x")))
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = keep.write(pairs.select("e.u", "e.v").where("u <> v").distinct())
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        keep.drop(now)
        now = new
        if mark == state:
            break
        state = mark
    roots = now.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("root"))
    tops = roots.select(F.col("root").alias("x"), "root").distinct()
    found = roots.unionByName(tops)
    return found.unionByName(alone.join(found, "x", "left_anti").select("x", F.col("x").alias("root")))
