"""Copying between stores and merging a child store back into its parent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators import labels

#: A merge compares statements without their labels.
KEY = ["s", "p", "o", "o_dt", "o_lang", "g", "qual"]


def copy_since(parent: DataFrame, start: int, child: DataFrame | None = None) -> DataFrame:
    """The child after taking over what the parent has since ``start`` (inclusive); newer statements replace older ones of one identity."""
    new = parent.where(F.col("ts") >= start)
    if child is None:
        return m.latest(new, order=[F.col("ts").desc(), F.col("seq").desc()])
    both = child.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return m.latest(both, order=[F.col("_new").desc(), F.col("ts").desc(), F.col("seq").desc()]).drop("_new")


@dataclass
class Merged:
    """``rows`` has all statements that either store had, with ``action``: kept, added, relabelled, deleted, ignored."""

    rows: DataFrame

    def parent(self) -> DataFrame:
        return self.rows.where(F.col("action").isin("kept", "added", "relabelled")).drop("action")

    def report(self) -> DataFrame:
        return self.rows.groupBy("action").agg(F.count("*").alias("n"))


def merge(parent: DataFrame, child: DataFrame, start: int) -> Merged:
    """What only the child has comes in if it is not older than ``start``; what only the parent has goes if it is.

    Of statements in both the parent's stays; a different label of the child joins its label. One full outer join.
    """
    order = [F.col("ts").desc(), F.col("seq").desc()]
    a = m.latest(m.conform(parent), KEY, order).alias("a")
    b = m.latest(m.conform(child), KEY, order).alias("b")
    cond = None
    for c in KEY:
        one = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        cond = one if cond is None else cond & one
    joined = a.join(b, cond, "full_outer")
    in_a, in_b = F.col("a.s").isNotNull(), F.col("b.s").isNotNull()
    va, vb = F.coalesce("a.vis", F.lit("")), F.coalesce("b.vis", F.lit(""))
    action = (
        F.when(in_a & in_b, F.when((va != vb) & (vb != ""), "relabelled").otherwise("kept"))
        .when(in_a, F.when(F.col("a.ts") < start, "deleted").otherwise("kept"))
        .otherwise(F.when(F.col("b.ts") >= start, "added").otherwise("ignored"))
    )
    cols = []
    for c in m.COLUMNS:
        if c == "vis":
            cols.append(F.when(in_a & in_b & (va != vb) & (vb != ""), labels.disjunction(F.col("a.vis"), F.col("b.vis"))).when(in_a, F.col("a.vis")).otherwise(F.col("b.vis")).alias(c))
        else:
            cols.append(F.when(in_a, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return Merged(joined.select(*cols, action.alias("action")))


def fan_out(quads: DataFrame, enforced: list[str], keep_own: bool = True) -> DataFrame:
    """Each statement once in every enforced graph, and in its own if that is kept; as it is where no graph is enforced."""
    if not enforced:
        return quads
    wanted = [F.lit(g) for g in enforced]
    graphs = F.array_distinct(F.array_compact(F.array(*wanted, *([F.col("g")] if keep_own else []))))
    return quads.withColumn("g", F.explode(graphs))
