"""Continuous queries over a stream of statements, and windowed counts of events.

A stream's micro-batches are appended to a Parquet table of quads; queries that
are joins alone are kept up to date by the new statements' joins with all (no
old pair is joined again), others are computed anew from the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import model as m
from quadloom.operators import pcj
from quadloom.operators.scan import Options
from quadloom.plans import ir, lower, sparql
from quadloom.sources.store import QuadStore


def delta(node: ir.Project, old: QuadStore, new: QuadStore, with_labels: bool = True) -> DataFrame:
    """New rows of a join of patterns when ``new`` statements join ``old`` ones.

    The i-th term has the i-th pattern on the new statements, earlier patterns
    on all and later ones on the old: each new row comes from exactly one term.
    """
    patterns = list(ir.patterns(node))
    both = old.plus(new)
    run = {id(x): lower.Lowering(x, Options(), with_labels) for x in (old, new, both)}
    names = node.names or sorted({v for p in patterns for v in p.vars()})
    parts = []
    for i in range(len(patterns)):
        # start at the new statements, which are few, and go on along shared variables
        sides = [(p, both if j < i else new if j == i else old) for j, p in enumerate(patterns)]
        todo = [sides.pop(i)]
        bound = set(todo[0][0].vars())
        while sides:
            k = next((k for k, (p, _) in enumerate(sides) if set(p.vars()) & bound), 0)
            todo.append(sides.pop(k))
            bound |= set(todo[-1][0].vars())
        got = [run[id(where)](p) for p, where in todo]
        parts.append(lower.project(reduce(lower.natural_join, got), names).df)
    return reduce(DataFrame.unionByName, parts)


class Maintainer:
    """Statements in ``<path>/quads`` and materialised joins in ``<path>/views``, moved on batch by batch.

    A batch is written under its number, so a batch that is run again after a failure replaces itself;
    which batches a view has seen is written with its rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.catalog = pcj.Catalog(spark, f"{self.path}/views")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def statements(self, before: int | None = None, batch: int | None = None) -> QuadStore:
        if not self._exists(f"{self.path}/quads"):
            return QuadStore(self.spark)
        df = self.spark.read.schema(_with_batch()).parquet(f"{self.path}/quads")
        if before is not None:
            df = df.where(F.col("batch") < before)
        if batch is not None:
            df = df.where(F.col("batch") == batch)
        return QuadStore.of(df.drop("batch"))

    def register(self, text: str, id_: str | None = None) -> str:
        """A query and its rows so far."""
        id_ = self.catalog.create(text, None, id_)
        node = sparql.parse(text)
        b = lower.project(lower.Lowering(self.statements(), Options(), True)(node), self.catalog.metadata(id_).names)
        b.df.withColumn("batch", F.lit(-1).cast("bigint")).write.mode("overwrite").partitionBy("batch").parquet(self._rows(id_))
        return id_

    def _rows(self, id_: str) -> str:
        return f"{self.path}/results/{id_}"

    def results(self, id_: str) -> DataFrame:
        names = self.catalog.metadata(id_).names
        schema = ", ".join(f"{c} string" for v in names for c in lower.triple(v)) + f", {lower.VIS} string, batch bigint"
        return self.spark.read.schema(schema).parquet(self._rows(id_)).drop("batch")

    def apply(self, batch: DataFrame, number: int) -> None:
        """``foreachBatch``: one batch of statements into the table, then every view."""
        m.conform(batch).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/quads")
        new, old = self.statements(batch=number), self.statements(before=number)
        for id_ in self.catalog.list():
            node = sparql.parse(self.catalog.metadata(id_).sparql)
            if pcj._plain(node):
                rows = delta(node, old, new)
                rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self._rows(id_))
            else:
                names = self.catalog.metadata(id_).names
                b = lower.project(lower.Lowering(old.plus(new), Options(), True)(node), names)
                b.df.withColumn("batch", F.lit(-1).cast("bigint")).write.mode("overwrite").partitionBy("batch").parquet(self._rows(id_))

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        writer = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def _with_batch():
    from pyspark.sql import types as T

    return T.StructType([*m.QUADS.fields, T.StructField("batch", T.LongType())])


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, total) of each window; works on a stream, where rows later than ``late`` are dropped, as on a table."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(start, end, key, n): runs of events of one key without a gap as long as ``gap``."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
