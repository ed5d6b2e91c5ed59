"""Temporal index entries, queries over them, and valid time of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import times
from quadloom.functions.values import NUL, local_name, write_object


def entries(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(row, family, qualifier, statement): two rows of an interval (``begin/end`` and ``end/begin``), four of an instant."""
    df = quads.where(F.col("p").isin(predicates)) if predicates else quads
    # statements are made distinct before their entries, which are several times as many and as wide; the shuffle goes
    # first, as its partitions bound what a task holds, where small rows that were joined before it don't
    df = df.where(F.col("o").rlike(r"^[\[0-9]")).select("s", "p", "o", F.coalesce("g", F.lit("")).alias("family"), write_object(F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("_object"))
    df = df.repartition("s", "_object").distinct()
    df = df.select("s", "p", "family", F.concat_ws(NUL, "family", "s", "p", "_object").alias("statement"), times.interval(F.col("o")).alias("i"), times.rfc_key(F.col("o")).alias("t"))
    entry = lambda row, kind: F.struct(row.alias("row"), F.lit(kind).alias("qualifier"))
    t, bar = F.col("t"), F.lit("|")
    both = F.array(entry(F.concat_ws("/", "i.begin", "i.end"), "begin"), entry(F.concat_ws("/", "i.end", "i.begin"), "end"))
    four = F.array(
        entry(F.concat(F.lit("o|"), t), "instant"), entry(F.concat(F.lit("s|"), F.col("s"), bar, t), "instant"), entry(F.concat(F.lit("p|"), F.col("p"), bar, t), "instant"), entry(F.concat(F.lit("sp|"), F.col("s"), bar, F.col("p"), bar, t), "instant")
    )
    rows = F.when(F.col("i").isNotNull(), both).when(t.isNotNull(), four)
    return df.select(F.explode(rows).alias("e"), "family", "statement").select(F.concat_ws("|", "e.row", "statement").alias("row"), "family", "e.qualifier", "statement")


def _key(text: str) -> str:
    """The key of a literal instant, computed as rows' are."""
    got = times.normalise_text(text)
    if got is None:
        raise ValueError(f"no instant: {text}")
    return got[:19] + "Z"


def instants(quads: DataFrame, relation: str, a: str, b: str | None = None) -> DataFrame:
    """Statements whose object is an instant ``before``, ``after``, ``at``, or ``between`` (both ends included)."""
    key = times.rfc_key(F.col("o"))
    cond = {"before": lambda: key < _key(a), "after": lambda: key > _key(a), "at": lambda: key == _key(a), "between": lambda: key.between(_key(a), _key(b))}[relation]()
    return quads.where(cond)


def intervals(quads: DataFrame, relation: str, a: str, b: str | None = None) -> DataFrame:
    """Statements whose object is an interval that lies ``before`` a, ``after`` a, ``contains`` a, is ``inside`` [a, b] or ``overlaps`` it."""
    i = times.interval(F.col("o"))
    cond = {
        "before": lambda: i["end"] < _key(a),
        "after": lambda: i["begin"] > _key(a),
        "contains": lambda: (i["begin"] <= _key(a)) & (i["end"] >= _key(a)),
        "inside": lambda: (i["begin"] >= _key(a)) & (i["end"] <= _key(b)),
        "overlaps": lambda: (i["begin"] <= _key(b)) & (i["end"] >= _key(a)),
    }[relation]()
    return quads.where(cond)


def valid_kind(p: Column) -> Column:
    """validat, validfrom or validto by a predicate's local name, whatever its case; null for others."""
    name = F.lower(local_name(p))
    return F.when(name.isin("validat", "validfrom", "validto"), name)


def valid_time(rows: DataFrame, store_rows: DataFrame, at: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows that hold at an instant, or at some time within [start, end].

    A row's time is its object's, an interval or an instant; where it has none, that which
    validAt, or validFrom and validTo, say about its subject in its graph. Those are aggregated
    once (the greatest of several) and joined, not looked up row by row.
    """
    if at is None and start is None and end is None:
        return rows
    bound = lambda x, late: None if x is None else _key(x if len(x) > 10 else x + ("T23:59:59Z" if late else "T00:00:00Z"))
    kind = valid_kind(F.col("p"))
    meta = store_rows.where(kind.isNotNull()).select(F.col("s").alias("_s"), F.col("g").alias("_g"), kind.alias("_k"), times.marker(F.col("o")).alias("_from"), times.marker(F.col("o"), True).alias("_to"))
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    meta = meta.groupBy("_s", "_g").agg(pick("validat", "_from").alias("_at"), pick("validfrom", "_from").alias("_a"), pick("validto", "_to").alias("_b"))
    own, instant = F.col("_own"), F.col("_instant")
    timed = rows.withColumn("_own", times.interval(F.col("o"))).withColumn("_instant", times.marker(F.col("o")))
    joined = timed.join(meta, (F.col("s") == F.col("_s")) & F.col("g").eqNullSafe(F.col("_g")), "left")
    has_own = own.isNotNull() | instant.isNotNull()
    begin = F.when(has_own, F.coalesce(own["begin"], instant)).otherwise(F.coalesce("_at", "_a"))
    until = F.when(has_own, F.coalesce(own["end"], instant)).otherwise(F.when(F.col("_at").isNotNull(), F.col("_at")).otherwise(F.col("_b")))
    known = has_own | F.coalesce("_at", "_a", "_b").isNotNull()
    if at is not None:
        start = end = at
        late = False
    else:
        late = True
    low, high = bound(start, False), bound(end, late)
    cond = known
    if low is not None:
        cond = cond & (until.isNull() | (until >= low))
    if high is not None:
        cond = cond & (begin.isNull() | (begin <= high))
    return joined.where(cond).select(*rows.columns)
