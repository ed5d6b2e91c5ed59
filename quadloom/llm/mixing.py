"""Time-varying curriculum: training positions from weight schedules.

Each source has a weight schedule over training time 0..1, given at knots and
linear between them; at each knot the weights of the sources that exist are
scaled to sum 1. With a budget of N tokens a source's cumulative demand at t is
N times the integral of its weight, piecewise quadratic. The documents of a
source, in a fixed shuffled order, stand at their cumulative token count, and
inverting the demand gives the training time at which each one begins; the
documents are range-sorted by it.

The budget is the largest for which no source runs out (or a given number).
A document whose count lies beyond its source's demand is not scheduled;
``order_documents`` leaves it out or, with ``rest``, puts it after those that are.

Cumulative counts are two-level: sums by (source, bucket of the shuffled
order) are small and get a running total, and each bucket adds its own running
sum, so a source that holds most of the corpus still spreads over ``BUCKETS``
tasks.

Defined results: a null source is a source of its own, named by null; a null
or empty text has no token, so it stands where the next document stands and
never takes part in a budget; a source without any token has no share, so it
binds no budget; a source of weight 0 throughout or without any token is not
scheduled; equal documents are ordered by id, repeated rows stand side by
side; null ids come first in the order. No documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share at the start, middle and end of training. Sources without an entry share DEFAULT.
KNOTS = [0.0, 0.5, 1.0]
SCHEDULE = {"src0": [4.0, 2.0, 1.0], "src1": [1.0, 1.5, 3.0], "src2": [1.0, 1.0, 2.0], "src3": [0.5, 1.0, 1.5]}
DEFAULT = [1.0, 1.0, 1.0]
#: Buckets of the shuffled order within each source; a power of 16.
BUCKETS = 4096
#: Stands for a null source in keys.
NULL = "\0null"


def token_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0)).cast("bigint")


def schedule_pieces(supply: DataFrame, knots: list[float], schedule: dict[str, list[float]], default: list[float], budget: int | None) -> DataFrame:
    """(_source, _pieces, _total): for each source its demand by piece of time, in tokens, and its demand at 1.

    ``supply`` has a row for each source: _source, _supply.
    """
    known = F.create_map(*[x for name, w in schedule.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in w]))]) if schedule else None
    weight = F.array(*[F.lit(float(v)) for v in default])
    if known is not None:
        weight = F.coalesce(F.try_element_at(known, F.col("_source")), weight)
    weight = F.when(F.col("_supply") > 0, weight).otherwise(F.array(*[F.lit(0.0) for _ in default]))
    everyone = Window.partitionBy()
    s = supply.select("_source", "_supply", weight.alias("_raw"))
    for k in range(len(knots)):
        total = F.sum(F.col("_raw")[k]).over(everyone)
        s = s.withColumn(f"_w{k}", F.when(total > 0, F.col("_raw")[k] / total).otherwise(0.0))
    area = None
    for k in range(len(knots) - 1):
        piece = F.lit(knots[k + 1] - knots[k]) * (F.col(f"_w{k}") + F.col(f"_w{k + 1}")) / 2
        area = piece if area is None else area + piece
    s = s.withColumn("_area", area)
    if budget is None:
        n = F.min(F.when(F.col("_area") > 0, F.col("_supply") / F.col("_area"))).over(everyone)
    else:
        n = F.lit(float(budget))
    s = s.withColumn("_n", F.coalesce(n, F.lit(0.0)))
    return s.select("_source", "_n", (F.col("_n") * F.col("_area")).alias("_total"), *[f"_w{k}" for k in range(len(knots))])


def invert(count: Column, knots: list[float]) -> Column:
    """Time at which a source's demand reaches ``count``; null beyond its whole demand.

    On the piece from t0, with weights w0 to w1 over length d, the demand is
    N (w0 x + (w1 - w0) x² / 2d); x is its positive root, in the form that
    loses no digits where w1 = w0.
    """
    out, before = F.lit(None).cast("double"), F.lit(0.0)
    for k in range(len(knots) - 1):
        d, w0, w1 = knots[k + 1] - knots[k], F.col(f"_w{k}"), F.col(f"_w{k + 1}")
        whole = F.col("_n") * F.lit(d) * (w0 + w1) / 2
        rest = (count - before) / F.col("_n")
        root = F.sqrt(F.greatest(w0 * w0 + F.lit(2.0) * (w1 - w0) / F.lit(d) * rest, F.lit(0.0)))
        x = F.when(w0 + root > 0, F.lit(2.0) * rest / (w0 + root)).otherwise(0.0)
        here = (count >= before) & (count < before + whole)
        out = F.coalesce(out, F.when(here & (F.col("_n") > 0), F.lit(knots[k]) + F.least(x, F.lit(d))))
        before = before + whole
    return out


def positions(
    docs: DataFrame,
    knots: list[float] = KNOTS,
    schedule: dict[str, list[float]] = SCHEDULE,
    default: list[float] = DEFAULT,
    budget: int | None = None,
    carried: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(_id, _source, _tokens, _before, _time, carried columns in a struct _row) of every document; _time is null for those not scheduled.

    Two scans: a narrow one for the sums, whose result has sources * BUCKETS rows
    at most whatever the corpus, and one whose rows are shuffled by (source,
    bucket) once.
    """
    if any(b <= a for a, b in zip(knots, knots[1:])) or knots[0] != 0 or knots[-1] != 1 or len(knots) < 2:
        raise ValueError("knots must rise from 0 to 1")
    if any(len(w) != len(knots) or min(w) < 0 for w in [*schedule.values(), default]):
        raise ValueError("every schedule needs a weight of at least 0 for each knot")
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("string")
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NULL)).alias("_source"), token_count(F.col(text_col)).alias("_tokens"), order.alias("_order"), row.alias("_row")
    ).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    sums = base.groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("_in_bucket"))
    pieces = schedule_pieces(sums.groupBy("_source").agg(F.sum("_in_bucket").alias("_supply")), knots, schedule, default, budget)
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_in_bucket").over(upto), F.lit(0))).drop("_in_bucket").join(pieces, "_source")
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", F.col("_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_before", F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
    # the window has put the rows where the join needs them: only the small side moves
    joined = placed.join(starts, ["_source", "_bucket"]).withColumn("_before", F.col("_before") + F.col("_start")).withColumn("_source", F.nullif("_source", F.lit(NULL)))
    return joined.withColumn("_time", invert(F.col("_before").cast("double"), knots))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """(id, source, tokens, tokens_before, position) of every document, range-sorted by position, unscheduled ones last.

    ``position`` is the training token at which the document begins, time * N; null where it isn't scheduled.
    """
    p = positions(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    out = p.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_tokens").alias("tokens"), F.col("_before").alias("tokens_before"), F.round(F.col("_time") * F.col("_n"), 3).alias("position")
    )
    return out.orderBy(F.col("position").asc_nulls_last(), id_col)


def order_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rest: bool = False, **how) -> DataFrame:
    """The scheduled documents with their own columns only, range-sorted by training position.

    With ``rest`` all others follow, in the shuffled order whatever their source.
    """
    p = positions(docs, carried=docs.columns, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    late = F.when(F.col("_time").isNull(), F.col("_order"))
    wanted = (p if rest else p.where("_time is not null")).select("_time", late.alias("_late"), "_row")
    return wanted.orderBy(F.col("_time").asc_nulls_last(), "_late", F.col(f"_row.`{id_col}`")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """The same with running sums over whole sources."""
    last = len(KNOTS) - 1
    cases = " ".join(f"WHEN source = '{s}' THEN [{', '.join(map(str, w))}]" for s, w in SCHEDULE.items())
    weights = ", ".join(f"raw[{k + 1}] / sum(raw[{k + 1}]) OVER () AS w{k}" for k in range(last + 1))
    area = " + ".join(f"{KNOTS[k + 1] - KNOTS[k]} * (w{k} + w{k + 1}) / 2" for k in range(last))
    before, times = "0.0", ""
    for k in range(last):
        d = KNOTS[k + 1] - KNOTS[k]
        whole = f"(n * {d} * (w{k} + w{k + 1}) / 2)"
        rest = f"((c - {before}) / n)"
        root = f"sqrt(greatest(w{k} * w{k} + 2.0 * (w{k + 1} - w{k}) / {d} * {rest}, 0.0))"
        times += f" WHEN c >= {before} AND c < {before} + {whole} THEN {KNOTS[k]} + least(2.0 * {rest} / (w{k} + {root}), {d})"
        before = f"({before} + {whole})"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens) AS supply, CASE {cases} ELSE [{', '.join(map(str, DEFAULT))}] END AS raw FROM d GROUP BY source),
w AS (SELECT source, supply, {weights} FROM s),
a AS (SELECT *, {area} AS area FROM w),
n AS (SELECT *, min(CASE WHEN area > 0 THEN supply / area END) OVER () AS n FROM a),
p AS (SELECT doc_id, d.source, tokens,
        coalesce(sum(tokens) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before, n.* EXCLUDE (source)
      FROM d JOIN n ON n.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, tokens_before::DOUBLE AS c FROM p)
SELECT doc_id, source, tokens, tokens_before, round((CASE{times} END) * n, 3) AS position FROM q ORDER BY position NULLS LAST, doc_id
"""
