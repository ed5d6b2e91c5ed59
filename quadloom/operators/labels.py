"""Cell-level visibility labels.

Grammar: terms joined by ``&`` (binds closer) and ``|``, with parentheses. No
label or an empty one is public. A malformed label, or an empty term, hides
its row. Without authorisations only public rows are visible.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct labels up to which they are judged on the driver and sent as a literal list.
FEW_LABELS = 10_000


def allowed(label: str | None, auths: Iterable[str]) -> bool:
    """Whether a holder of ``auths`` sees what carries the label."""
    if label is None or label == "":
        return True
    have = set(auths)
    at, n = 0, len(label)

    def either() -> bool:
        nonlocal at
        got = both()
        while at < n and label[at] == "|":
            at += 1
            other = both()
            got = got or other
        return got

    def both() -> bool:
        nonlocal at
        got = one()
        while at < n and label[at] == "&":
            at += 1
            other = one()
            got = got and other
        return got

    def one() -> bool:
        nonlocal at
        while at < n and label[at] == " ":
            at += 1
        if at < n and label[at] == "(":
            at += 1
            got = either()
            if at >= n or label[at] != ")":
                raise ValueError(label)
            at += 1
        else:
            start = at
            while at < n and label[at] not in "&|()":
                at += 1
            term = label[start:at].strip()
            if not term:
                raise ValueError(label)
            got = term in have
        while at < n and label[at] == " ":
            at += 1
        return got

    try:
        got = either()
    except ValueError:
        return False
    return got and at == n


def visible(df: DataFrame, auths: Iterable[str], vis: str = "vis") -> DataFrame:
    """Rows that a holder of ``auths`` sees.

    Labels that have neither ``|`` with ``&`` nested in parentheses are judged by
    array functions inside codegen; others are judged once for each distinct
    label by an Arrow UDF, which Spark runs only on the rows that need it.
    """
    auths = sorted(set(auths))
    public = F.col(vis).isNull() | (F.col(vis) == "")
    if not auths:
        return df.where(public)
    return df.where(public | label_condition(F.col(vis), auths))


def label_condition(vis: Column, auths: list[str]) -> Column:
    held = F.array(*[F.lit(a) for a in auths])
    flat = ~vis.rlike("[()]")
    terms = lambda d: F.transform(F.split(d, "&"), lambda t: F.trim(t))
    well_formed = F.forall(F.split(vis, "[|&]"), lambda t: F.trim(t) != "")
    flat_ok = well_formed & F.exists(F.split(vis, "[|]"), lambda d: F.forall(terms(d), lambda t: F.array_contains(held, t)))

    @F.pandas_udf("boolean")
    def nested(labels: pd.Series) -> pd.Series:
        known = {x: allowed(x, auths) for x in labels.unique() if x is not None}
        return pd.Series([x is not None and known[x] for x in labels], dtype=bool)

    # a Python UDF is evaluated for all rows that reach it, so flat labels go in as null
    return F.when(flat, flat_ok).otherwise(nested(F.when(~flat, vis)))


def visible_few(df: DataFrame, auths: Iterable[str], vis: str = "vis") -> DataFrame:
    """As ``visible``, by judging the distinct labels first: a semi-join with those allowed, broadcast while they are few."""
    auths = sorted(set(auths))
    labels = df.select(F.col(vis).alias("_label")).where("_label is not null and _label <> ''").distinct()
    some = labels.limit(FEW_LABELS + 1).collect()
    if len(some) > FEW_LABELS:
        return visible(df, auths, vis)
    good = [r[0] for r in some if allowed(r[0], auths)]
    public = F.col(vis).isNull() | (F.col(vis) == "")
    return df.where(public | F.col(vis).isin(good)) if good else df.where(public)


def conjunction(a: Column, b: Column) -> Column:
    """Label of what is derived from two rows: both must be seen."""
    none = lambda c: c.isNull() | (c == "")
    return F.when(none(a), F.coalesce(b, F.lit(""))).when(none(b), a).otherwise(F.concat(F.lit("("), a, F.lit(")&("), b, F.lit(")")))


def disjunction(a: Column, b: Column) -> Column:
    """Label of what two stores both have: either label is enough; of a public and a labelled one the label stays."""
    none = lambda c: c.isNull() | (c == "")
    return F.when(none(a) & none(b), F.lit("")).when(none(a), b).when(none(b), a).when(a == b, a).otherwise(F.concat(F.lit("("), a, F.lit(")|("), b, F.lit(")")))
