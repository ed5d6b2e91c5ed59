"""Weighted URL vocabulary on an Aho-Corasick automaton.

One pass of the automaton over a batch of lower-cased URLs finds all terms of
the vocabulary at once. A hit counts where no letter, digit or mark of any script adjoins it. A
URL is rejected for one strict term, or for ``MIN_SOFT`` distinct soft ones.

Defined results: a null or empty URL has no hit and stays; repeated rows are
judged each; a term that occurs twice counts once; a term that is part of a
longer one counts too where it is bounded; further columns pass through
``keep``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import numbered

STRICT = ("spam-farm", "adult-x", "xxx", "porn", "casino", "escort", "warez", "viagra")
SOFT = {"free": 0.5, "bets": 1.0, "bet": 1.0, "adult": 1.0, "poker": 1.0, "slots": 1.0, "spam": 1.0, "farm": 0.5, "download": 0.5, "crack": 1.0, "pills": 1.0, "loan": 0.5, "dating": 0.5, "winner": 0.5}
MIN_SOFT = 2


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        if term != term.lower() or not term or "\n" in term:
            raise ValueError(f"not a term: {term!r}")
        a.add_word(term, (i, len(term)))
    a.make_automaton()
    return a


@lru_cache(maxsize=4096)
def _inner(character: str) -> bool:
    """A letter, digit or mark of any script, beside which no term ends."""
    return unicodedata.category(character)[0] in "LNM"


def hits(urls: list[str | None], terms: tuple[str, ...]) -> np.ndarray:
    """Which term (column) occurs with boundaries in which URL (row)."""
    found = np.zeros((len(urls), len(terms)), bool)
    if not urls or not terms:
        return found
    low = [(u or "").lower().replace("\n", " ") for u in urls]
    text = "\n" + "\n".join(low) + "\n"
    at = [(end, *term) for end, term in automaton(terms).iter(text)]
    if not at:
        return found
    end, which, length = np.array(at, np.int64).T
    good = np.array([not (_inner(text[e + 1]) or _inner(text[e - n])) for e, n in zip(end.tolist(), length.tolist())])
    starts = np.cumsum([0, *(len(u) + 1 for u in low[:-1])]) + 1
    found[np.searchsorted(starts, end[good], side="right") - 1, which[good]] = True
    return found


def _judge(strict: tuple[str, ...], soft: dict[str, float], min_soft: int):
    terms, n = (*strict, *soft), len(strict)
    weights = np.array(list(soft.values()), float)

    def judge(urls: list[str | None]):
        found = hits(urls, terms)
        n_strict, n_soft = found[:, :n].sum(axis=1), found[:, n:].sum(axis=1)
        return n_strict, n_soft, found[:, n:] @ weights, (n_strict > 0) | (n_soft >= min_soft)

    return judge


def score(pages: DataFrame, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, strict_terms, soft_terms, soft_weight, rejected) of every row, without a shuffle."""
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    kinds = [(id_col, source.schema["_id"].dataType), (url_col, T.StringType()), ("strict_terms", T.LongType()), ("soft_terms", T.LongType()), ("soft_weight", T.DoubleType()), ("rejected", T.BooleanType())]
    schema, judge = T.StructType([T.StructField(*k) for k in kinds]), _judge(tuple(strict), dict(soft), min_soft)

    def run(batches):
        for rows in batches:
            parts = judge(rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *map(pa.array, parts)], names=schema.names)

    return source.mapInArrow(run, schema)


def keep(pages: DataFrame, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT, url_col: str = "url") -> DataFrame:
    """The rows that aren't rejected, with all their columns."""
    judge, names = _judge(tuple(strict), dict(soft), min_soft), pages.columns
    at = names.index(url_col)

    def run(batches):
        for rows in batches:
            yield rows.filter(pa.array(~judge(rows.column(at).to_pylist())[3])).rename_columns(names)

    return numbered(pages).mapInArrow(run, pages.schema)


def oracle_sql() -> str:
    test = lambda t: f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}]){re.escape(t)}([^\\p{{L}}\\p{{N}}\\p{{M}}]|$)')::BIGINT"
    strict = " + ".join(map(test, STRICT))
    soft, weight = " + ".join(map(test, SOFT)), " + ".join(f"{test(t)} * {w}::DOUBLE" for t, w in SOFT.items())
    return f"""
WITH p AS (SELECT page_id, url, lower(coalesce(url, '')) AS u FROM pages),
h AS (SELECT page_id, url, {strict} AS strict_terms, {soft} AS soft_terms, {weight} AS soft_weight FROM p)
SELECT *, strict_terms > 0 OR soft_terms >= {MIN_SOFT} AS rejected FROM h
"""
