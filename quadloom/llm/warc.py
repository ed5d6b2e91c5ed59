"""Resolution of not-modified revisits to the responses that they confirm.

A revisit record has no payload; it says that a stored response is still
good. It belongs to the latest full response of the same canonical URL that was
captured strictly earlier, if their validators agree: entity tags by weak
comparison, else the time of last modification, else the payload digest. Of
the revisit's headers those that a 304 may update replace the response's.

The as-of join has two levels, so that a URL captured millions of times is no
single task: the last response of each (URL, period) is carried over the periods
of a URL, and within a period a running maximum finds the latest one. Payloads
take no part; only ids, validators and headers move.

Defined results: a null URL resolves to nothing; a null time is earlier than
none and later than none; of responses at one time the greatest id counts; a
repeated revisit is resolved each time; further columns are left behind. A
response never resolves to anything and isn't returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified response updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of one period.
PERIOD = 86_400
TRACKING = "utm_[^=&]*|ref|fbclid|gclid|sessionid"
#: Captures a second, and seconds until a page is asked for again, of the records made from pages.
RATE, REVISIT_AFTER = 0.01, 200_000


def canonical(url: Column) -> Column:
    """Host without "www." and default port, path without index page and trailing slash, parameters sorted without empty and tracking ones.

    Scheme and fragment don't count. Null without a host.
    """
    part = lambda k: F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"^.*@|:(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(2), r"/index\.html?$", ""), "/+$", "")
    kept = F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~x.rlike(f"^(?:{TRACKING})(=.*)?$"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, captured, refers_to, status, digest, headers) of every revisit.

    ``records``: record_id, url, captured (seconds), kind ("response" or
    "revisit"), etag, last_modified, digest, headers (an array of (name, value)).
    status: "resolved", "changed" (validators differ), "unverified" (none on
    both sides) or "missing" (no earlier response). headers are merged where
    resolved, else the revisit's own, sorted by name.
    """
    r = records.select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), F.col("captured").cast("bigint").alias("captured"), (F.col("kind") == "response").alias("_full"),
        F.struct(F.col("captured").cast("bigint").alias("at"), F.col("record_id").alias("id"), "etag", "last_modified", "digest", "headers").alias("_own"),
    ).withColumn("_period", F.floor(F.col("captured") / PERIOD))
    r = r.withColumn("_response", F.when(F.col("_full"), F.col("_own")))
    located = r.where("canonical_url is not null and captured is not null")
    lost = r.where("(canonical_url is null or captured is null) and not _full").withColumn("_found", F.lit(None).cast(r.schema["_own"].dataType))
    key = ["canonical_url", "_period"]
    last = located.groupBy(*key).agg(F.max("_response").alias("_last"))
    before = Window.partitionBy("canonical_url").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*key, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    earlier = Window.partitionBy(*key).orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    found = located.withColumn("_within", F.max("_response").over(earlier)).where("not _full").join(carried, key)
    found = found.withColumn("_found", F.coalesce("_within", "_carried"))
    columns = ["record_id", "canonical_url", "captured", "_own", "_found"]
    return _merged(found.select(*columns).unionByName(lost.select(*columns)))


def _merged(found: DataFrame) -> DataFrame:
    own, of = (lambda c: F.col(f"_own.{c}")), (lambda c: F.col(f"_found.{c}"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = lambda name, f=lambda c: c: F.when(own(name).isNotNull() & of(name).isNotNull(), f(own(name)) == f(of(name)))
    agree = F.coalesce(same("etag", tag), same("last_modified"), same("digest"))
    status = F.when(of("id").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("changed")
    mine = F.coalesce(own("headers"), F.array().cast("array<struct<name:string,value:string>>"))
    theirs = F.coalesce(of("headers"), F.array().cast("array<struct<name:string,value:string>>"))
    news = F.filter(mine, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(news, lambda h: F.lower(h["name"]))
    kept = F.filter(theirs, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    headers = F.when(F.col("status") == "resolved", F.concat(kept, news)).otherwise(mine)
    lines = F.array_join(F.array_sort(F.transform(headers, lambda h: F.concat(F.lower(h["name"]), F.lit(": "), F.coalesce(h["value"], F.lit(""))))), "\n")
    return found.withColumn("status", status).select(
        "record_id", "canonical_url", "captured", of("id").alias("refers_to"), "status", F.when(F.col("status") == "resolved", of("digest")).alias("digest"), lines.alias("headers")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records for each page: its response, and a revisit some days later that found it not modified.

    Pages whose URLs have one canonical form are captures of one address, so a
    revisit may find a newer response than the one it confirms. A response has
    all validators; of revisits a third each has the entity tag, the time of last
    modification (the day of capture) or the payload digest alone.
    """
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select("page_id", "url", F.floor(F.col("page_id") / RATE).alias("_at"), digest.alias("_digest"), F.length("html").alias("_length"))
    day, tag = F.floor(F.col("_at") / PERIOD).cast("string"), F.concat(F.lit("W/"), "_digest")
    only = lambda k, c: F.when(F.pmod(F.col("page_id"), F.lit(3)) == k, c)
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("_at").alias("captured"), F.lit("response").alias("kind"),
        F.array(header("content-type", F.lit("text/html")), header("content-length", F.col("_length")), header("ETag", F.col("_digest")), header("Date", F.col("_at"))).alias("headers"),
        tag.alias("etag"), day.alias("last_modified"), F.col("_digest").alias("digest"),
    )
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), (F.col("_at") + REVISIT_AFTER).alias("captured"), F.lit("revisit").alias("kind"),
        F.array(header("content-length", F.lit(0)), header("Date", F.col("_at") + REVISIT_AFTER), header("Cache-Control", F.lit("max-age=3600"))).alias("headers"),
        only(0, tag).alias("etag"), only(1, day).alias("last_modified"), only(2, F.col("_digest")).alias("digest"),
    )
    return base.select("url", F.explode(F.array(response, revisit)).alias("_r")).select("_r.*", "url")


def oracle_sql() -> str:
    head = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
    return f"""
WITH b AS (SELECT page_id, url, floor(page_id / {RATE})::BIGINT AS at, md5(coalesce(html, '')) AS digest, length(html) AS n,
        regexp_replace(regexp_replace(lower(regexp_extract(trim(url), {head}, 1)), '^.*@|:(80|443)$', ''), '^www\\.', '') AS host,
        regexp_replace(regexp_replace(regexp_extract(trim(url), {head}, 2), '/index\\.html?$', ''), '/+$', '') AS path,
        string_split(regexp_extract(trim(url), {head}, 3), '&') AS params FROM pages),
q AS (SELECT page_id, coalesce(string_agg(p, '&' ORDER BY p) FILTER (WHERE p <> '' AND NOT regexp_full_match(p, '({TRACKING})(=.*)?')), '') AS q
      FROM (SELECT page_id, unnest(params) AS p FROM b) GROUP BY page_id),
c AS (SELECT b.*, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url FROM b LEFT JOIN q USING (page_id)),
j AS (SELECT v.page_id * 2 + 1 AS record_id, v.canonical_url, v.at + {REVISIT_AFTER} AS captured, r.page_id AS rid, r.digest AS theirs, r.n AS n,
        CASE WHEN v.page_id % 3 = 1 THEN floor(v.at / {PERIOD}) = floor(r.at / {PERIOD}) ELSE v.digest = r.digest END AS agree
      FROM c v LEFT JOIN c r ON r.canonical_url = v.canonical_url AND r.at < v.at + {REVISIT_AFTER}
      QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY r.at DESC NULLS LAST, r.page_id DESC) = 1)
SELECT record_id, canonical_url, captured, rid * 2 AS refers_to, CASE WHEN rid IS NULL THEN 'missing' WHEN agree THEN 'resolved' ELSE 'changed' END AS status,
  CASE WHEN agree THEN theirs END AS digest,
  CASE WHEN agree THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || coalesce(n::VARCHAR, '') || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || captured || chr(10) || 'etag: ' || theirs
       ELSE 'cache-control: max-age=3600' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || captured END AS headers
FROM j
"""
