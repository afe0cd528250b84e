"""WARC: resolution of not-modified revisits.

A revisit record says that a capture was unchanged since an earlier one.  Each is joined as of its
time to the latest strictly earlier full response of the same canonical URL; the validators (entity
tag, weakly compared, else Last-Modified) must agree; then the headers that a 304 may update are
merged over the response's headers.

The as-of join is a global range sort by (URL, time): a URL with any share of the captures is spread
over many partitions, and only the latest response of a URL that crosses a partition's end is carried
on, one row a partition.

Defined cases: a null or unreadable URL gives status no_url; no earlier response gives no_response;
nothing to compare gives no_validator; of responses at one time the largest record id counts; null
times sort first; repeated records are resolved each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

#: Headers that describe the stored body or the connection and so are never taken from a 304.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change the resource.
TRACKING = "ref|utm_[a-z]+|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, no scheme, fragment, tracking parameters or
    trailing slash; parameters sorted.  Null without a host."""
    url = F.trim(F.regexp_replace(url, r"#.*$", ""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    query = F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&")
    query = F.filter(query, lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=.*)?$"))
    query = F.array_join(F.array_sort(query), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored headers, overridden by the update's permitted ones.  Names are lower case."""
    stored, update = F.coalesce(stored, F.create_map().cast("map<string,string>")), F.coalesce(update, F.create_map().cast("map<string,string>"))
    update = F.map_filter(update, lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def resolve_revisits(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """records: record_id long, kind ("response" or "revisit"; others are ignored), url string,
    captured long or timestamp, headers map<string,string> with lower-case names; more columns are
    ignored.  One row a revisit: record_id, canonical_url, captured, response_id, status, headers."""
    spark = records.sparkSession
    partitions = partitions or shuffle_partitions(spark)
    events = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", (F.col("kind") == "response").alias("full"), canonical_url(F.col("url")).alias("key"), "captured", "headers",
    )
    order = ["captured", "full", "record_id"]  # at one time revisits come first: a response must be earlier
    lost = events.filter(F.col("key").isNull() & ~F.col("full"))
    sorted_events = materialize(
        events.filter(F.col("key").isNotNull())
        .repartitionByRange(partitions, "key", *order)
        .withColumn("part", F.spark_partition_id()),
        "revisit-events",
    )
    response = F.when(F.col("full"), F.struct("record_id", "headers"))
    here = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = sorted_events.withColumn("found", F.last(response, ignorenulls=True).over(here))

    # at most one URL a partition end crosses into the next partition
    edges = sorted_events.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    crossing = edges.select(F.col("high").alias("key")).join(
        edges.select(F.col("low").alias("key"), F.col("part").alias("other")), "key",
    ).select("key").distinct()
    tails = sorted_events.join(F.broadcast(crossing), "key", "left_semi").groupBy("part", "key").agg(
        F.max_by(response, F.when(F.col("full"), F.struct(*order))).alias("tail"),
    )
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("part", "key", F.last("tail", ignorenulls=True).over(before).alias("carried"))

    joined = near.filter(~F.col("full")).join(F.broadcast(carried), ["part", "key"], "left")
    found = F.coalesce("found", "carried")
    theirs, ours = found["headers"], F.col("headers")
    tag = strong(theirs["etag"]) == strong(ours["etag"])
    date = theirs["last-modified"] == ours["last-modified"]
    same = F.coalesce(tag, date)
    status = (
        F.when(found.isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    )
    resolved = joined.select(
        "record_id", F.col("key").alias("canonical_url"), "captured", found["record_id"].alias("response_id"),
        status.alias("status"), F.when(status == "resolved", merge_headers(theirs, ours)).alias("headers"),
    )
    return resolved.unionByName(lost.select(
        "record_id", F.col("key").alias("canonical_url"), "captured", F.lit(None).cast("long").alias("response_id"),
        F.lit("no_url").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"),
    ))


#: In the capture log made from pages, a page is asked for again after so many captures.
REVISIT_AFTER = 2001


def capture_log(pages: DataFrame) -> DataFrame:
    """Every page as a full response at time 2 * page_id, and a conditional request for it at the odd
    time 2 * page_id + REVISIT_AFTER, which the server answered with not modified."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    full = pages.select(
        F.col("page_id").alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 2).alias("captured"),
        F.create_map(
            F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"),
            F.lit("date"), F.col("page_id").cast("string"),
        ).alias("headers"),
    )
    again = pages.select(
        F.col("page_id").alias("record_id"), F.lit("revisit").alias("kind"), "url",
        (F.col("page_id") * 2 + REVISIT_AFTER).alias("captured"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("content-length"), F.lit("0"),
            F.lit("date"), (F.col("page_id") + 1).cast("string"), F.lit("age"), F.lit("0"),
        ).alias("headers"),
    )
    return full.unionByName(again)


def op4_revisits(spark, sf_dir) -> DataFrame:
    out = resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select(
        F.col("record_id").alias("page_id"), "canonical_url", "captured", "response_id", "status",
        F.array_join(lines, "\n").alias("headers"),
    )


OP4_SQL = r"""
WITH u AS (SELECT page_id, html, trim(regexp_replace(url, '#.*$', '')) AS url FROM pages),
p AS (SELECT page_id, html, url,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?(.*)$', 1), '&'),
      lambda q: q <> '' AND NOT regexp_matches(q, '^(ref|utm_[a-z]+|fbclid|gclid)(=.*)?$'))), '&') AS query
  FROM u),
k AS (SELECT page_id, html, '"' || md5(coalesce(html, '')) || '"' AS etag,
    CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM p),
r AS (SELECT page_id AS response_id, key, 2 * page_id AS t, etag, coalesce(octet_length(encode(html)), 0) AS n FROM k WHERE key IS NOT NULL),
v AS (SELECT page_id, key, 2 * page_id + 2001 AS captured, etag FROM k)
SELECT v.page_id, v.key AS canonical_url, v.captured, r.response_id,
  CASE WHEN v.key IS NULL THEN 'no_url' WHEN r.response_id IS NULL THEN 'no_response'
       WHEN r.etag = v.etag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN r.etag = v.etag THEN concat('age: 0', chr(10), 'content-length: ', r.n, chr(10), 'content-type: text/html', chr(10),
       'date: ', v.page_id + 1, chr(10), 'etag: W/', v.etag) END AS headers
FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.captured > r.t
"""
