"""WARC records: resolution of not-modified revisits.

A revisit record of a 304 answer has no body. It stands for the latest earlier full
response of the same canonical URL, if that response's validators agree: entity
tags by weak comparison where both have one, else the modification dates; a revisit
without validators is taken as it is. The stored response's headers are then updated
from the revisit's, except those that describe a message or a connection.

The as-of join is two windows. A URL's records are cut into time slices; inside a
slice a running maximum gives the latest response strictly before each record, and a
second running maximum over the slices' own latest responses carries on from slice to
slice. A URL with a third of all records is thus spread over its slices, and only one
row for each slice meets in a window of the whole URL. Bodies are not moved; they join
by record id where they are wanted (``with_bodies``).

Defined cases: responses resolve to themselves ("full"); a revisit without earlier
response is "missing", one whose validators differ is "changed"; both have no resolved
id and keep their own headers; records without URL or date find no response; of
responses at the same moment the one with the largest id counts; repeated records are
rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provend.session import stage_table

SLICE_SECONDS = 6 * 3600

#: Header fields that a 304 must not change in a stored response.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding",
              "upgrade")
#: Query parameters that do not name a different resource.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)="
URL = r"^(?:[Hh][Tt][Tt][Pp][Ss]?://)?([^/?#]*)([^?#]*)\??([^#]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a final slash, sorted parameters that
    are not for tracking; scheme and fragment go. An empty URL counts as none."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, URL, 3), "&"),
                                 lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.nullif(F.concat(host, path, query), F.lit(""))


def _fields(block: Column) -> Column:
    """Header lines as an array of (name in lower case, value); lines without a colon are left out."""
    lines = F.filter(F.split(block, "\r\n"), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))


def header(fields: Column, name: str) -> Column:
    """The first value of a field, null if there is none."""
    return F.get(F.filter(fields, lambda x: x["name"] == name), F.lit(0))["value"]


def parse_records(records: DataFrame, col: str = "record") -> DataFrame:
    """Columns of WARC/1.1 records held as text: record_id, type, url, date, status, fields, body.

    A record without a header block has null in every column.
    """
    gap = "\r\n\r\n"
    head, rest = F.substring_index(F.col(col), gap, 1), F.col("_rest")
    after = lambda s: F.when(F.instr(s, gap) > 0, F.substring(s, F.instr(s, gap) + 4, F.length(s)))
    rows = records.select("*", _fields(head).alias("_warc"), after(F.col(col)).alias("_rest"))
    http = F.substring_index(rest, gap, 1)
    return rows.select(
        *(c for c in records.columns if c != col),
        header(F.col("_warc"), "warc-record-id").alias("record_id"), header(F.col("_warc"), "warc-type").alias("type"),
        header(F.col("_warc"), "warc-target-uri").alias("url"),
        F.try_to_timestamp(header(F.col("_warc"), "warc-date")).alias("date"),
        F.regexp_extract(http, r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int").alias("status"),
        _fields(http).alias("fields"), after(rest).alias("body"))


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``records`` (record_id, type, url, date, status, fields) with url_key, resolved_id, outcome and headers.

    ``headers`` is the array of (name, value), sorted, that the record stands for.
    """
    full = (F.col("type") == "response") & (F.col("status") == 200)
    at = F.unix_micros("date")
    # parsed once: the records' keys and fields feed both windows
    rows = stage_table(records.select("record_id", "type", "status", "fields",
                                      canonical_url(F.col("url")).alias("url_key"), at.alias("at")), "revisit-records")
    rows = (rows
            .withColumn("slice", F.floor(F.col("at") / (slice_seconds * 1_000_000)))
            .withColumn("known", F.when(full, F.struct("at", "record_id", "fields"))))
    placed = F.col("at").isNotNull() & F.col("url_key").isNotNull()
    # one row for each moment of a URL, so a slice has no more rows than moments however many records it has
    moments = stage_table(rows.where(placed).groupBy("url_key", "slice", "at").agg(F.max("known").alias("known")),
                          "revisit-moments")
    own = Window.partitionBy("url_key", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    slices = moments.groupBy("url_key", "slice").agg(F.max("known").alias("newest"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.max("newest").over(earlier).alias("carried"))
    latest = moments.withColumn("latest", F.max("known").over(own)).join(carried, ["url_key", "slice"]).select(
        "url_key", "at", F.coalesce("latest", "carried").alias("before"))
    # a record without URL or date has no earlier response and passes by
    joined = rows.where(placed).join(latest, ["url_key", "at"]).unionByName(
        rows.where(~placed), allowMissingColumns=True)
    joined = joined.withColumn("base", F.when(~F.coalesce(full, F.lit(False)), F.col("before")))

    bare = lambda tag: F.regexp_replace(tag, "^[Ww]/", "")
    tag, old_tag = header(F.col("fields"), "etag"), header(F.col("base.fields"), "etag")
    day, old_day = header(F.col("fields"), "last-modified"), header(F.col("base.fields"), "last-modified")
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), bare(tag) == bare(old_tag)).when(
        day.isNotNull() & old_day.isNotNull(), day == old_day).otherwise(tag.isNull() & day.isNull())
    revisit = (F.col("type") == "revisit") & (F.col("status") == 304)
    outcome = (F.when(full, "full").when(~F.coalesce(revisit, F.lit(False)), "other")
               .when(F.col("base").isNull(), "missing").when(agrees, "resolved").otherwise("changed"))

    named = F.transform(F.split(F.lower(F.coalesce(header(F.col("fields"), "connection"), F.lit(""))), ","), F.trim)
    fresh = F.filter("fields", lambda x: ~x["name"].isin(*NOT_MERGED) & ~F.array_contains(F.col("_named"), x["name"]))
    stale = F.filter("base.fields", lambda x: ~F.exists("_fresh", lambda y: y["name"] == x["name"]))
    return (joined.withColumn("outcome", outcome).withColumn("_named", named).withColumn("_fresh", fresh)
            .withColumn("headers", F.array_sort(F.when(F.col("outcome") == "resolved", F.concat(stale, F.col("_fresh")))
                                                .otherwise(F.col("fields"))))
            .withColumn("resolved_id", F.when(F.col("outcome") == "full", F.col("record_id"))
                        .when(F.col("outcome") == "resolved", F.col("base.record_id")))
            .select("record_id", "type", "url_key", "outcome", "resolved_id", "headers"))


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved records with the body of the response they stand for (null where there is none)."""
    bodies = records.where(F.col("type") == "response").select(F.col("record_id").alias("resolved_id"), "body")
    return resolved.join(bodies, "resolved_id", "left")


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of four visits to every page: the response, then revisits or a changed response.

    Visit 1 is answered 304 with the first tag; visit 2 brings a new body for every fourth page and a 304 with
    the weak tag for others; visit 3 is a 304 by modification date for every third page, with the first tag for
    others. So some revisits find a response that has changed since.
    """
    tag = F.substring(F.md5(F.col("html")), 1, 16)
    visit, page = F.col("visit"), F.col("page_id")
    new = (visit == 2) & (page % 4 == 0)
    when = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + page * 37 + visit * 90_000),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.when(new, F.concat("html", F.lit("<!-- 2 -->"))).otherwise(F.col("html"))
    is_full = (visit == 0) | new
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    etag = F.when(new, F.concat(F.lit('"n'), tag, F.lit('"'))).when(
        visit == 2, F.concat(F.lit('W/"'), tag, F.lit('"'))).otherwise(F.concat(F.lit('"'), tag, F.lit('"')))
    by_date = (visit == 3) & (page % 3 == 0)
    modified = F.concat(F.lit("day "), (page % 28 + F.when(new, 1).otherwise(0)).cast("string"))
    http = F.concat(
        F.when(is_full, F.lit("HTTP/1.1 200 OK\r\n")).otherwise(F.lit("HTTP/1.1 304 Not Modified\r\n")),
        line("Cache-Control", F.concat(F.lit("max-age="), (visit * 60).cast("string"))),
        F.when(by_date, F.lit("")).otherwise(line("ETag", etag)),
        F.when(is_full | by_date, line("Last-Modified", modified)).otherwise(F.lit("")),
        F.when(is_full, line("Content-Type", F.lit("text/html"))).otherwise(
            F.concat(line("Connection", F.lit("X-Hop")), line("X-Hop", F.lit("1")))),
        line("Content-Length", F.when(is_full, F.octet_length(body)).otherwise(0).cast("string")), F.lit("\r\n"),
        F.when(is_full, body).otherwise(F.lit("")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(is_full, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(":"), visit.cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.coalesce(F.col("url"), F.lit(""))), line("WARC-Date", when),
        line("Content-Length", F.octet_length(http).cast("string")), F.lit("\r\n"), http, F.lit("\r\n\r\n"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html"), F.lit("")).alias("html"),
                        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("visit"))
    return rows.select("page_id", "visit", record.alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every record of the visits to all pages, resolved."""
    records = parse_records(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.transform("headers", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")
    return resolve(records).select("record_id", "url_key", "outcome", "resolved_id", listed.alias("headers"))


SQL = r"""
WITH v AS (
  SELECT page_id, url, coalesce(html, '') AS html, k AS visit, substr(md5(coalesce(html, '')), 1, 16) AS tag,
         k = 2 AND page_id % 4 = 0 AS new, 1600000000 + page_id * 37 + k * 90000 AS ts,
         '<urn:page:' || page_id || ':' || k || '>' AS record_id
  FROM pages, (SELECT unnest(range(0, 4)) AS k)
), c AS (
  SELECT *, visit = 0 OR new AS is_full, visit = 3 AND page_id % 3 = 0 AS by_date,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[Hh][Tt][Tt][Pp][Ss]?://)?([^/?#]*)([^?#]*)\??([^#]*)', 1)),
           '^www[0-9]*\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(url, '^(?:[Hh][Tt][Tt][Pp][Ss]?://)?([^/?#]*)([^?#]*)\??([^#]*)', 2), '/+$', '') AS base_url,
         list_sort(list_filter(string_split(regexp_extract(url, '^(?:[Hh][Tt][Tt][Pp][Ss]?://)?([^/?#]*)([^?#]*)\??([^#]*)', 3), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)='))) AS params
  FROM v
), r AS (
  SELECT *, base_url || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
         CASE WHEN by_date THEN NULL WHEN new THEN 'n' || tag ELSE tag END AS etag,
         CASE WHEN by_date THEN NULL WHEN new THEN '"n' || tag || '"' WHEN visit = 2 THEN 'W/"' || tag || '"' ELSE '"' || tag || '"' END AS raw_tag,
         CASE WHEN is_full OR by_date THEN 'day ' || (page_id % 28 + CASE WHEN new THEN 1 ELSE 0 END) END AS modified,
         'max-age=' || (visit * 60) AS cache,
         strlen(CASE WHEN new THEN html || '<!-- 2 -->' ELSE html END) AS size
  FROM c
), f AS (
  SELECT url_key, ts, max_by(record_id, record_id) AS record_id, max_by(etag, record_id) AS etag, max_by(raw_tag, record_id) AS raw_tag,
         max_by(modified, record_id) AS modified, max_by(size, record_id) AS size
  FROM r WHERE is_full GROUP BY url_key, ts
), j AS (
  SELECT r.*, f.record_id AS f_id, f.etag AS f_tag, f.raw_tag AS f_raw, f.modified AS f_modified, f.size AS f_size,
         CASE WHEN r.is_full THEN 'full' WHEN f.record_id IS NULL THEN 'missing'
              WHEN r.etag IS NOT NULL THEN CASE WHEN r.etag = f.etag THEN 'resolved' ELSE 'changed' END
              WHEN r.modified = f.modified THEN 'resolved' ELSE 'changed' END AS outcome
  FROM r ASOF LEFT JOIN f ON r.url_key = f.url_key AND r.ts > f.ts
)
SELECT record_id, url_key, outcome,
       CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN f_id END AS resolved_id,
       CASE outcome
         WHEN 'full' THEN 'cache-control=' || cache || ';content-length=' || size || ';content-type=text/html;etag=' || raw_tag || ';last-modified=' || modified
         WHEN 'resolved' THEN 'cache-control=' || cache || ';content-length=' || f_size || ';content-type=text/html;etag=' || coalesce(raw_tag, f_raw) || ';last-modified=' || coalesce(modified, f_modified)
         ELSE 'cache-control=' || cache || ';connection=X-Hop;content-length=0' || coalesce(';etag=' || raw_tag, '') || coalesce(';last-modified=' || modified, '') || ';x-hop=1'
       END AS headers
FROM j
"""
