"""WARC: not-modified revisit resolution.

A revisit record with profile server-not-modified has headers but no payload. ``resolve`` finds, by
an as-of join on the canonical url, the latest earlier full response and checks the validators of
the two: equal strong or weak ETags (RFC 9110 weak comparison) or, where either lacks an ETag, equal
Last-Modified. If they agree, the revisit takes the response's payload, and the response's headers
are updated by those of the revisit that a 304 may change (RFC 9111: all but the ones that describe
the stored body). ``records_of_pages`` derives a capture log from a table of pages.

The as-of join sorts narrow rows by (url, date) over all tasks at once and carries the last response
along each chunk and, for a url that spans chunks, across them; so a url with a third of all records
is many chunks, not one task. ``attach_payload`` joins payloads by record id, a join that adaptive
execution can split where one response serves many revisits.

Defined results: a null url or date is never resolved (``no_url``); no earlier response ->
``no_response``; neither validator comparable -> ``unverified``; unequal -> ``changed``; records of
one date are ordered by record id, responses first; repeated records are resolved alike; header names
compare without case, and of a repeated name the last value counts; a record without an id has no
payload; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import running_agg
from .common import save, table

#: Headers of a 304 that never replace stored ones (fixed values).
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate")
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a closing slash go; host in lower case; parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def header_map(block: Column) -> Column:
    """Lower-case header name -> value of a raw ``Name: value`` block; the last of a repeated name counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^[^:\s]+:")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def resolve(records: DataFrame) -> DataFrame:
    """One row per record of (record_id, kind, url, date, headers).

    Returns record_id, kind, canonical, refers_to (the response's record id), outcome (``response``,
    ``resolved``, ``changed``, ``unverified``, ``no_response`` or ``no_url``) and headers (map).
    """
    r = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "date", header_map(F.col("headers")).alias("h"))
    is_response = F.coalesce(F.col("kind") == "response", F.lit(False))
    narrow = save(r.withColumn("late", (~is_response).cast("int")), "warc-records")
    usable = F.col("canonical").isNotNull() & F.col("date").isNotNull()
    offer = F.when(F.col("late") == 0, F.struct("date", "record_id", F.map_entries("h").alias("entries")))
    seen = running_agg(narrow.where(usable), ["canonical"], ["date", "late", "record_id"], [("found", "max", offer, False)])
    unplaced = narrow.where(~usable).withColumn("found", F.lit(None).cast(seen.schema["found"].dataType))
    rows = seen.select(*unplaced.columns).unionAll(unplaced).withColumn("stored", F.map_from_entries("found.entries"))

    tag = lambda h: F.regexp_replace(h["etag"], r"^W/", "")
    own, stored = F.col("h"), F.col("stored")
    agrees = F.coalesce(tag(own) == tag(stored), own["last-modified"] == stored["last-modified"])
    late = F.when(~usable, "no_url").when(F.col("found").isNull(), "no_response").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed")
    outcome = F.when(F.col("late") == 0, "response").otherwise(late)
    update = F.map_filter(own, lambda k, v: ~k.isin(*BODY_HEADERS))
    merged = F.map_zip_with(stored, update, lambda k, old, new: F.coalesce(new, old))
    return rows.select("record_id", "kind", "canonical", F.when(F.col("late") == 1, F.col("found.record_id")).alias("refers_to"), outcome.alias("outcome"),
                       F.when(outcome == "resolved", merged).otherwise(own).alias("headers"))


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """``resolved`` with the payload of each response and resolved revisit; ``payloads``: (record_id, payload), of a repeated id the greatest counts."""
    source = F.when(F.col("outcome") == "response", F.col("record_id")).when(F.col("outcome") == "resolved", F.col("refers_to"))
    own = payloads.groupBy(F.col("record_id").alias("payload_of")).agg(F.max("payload").alias("payload"))
    return resolved.withColumn("payload_from", source).join(own, F.col("payload_from") == F.col("payload_of"), "left").drop("payload_of", "payload_from")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log, one record a page in page order: a page counts as a capture of the front page of its
    site section (host and first path segment, query and fragment kept), so urls recur. Digits of md5 decide
    which captures are revisits (5 in 16), which urls have an ETag or Last-Modified, and which change from
    capture to capture."""
    section = F.concat(F.regexp_extract("url", r"^([^:]*://[^/?#]*(?:/[^/?#]*)?)", 1), F.regexp_extract("url", r"([?#].*)$", 1))
    key = F.md5(F.coalesce(canonical_url(section), F.lit("")).cast("binary"))
    version = F.when(F.substring(key, 1, 1) < "c", F.lit(0)).otherwise(F.pmod(F.col("page_id"), F.lit(2)))
    revisit = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 1) < "5", F.lit(False))
    lines = F.concat_ws("\r\n",
                        F.when(~revisit, F.lit("Content-Type: text/html")),
                        F.when(revisit, F.lit("Content-Length: 0")).otherwise(F.concat(F.lit("Content-Length: "), F.length("html").cast("string"))),
                        F.concat(F.lit("Cache-Control: max-age="), F.when(revisit, F.lit("600")).otherwise(F.lit("60"))),
                        F.when(F.substring(key, 2, 1) < "a", F.concat(F.when(revisit, F.lit("etag: W/")).otherwise(F.lit("ETag: ")), F.lit('"'), F.substring(key, 1, 8), version.cast("string"), F.lit('"'))),
                        F.when(F.substring(key, 3, 1) < "c", F.concat(F.lit("Last-Modified: Mon, 01 Jan 2024 00:00:0"), version.cast("string"), F.lit(" GMT"))),
                        F.concat(F.lit("X-Capture: "), F.col("page_id").cast("string")))
    date = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")).cast("timestamp_ntz")
    return pages.select(F.col("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("kind"), section.alias("url"), date.alias("date"), lines.alias("headers"))


def op8_warc_revisit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = attach_payload(resolve(records_of_pages(pages)), pages.select(F.col("page_id").alias("record_id"), F.col("html").alias("payload")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return got.select(F.col("record_id").alias("page_id"), "kind", "canonical", "refers_to", "outcome", F.array_join(lines, "\n").alias("headers"),
                      F.sha2(F.col("payload"), 256).alias("payload_sha256"), F.length("payload").cast("long").alias("payload_chars"))


ORACLE_SQL = r"""WITH sections AS (SELECT page_id, html, regexp_extract(url, '^([^:]*://[^/?#]*(?:/[^/?#]*)?)', 1) || regexp_extract(url, '([?#].*)$', 1) AS url FROM pages),
split AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM sections),
parts AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)'))) AS params FROM split),
keyed AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM parts),
hashed AS (SELECT *, md5(coalesce(canonical, '')) AS k, coalesce(substr(md5(CAST(page_id AS VARCHAR)), 1, 1) < '5', false) AS revisit FROM keyed),
logged AS MATERIALIZED (SELECT *, CASE WHEN substr(k, 1, 1) < 'c' THEN 0 ELSE page_id % 2 END AS v FROM hashed),
records AS MATERIALIZED (SELECT *, CASE WHEN substr(k, 2, 1) < 'a' THEN '"' || substr(k, 1, 8) || v || '"' END AS etag, CASE WHEN substr(k, 3, 1) < 'c' THEN 'Mon, 01 Jan 2024 00:00:0' || v || ' GMT' END AS modified FROM logged),
found AS (SELECT r.*, f.page_id AS rid, f.etag AS f_etag, f.modified AS f_modified, f.html AS f_html
  FROM (SELECT * FROM records WHERE revisit) r ASOF LEFT JOIN (SELECT * FROM records WHERE NOT revisit) f ON r.canonical = f.canonical AND r.page_id > f.page_id),
judged AS (SELECT *, CASE WHEN canonical IS NULL OR page_id IS NULL THEN 'no_url' WHEN rid IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND f_etag IS NOT NULL THEN CASE WHEN etag = f_etag THEN 'resolved' ELSE 'changed' END
  WHEN modified IS NOT NULL AND f_modified IS NOT NULL THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'changed' END ELSE 'unverified' END AS outcome FROM found)
SELECT page_id, 'response' AS kind, canonical, NULL::BIGINT AS refers_to, 'response' AS outcome,
  concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || length(html), 'content-type: text/html', 'etag: ' || etag, 'last-modified: ' || modified, 'x-capture: ' || page_id) AS headers,
  CASE WHEN page_id IS NOT NULL THEN sha256(html) END AS payload_sha256, CASE WHEN page_id IS NOT NULL THEN CAST(length(html) AS BIGINT) END AS payload_chars FROM records WHERE NOT revisit
UNION ALL
SELECT page_id, 'revisit', canonical, rid, outcome,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=600', 'content-length: ' || length(f_html), 'content-type: text/html', 'etag: ' || coalesce('W/' || etag, f_etag), 'last-modified: ' || coalesce(modified, f_modified), 'x-capture: ' || page_id)
  ELSE concat_ws(chr(10), 'cache-control: max-age=600', 'content-length: 0', 'etag: W/' || etag, 'last-modified: ' || modified, 'x-capture: ' || page_id) END,
  CASE WHEN outcome = 'resolved' THEN sha256(f_html) END, CASE WHEN outcome = 'resolved' THEN CAST(length(f_html) AS BIGINT) END FROM judged"""
