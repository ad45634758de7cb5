"""WARC not-modified revisits: each is joined as-of to the latest earlier full response of its canonical URL.

A revisit stands for a 304 answer: it has validators and a few headers but no payload. The resolved record has the
response's payload digest, a verdict on the validators, and the response's headers updated by those that a 304 may
change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialize

#: Header fields that a 304 must not change in a stored response (RFC 9111, 3.2, and hop-by-hop fields).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that only track.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """host/path?query: no scheme, user, default port, www, fragment, tracking parameter or last slash; host in lower case, parameters sorted."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def same_tag(a: Column, b: Column) -> Column:
    """Weak comparison of entity tags."""
    return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "")


def merge_headers(stored: Column, update: Column) -> Column:
    """stored, with the fields of update that a 304 may change; sorted by name. Of repeated names, update's all count."""
    name = lambda h: F.lower(h["name"])
    allowed = F.filter(update, lambda h: ~name(h).isin(*KEPT_HEADERS))
    changed = F.transform(allowed, name)
    stays = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(changed, name(h)), F.lit(False)))
    lower = lambda hs: F.transform(hs, lambda h: F.struct(name(h).alias("name"), h["value"].alias("value")))
    return F.array_sort(F.concat(lower(stays), lower(allowed)))


def resolve_revisits(
    records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", kind_col: str = "kind", etag_col: str = "etag", modified_col: str = "last_modified", digest_col: str = "digest", headers_col: str = "headers"
) -> DataFrame:
    """A row for each revisit: record_id, canonical, ts, response_id, response_ts, status, digest, headers.

    kind is "response" (full) or "revisit"; other records are left alone. Earlier means before in the log, which goes
    by time, then record id (WARC dates have whole seconds). status: "orphan" without an earlier response; else by the
    strongest validator that both have, entity tag, modification date, payload digest: "confirmed" or "mismatch";
    "unverified" if they share none. Headers are merged where the status is confirmed or unverified; a mismatch or an
    orphan keeps its own. Records without a URL (null, or nothing left of it) have nothing to do with one another: such
    a revisit is an orphan with a null canonical URL. Null times come first, null headers count as none. An empty log
    gives no rows; other columns don't matter.

    A URL may hold a third of all records, so no window takes a whole URL. Records are dealt by range of (URL, time,
    id) into even cells, a written table; a window within (cell, URL) finds responses in the cell, and one over the
    last response of each (cell, URL), a row each, carries them over cell ends. Payloads never travel.
    """
    empty = F.array().cast(HEADERS)
    narrow = columns(records, record_id=id_col, canonical=F.nullif(canonical_url(F.col(f"`{url_col}`")), F.lit("")), ts=time_col, kind=kind_col, etag=etag_col, modified=modified_col, digest=digest_col, headers=F.coalesce(F.col(f"`{headers_col}`").cast(HEADERS), empty))
    narrow = narrow.where(F.col("kind").isin("response", "revisit"))
    nowhere = narrow.where("canonical is null and kind = 'revisit'")
    narrow = narrow.where("canonical is not null")
    by = ["ts", "record_id", "kind", "etag", "modified", "digest"]
    dealt = materialize(narrow.repartitionByRange("canonical", *by).withColumn("cell", F.spark_partition_id()), "captures")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "ts", "etag", "modified", "digest", "headers"))
    earlier = Window.partitionBy("cell", "canonical").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn("found", F.last(full, ignorenulls=True).over(earlier)).where(F.col("kind") == "revisit")
    latest = dealt.where(F.col("kind") == "response").groupBy("cell", "canonical").agg(F.max(F.struct("ts", "record_id", "kind", "etag", "modified", "digest", "headers")).alias("x"))
    # Cells without a response need a row too, to be carried over to.
    ends = dealt.select("cell", "canonical").distinct().join(latest, ["cell", "canonical"], "left")
    over_cells = Window.partitionBy("canonical").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("x", ignorenulls=True).over(over_cells)).select("cell", "canonical", "carried")
    found = here.join(carried, ["cell", "canonical"], "left")
    part = lambda n: F.coalesce(F.col(f"found.{n}"), F.when(F.col("found").isNull(), F.col(f"carried.{n}")))
    known = F.col("found").isNotNull() | F.col("carried").isNotNull()
    agrees = (
        F.when(F.col("etag").isNotNull() & part("etag").isNotNull(), same_tag(F.col("etag"), part("etag")))
        .when(F.col("modified").isNotNull() & part("modified").isNotNull(), F.col("modified") == part("modified"))
        .when(F.col("digest").isNotNull() & part("digest").isNotNull(), F.col("digest") == part("digest"))
    )
    status = F.when(~known, "orphan").when(agrees.isNull(), "unverified").when(agrees, "confirmed").otherwise("mismatch")
    merged = F.when(F.col("status").isin("confirmed", "unverified"), merge_headers(F.col("stored"), F.col("headers"))).otherwise(merge_headers(empty, F.col("headers")))
    none = {n: F.lit(None).cast(t) for n, t in (("response_id", narrow.schema["record_id"].dataType), ("response_ts", narrow.schema["ts"].dataType), ("digest", narrow.schema["digest"].dataType))}
    alone = nowhere.select("record_id", "canonical", "ts", none["response_id"].alias("response_id"), none["response_ts"].alias("response_ts"), F.lit("orphan").alias("status"), none["digest"].alias("digest"), merge_headers(empty, F.col("headers")).alias("headers"))
    return found.select("record_id", "canonical", "ts", part("record_id").alias("response_id"), part("ts").alias("response_ts"), status.alias("status"), F.when(known, part("digest")).alias("digest"), part("headers").alias("stored"), "headers").select(
        "record_id", "canonical", "ts", "response_id", "response_ts", "status", "digest", merged.alias("headers")
    ).unionByName(alone)


def capture_log(pages: DataFrame) -> DataFrame:
    """A log of captures made from the table `pages`: each page is fetched in full, and asked for again later.

    Second requests come by another form of the URL, with the tag of the page; each seventh page has changed
    meanwhile, each eleventh has no tag and only a date. A tenth come before the first fetch.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 60).alias("ts"), F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 11 != 0, tag).alias("etag"), day.alias("last_modified"), F.md5("html").alias("digest"),
        F.array(header("Content-Length", F.length("html").cast("string")), header("Date", day), header("Server", F.lit("a"))).alias("headers"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://"), F.lit("#again")).alias("url"),
        (F.col("page_id") * 60 + F.when(F.col("page_id") % 10 == 3, -1).otherwise(86_400)).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(F.col("page_id") % 7 == 0, F.lit('"new"')).when(F.col("page_id") % 11 != 0, F.concat(F.lit("W/"), tag)).alias("etag"), day.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.array(header("Content-Length", F.lit("0")), header("Date", F.lit("later")), header("Cache-Control", F.lit("max-age=60"))).alias("headers"),
    )
    return full.unionByName(again)


def digest(resolved: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "|")
    return resolved.select("record_id", "canonical", "ts", "response_id", "response_ts", "status", "digest", shown.alias("headers"))


#: DuckDB: the same log and an as-of by one window for each URL.
ORACLE = r"""
WITH log AS (
  SELECT page_id * 2 AS record_id, url, page_id * 60 AS ts, 'response' AS kind,
    CASE WHEN page_id % 11 <> 0 THEN '"' || substr(md5(html), 1, 12) || '"' END AS etag, 'day ' || page_id AS modified, md5(html) AS digest,
    length(html) AS n FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '^https?://', 'HTTP://') || '#again', page_id * 60 + CASE WHEN page_id % 10 = 3 THEN -1 ELSE 86400 END, 'revisit',
    CASE WHEN page_id % 7 = 0 THEN '"new"' WHEN page_id % 11 <> 0 THEN 'W/"' || substr(md5(html), 1, 12) || '"' END, 'day ' || page_id, NULL, NULL FROM pages
), cut AS (
  SELECT *, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*@)?', '') AS rest FROM log
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept FROM cut
), keyed AS (
  SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM parts
), latest AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'ts': ts, 'etag': etag, 'modified': modified, 'digest': digest, 'n': n} END IGNORE NULLS)
    OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM keyed
), judged AS (
  SELECT *, CASE WHEN r IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = replace(r.etag, 'W/', '') THEN 'confirmed' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN modified = r.modified THEN 'confirmed' ELSE 'mismatch' END
    ELSE 'unverified' END AS status FROM latest WHERE kind = 'revisit'
)
SELECT record_id, canonical, ts, r.id AS response_id, r.ts AS response_ts, status, r.digest AS digest,
  CASE WHEN status = 'confirmed' THEN 'cache-control: max-age=60|content-length: ' || r.n || '|date: later|server: a' ELSE 'cache-control: max-age=60|date: later' END AS headers
FROM judged
"""
