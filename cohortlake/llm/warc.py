"""6. WARC: not-modified revisits are resolved to the full response that they confirm.

A capture is a row (record_id, url, date, kind 'response' or 'revisit', etag, last_modified, headers, body). A revisit (a
server's 304) has no body; it stands for the latest earlier response of the same canonical URL. Its validators are checked
against that response: an entity tag must be the same (weak comparison, W/ ignored); without one on both sides, the
modification date must be the same; with neither the revisit is "unverified". A tag or date that differs is a "mismatch",
no earlier response an "orphan"; only "resolved" revisits get the response's body. Headers of the revisit that a 304 may
update (``PERMITTED``) replace the response's, all others are the response's.

Canonical URL: no scheme, user, default port, fragment or tracking parameters, host in lower case without leading www.,
query sorted, no slash at the end.

The as-of join holds for a URL with a third of all captures: dates are cut into ``SLICES`` ranges, a window carries the
latest response on within a URL and a range, and the last response of each earlier range comes from an aggregation
with at most one row per URL and range. Bodies don't move with it: they are joined by record id in the end.

Cases: a response at the same date as a revisit is earlier if its record id is lower; a null URL or date matches nothing and
is an orphan; a null kind is a response; repeated rows give repeated results with the same target; null headers count as none; an
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICES = 64
#: Headers that a 304 response may carry for the stored response (fixed values of RFC 9110, 15.4.5, and RFC 9111, 3.2).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|session(id)?)="


def canonical(url: Column) -> Column:
    """The key under which captures are of the same resource."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    place = F.substring_index(bare, "?", 1)
    host = F.lower(F.substring_index(place, "/", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.substring(place, F.length(F.substring_index(place, "/", 1)) + 1, F.length(place)), r"/+$", "")
    given = F.when(F.instr(bare, "?") > 0, F.substring(bare, F.length(place) + 2, F.length(bare))).otherwise(F.lit(""))
    kept = F.sort_array(F.filter(F.split(given, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def latest_before(captures: DataFrame, slices: int) -> DataFrame:
    """Revisits (record_id, key, date, etag, last_modified, headers) with ``target``: the latest response before them."""
    bounds = captures.where("date is not null").agg(F.percentile_approx(F.unix_micros("date"), [k / slices for k in range(1, slices)], 1000).alias("p")).first()["p"] or []
    # a count of the bounds below a date; at most ``slices`` comparisons
    cut = sum((F.unix_micros("date") >= b).cast("int") for b in sorted(set(bounds))) if bounds else F.lit(0)
    place = F.struct("date", "record_id")
    response = F.struct("date", "record_id", "etag", "last_modified", "headers")
    rows = captures.withColumn("cut", cut).withColumn("is_response", F.coalesce(F.col("kind"), F.lit("response")) != "revisit")
    here = W.partitionBy("key", "cut").orderBy("date", "record_id", F.desc("is_response")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = F.last(F.when(F.col("is_response"), response), ignorenulls=True).over(here)
    revisits = rows.withColumn("near", near).where("not is_response")
    ends = rows.where("is_response and key is not null and date is not null").groupBy("key", "cut").agg(F.max_by(response, place).alias("end"))
    # only revisits without a response in their own range look further: one row per URL and range
    asked = revisits.where("near is null").select("key", "cut").distinct().withColumn("asks", F.lit(True))
    both = ends.select("key", "cut", "end", F.lit(None).cast("boolean").alias("asks")).unionByName(asked.select("key", "cut", F.lit(None).cast(ends.schema["end"].dataType).alias("end"), "asks"))
    before = W.partitionBy("key").orderBy("cut").rangeBetween(W.unboundedPreceding, -1)
    far = both.withColumn("far", F.last("end", ignorenulls=True).over(before)).where("asks").select("key", "cut", "far")
    return revisits.join(far, ["key", "cut"], "left").withColumn("target", F.coalesce("near", "far")).drop("near", "far", "cut", "is_response")


def status(of: str = "target") -> Column:
    tag = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    tags = F.col(f"{of}.etag").isNotNull() & F.col("etag").isNotNull()
    dates = F.col(f"{of}.last_modified").isNotNull() & F.col("last_modified").isNotNull()
    return (F.when(F.col(of).isNull(), "orphan")
            .when(tags, F.when(tag(F.col("etag")) == tag(F.col(f"{of}.etag")), "resolved").otherwise("mismatch"))
            .when(dates, F.when(F.col("last_modified") == F.col(f"{of}.last_modified"), "resolved").otherwise("mismatch"))
            .otherwise("unverified"))


def resolve(captures: DataFrame, slices: int = SLICES) -> DataFrame:
    """Per revisit: record_id, canonical_url, status, target_id, age in seconds, headers (merged) and body (if resolved)."""
    rows = captures.withColumn("key", canonical(F.col("url")))
    none = F.create_map().cast("map<string,string>")
    light = rows.select("record_id", "key", "date", "kind", "etag", "last_modified", F.coalesce("headers", none).alias("headers"))
    # a null key or date goes its own way: it has no target and must not meet in one window
    lost = light.where("(key is null or date is null) and kind = 'revisit'")
    found = latest_before(light.where("key is not null and date is not null"), slices)
    found = found.unionByName(lost.withColumn("target", F.lit(None).cast(found.schema["target"].dataType)))
    found = found.withColumn("status", status())
    lower = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    updates = F.map_filter(lower(F.col("headers")), lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    stored = lower(F.col("target.headers"))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(F.col("updates"), k)), F.col("updates"))
    found = found.withColumn("updates", updates).withColumn("headers", F.when(F.col("status") == "resolved", merged))
    bodies = rows.groupBy(F.col("record_id").alias("target_id")).agg(F.max("body").alias("body"))
    out = found.select("record_id", F.col("key").alias("canonical_url"), "status", F.col("target.record_id").alias("target_id"),
                       (F.unix_timestamp("date") - F.unix_timestamp("target.date")).alias("age"), "headers")
    asked = out.where("status = 'resolved'").select("target_id").distinct()
    bodies = bodies.join(asked, "target_id", "left_semi")
    return out.join(bodies, "target_id", "left").withColumn("body", F.when(F.col("status") == "resolved", F.col("body")))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from a table of pages (page_id, url, html): each page is fetched in full and revisited twice, one and two weeks
    later, once by its tag and once by its modification date. Pages of one canonical URL are versions of one resource, so that
    revisits of all but the latest don't match."""
    tag = F.md5(F.col("html").cast("binary"))
    crawl = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("crawl")
    rows = pages.select("page_id", "url", "html", crawl)
    headers = F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("Date"), F.lit("Server")), F.array(F.when(F.col("crawl") == 0, "text/html").otherwise("text/plain"), F.concat(F.lit("day "), F.col("crawl").cast("string")), F.concat(F.lit("s"), F.col("crawl").cast("string"))))
    return rows.select((F.col("page_id") * 3 + F.col("crawl")).alias("record_id"), "url",
                       F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") + F.col("crawl") * 604_800).alias("date"),
                       F.when(F.col("crawl") == 0, "response").otherwise("revisit").alias("kind"), F.when(F.length("html").isNotNull() & (F.col("crawl") < 2), tag).alias("etag"),
                       F.concat(F.lit("lm "), F.length("html").cast("string")).alias("last_modified"), headers.alias("headers"),
                       F.when(F.col("crawl") == 0, F.col("html")).alias("body"))
