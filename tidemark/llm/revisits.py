"""Web archive records of the kind 'not modified': resolved to the response that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import stored_copy

# Headers that a 304 response may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that don't tell pages apart.
_TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

# The text runs unchanged in Spark and in the checking engine, but for the global flag of the replacing function.
_STRIPPED = (("#.*$", ""), ("^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), ("^[^/?@]*@", ""))
_HOST = "^[^/?]*"
_HOST_FORM = (("^(www|m)[.]", ""), (":(80|443)?$", ""), ("[.]$", ""))
_REST_FORM = (("[?&](%s)=[^&]*" % _TRACKING, ""), ("^([^?&]*)&", "\\1?"), ("[?]$", ""), ("/+$", ""))


def canonical_url(url: Column) -> Column:
    """Host in lower case, then path and query as they are (these may tell capitals apart); without scheme,
    user, www. or m., port 80 or 443, fragment, tracking parameters and last slash. Null stays null."""
    def replaced(out: Column, by: tuple) -> Column:
        for pattern, text in by:
            out = F.regexp_replace(out, pattern, text.replace("\\1", "$1"))
        return out

    bare = replaced(F.trim(url), _STRIPPED)
    host = F.regexp_extract(bare, _HOST, 0)
    return F.concat(replaced(F.lower(host), _HOST_FORM), replaced(F.substr(bare, F.length(host) + 1), _REST_FORM))


def _canonical_sql(url: str) -> str:
    def replaced(out: str, by: tuple) -> str:
        for pattern, text in by:
            out = f"regexp_replace({out}, '{pattern}', '{text}', 'g')"
        return out

    bare = replaced(f"trim({url})", _STRIPPED)
    host = f"regexp_extract({bare}, '{_HOST}', 0)"
    return replaced(f"lower({host})", _HOST_FORM) + " || " + replaced(f"substr({bare}, length({host}) + 1)", _REST_FORM)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with refers_to, outcome, merged_headers, payload_digest and payload_length.

    records: record_id, url, captured_at, kind ('response' or 'revisit'), headers map<string, string>
    with lower-case names, digest, length; other columns are ignored. A revisit refers to the latest
    response with the same canonical URL that is earlier in (captured_at, record_id). Its outcome is
    'no_earlier_response'; 'changed' if an etag that both have, else a last-modified that both have, else
    the digests if both are there, differ; 'unverified' if none of these can be compared; else 'resolved'.
    A resolved or unverified revisit gets the response's payload, and its headers with the permitted ones
    of the revisit over them; other revisits keep their own headers and no payload. A response refers to
    itself ('response'). Records with null url or time have the outcome 'unusable'. Rows that repeat a
    record are each resolved alike. An empty table gives no rows.

    captured_at may have any type that can be ordered. Records are dealt out by range of (URL, time,
    record_id) and scanned by URL and partition; one row for each hands the last response on to the URL's
    next partition, so a URL with a large share of the records is spread over many tasks.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "kind", "headers", "digest", "length")
    usable = rows.where(F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull())
    # Stored: where the ranges are cut must be the same for every reader.
    usable = stored_copy(usable.repartitionByRange("canonical_url", "captured_at", "record_id").withColumn("stretch", F.spark_partition_id()), "stretches")
    response = F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "headers", "digest", "length"))
    usable = usable.withColumn("own", response)
    last = usable.where(F.col("own").isNotNull()).groupBy("canonical_url", "stretch").agg(
        F.max_by("own", F.struct("captured_at", "record_id")).alias("tail"))
    by_stretch = Window.partitionBy("canonical_url").orderBy("stretch")
    carried = last.select("canonical_url", F.col("stretch").alias("since"), "tail", F.lead("stretch").over(by_stretch).alias("until"))
    in_order = Window.partitionBy("canonical_url", "stretch").orderBy("captured_at", "record_id")
    scanned = usable.withColumn("here", F.last("own", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    settled = scanned.where(F.col("here").isNotNull() | (F.col("kind") == "response")).withColumn("of", F.col("here"))
    loose = scanned.where(F.col("here").isNull() & (F.coalesce(F.col("kind"), F.lit("")) != "response"))
    carried = carried.withColumnRenamed("canonical_url", "_url")
    loose = loose.join(carried, (F.col("canonical_url") == F.col("_url")) & (F.col("since") < F.col("stretch"))
                       & (F.col("until").isNull() | (F.col("until") >= F.col("stretch"))), "left")
    loose = loose.withColumn("of", F.col("tail")).select(*settled.columns)
    found = settled.unionByName(loose)

    def differ(mine: Column, theirs: Column) -> Column:
        return F.when(mine.isNotNull() & theirs.isNotNull(), mine != theirs)

    own, of = F.col("headers"), F.col("of")
    changed = F.coalesce(differ(own["etag"], of["headers"]["etag"]), differ(own["last-modified"], of["headers"]["last-modified"]),
                         differ(F.col("digest"), of["digest"]))
    is_response = F.col("kind") == "response"
    outcome = F.when(is_response, "response").when(of.isNull(), "no_earlier_response").when(changed, "changed").when(
        changed.isNull(), "unverified").otherwise("resolved")
    takes = F.col("outcome").isin("resolved", "unverified")
    permitted = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(of["headers"], lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(permitted, F.create_map())), k))
    merged = F.map_concat(F.coalesce(kept, F.create_map()), F.coalesce(permitted, F.create_map()))
    out = found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "captured_at", "kind", "outcome",
        F.when(is_response, F.col("record_id")).when(takes, of["record_id"]).alias("refers_to"),
        F.when(takes, merged).otherwise(own).alias("merged_headers"),
        F.when(is_response, F.col("digest")).when(takes, of["digest"]).alias("payload_digest"),
        F.when(is_response, F.col("length")).when(takes, of["length"]).alias("payload_length"))
    unusable = rows.where(F.col("canonical_url").isNull() | F.col("captured_at").isNull()).select(
        "record_id", "canonical_url", "captured_at", "kind", F.lit("unusable").alias("outcome"), F.lit(None).cast(rows.schema["record_id"].dataType).alias("refers_to"),
        F.col("headers").alias("merged_headers"), F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_length"))
    return out.unionByName(unusable)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records derived from pages: several captures of each address.

    A page has a response at ten times its id. Every second page has a revisit five later; of these some
    carry a changed etag, some only a last-modified, some no validator at all. Every third page has a second
    response, with another body, seven later, and a revisit of that one eight later. Every seventh page has
    a revisit earlier than any response.
    """
    pages = stored_copy(pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"), F.length("html").cast("long").alias("length")), "captures")
    m = F.col("page_id") % 10

    def captures(which: str, number: int, later: int, kind: str, digest: Column, etag: Column, modified: Column, server: Column) -> DataFrame:
        at = F.col("page_id") * 10 + later
        given = F.create_map(F.lit("content-type"), F.when(F.lit(kind) == "response", F.lit("text/html")), F.lit("date"), F.concat(F.lit("t"), at.cast("string")),
                             F.lit("etag"), etag, F.lit("last-modified"), modified, F.lit("server"), server)
        return pages.where(which).select(
            (F.col("page_id") * 5 + number).alias("record_id"), "url", at.alias("captured_at"), F.lit(kind).alias("kind"),
            F.map_filter(given, lambda _, v: v.isNotNull()).alias("headers"), digest.alias("digest"),
            F.when(F.lit(kind) == "response", F.col("length")).cast("long").alias("length"))

    digest, none = F.col("digest"), F.lit(None).cast("string")
    etag, modified = F.substring("digest", 1, 16), F.concat(F.lit("day-"), (F.col("page_id") % 28).cast("string"))
    second = F.reverse("digest")
    return (captures("true", 0, 0, "response", digest, etag, modified, none)
            .unionByName(captures("page_id % 2 = 0", 1, 5, "revisit", F.when(m != 6, digest), F.when(m == 2, F.lit("other")).when(~m.isin(4, 6), etag),
                                  F.when(m == 4, modified), F.when(m.isin(6, 8, 0), F.lit("s"))))
            .unionByName(captures("page_id % 3 = 0", 2, 7, "response", second, F.substring(second, 1, 16), modified, none))
            .unionByName(captures("page_id % 3 = 0", 3, 8, "revisit", second, F.when(m < 5, F.substring(second, 1, 16)).otherwise(etag), none, none))
            .unionByName(captures("page_id % 7 = 0", 4, -5, "revisit", digest, etag, none, none)))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, {_canonical_sql('url')} AS u, md5(html) AS digest, length(html) AS n, 'day-' || (page_id % 28) AS lm, page_id % 10 AS m FROM pages),
a AS (SELECT page_id * 5 AS record_id, u, page_id * 10 AS t, 'response' AS kind, substr(digest, 1, 16) AS etag, lm, digest, n, NULL AS server FROM p
 UNION ALL SELECT page_id * 5 + 1, u, page_id * 10 + 5, 'revisit',
  CASE m WHEN 2 THEN 'other' WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE substr(digest, 1, 16) END,
  CASE m WHEN 4 THEN lm END, CASE WHEN m <> 6 THEN digest END, NULL, CASE WHEN m IN (6, 8, 0) THEN 's' END FROM p WHERE page_id % 2 = 0
 UNION ALL SELECT page_id * 5 + 2, u, page_id * 10 + 7, 'response', substr(reverse(digest), 1, 16), lm, reverse(digest), n, NULL FROM p WHERE page_id % 3 = 0
 UNION ALL SELECT page_id * 5 + 3, u, page_id * 10 + 8, 'revisit', substr(CASE WHEN m < 5 THEN reverse(digest) ELSE digest END, 1, 16), NULL, reverse(digest), NULL, NULL
  FROM p WHERE page_id % 3 = 0
 UNION ALL SELECT page_id * 5 + 4, u, page_id * 10 - 5, 'revisit', substr(digest, 1, 16), NULL, digest, NULL, NULL FROM p WHERE page_id % 7 = 0),
j AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN struct_pack(r := record_id, t := t, etag := etag, lm := lm, digest := digest, n := n) END IGNORE NULLS)
  OVER (PARTITION BY u ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM a),
c AS (SELECT *, CASE WHEN etag IS NOT NULL AND o.etag IS NOT NULL THEN etag <> o.etag WHEN lm IS NOT NULL AND o.lm IS NOT NULL THEN lm <> o.lm
  WHEN digest IS NOT NULL AND o.digest IS NOT NULL THEN digest <> o.digest END AS changed FROM j),
d AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN o IS NULL THEN 'no_earlier_response' WHEN changed THEN 'changed'
  WHEN changed IS NULL THEN 'unverified' ELSE 'resolved' END AS outcome FROM c)
SELECT record_id, u AS canonical_url, outcome,
 CASE WHEN kind = 'response' THEN record_id WHEN outcome IN ('resolved', 'unverified') THEN o.r END AS refers_to,
 CASE WHEN kind = 'response' THEN 'content-type=text/html;date=t' || t || ';etag=' || etag || ';last-modified=' || lm
  WHEN outcome IN ('resolved', 'unverified') THEN 'content-type=text/html;date=t' || t || ';etag=' || coalesce(etag, o.etag) || ';last-modified=' || coalesce(lm, o.lm)
  ELSE 'date=t' || t || CASE WHEN etag IS NULL THEN '' ELSE ';etag=' || etag END || CASE WHEN lm IS NULL THEN '' ELSE ';last-modified=' || lm END
   || CASE WHEN server IS NULL THEN '' ELSE ';server=' || server END END AS merged_headers,
 CASE WHEN kind = 'response' THEN digest WHEN outcome IN ('resolved', 'unverified') THEN o.digest END AS payload_digest,
 CASE WHEN kind = 'response' THEN n WHEN outcome IN ('resolved', 'unverified') THEN o.n END AS payload_length
FROM d
"""
