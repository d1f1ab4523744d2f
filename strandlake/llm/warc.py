"""WARC captures: reading records, and resolving not-modified revisits.

A crawl that gets "304 Not Modified" stores a revisit record without a body. Its
content is that of the latest earlier full response for the same canonical URL,
if the validators agree. The as-of join is done on distinct (URL, time) keys:

1. full responses of one URL and time are one row (the largest record id wins);
2. keys are cut into time buckets at quantiles; inside a (URL, bucket) a window
   finds the last full response, and one carry per (URL, bucket) brings the last
   one of earlier buckets. A URL with a third of all captures is thus spread
   over all buckets and never sorted in one task;
3. revisits fetch the response found by an equi-join on (URL, time).

Edge cases: a null URL matches nothing (``orphan``); a revisit without
validators is resolved by time alone; responses at the same time as the revisit
are not earlier; null times are orphans; repeated revisits are resolved each; an
empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, written

#: Header fields that a not-modified response may update (RFC 9110, 15.4.5), and query parameters that don't identify content.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "utm_[^=&]*|ref|fbclid|gclid|sessionid|phpsessid"
KEYS_PER_BUCKET, MAX_BUCKETS = 20_000, 1024
SEPARATOR = "\r\n\r\nWARC/"
CAPTURE = "record_id long, url string, ts long, status int, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme-less host without www and default port, path without a final slash, sorted query without tracking parameters, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(captures: DataFrame) -> DataFrame:
    """For every revisit (status 304): canonical_url, outcome, source_record, source_ts and merged headers.

    ``captures``: record_id, url, ts, status, headers (lower-case names).
    outcome: resolved, mismatch (validators differ) or orphan (no earlier full response).
    """
    rows = only(captures, "record_id", "url", "ts", "status", "headers").withColumn("curl", canonical_url(F.col("url")))
    full = rows.filter((F.col("status") == 200) & F.col("curl").isNotNull() & F.col("ts").isNotNull())
    # maps can't be compared: the largest record id of a time is found by max_by
    full = full.groupBy("curl", "ts").agg(F.max("record_id").alias("s_record"), F.max_by("headers", "record_id").alias("s_headers"))
    full = written(full, "warc-full")
    visits = rows.filter(F.col("status") == 304)
    keys = (
        full.select("curl", "ts", F.col("ts").alias("full_ts"))
        .union(visits.filter("curl IS NOT NULL AND ts IS NOT NULL").select("curl", "ts", F.lit(None).cast("long")))
        .groupBy("curl", "ts").agg(F.max("full_ts").alias("full_ts"))
    )
    keys = written(keys, "warc-keys")
    n = keys.count()
    buckets = max(1, min(MAX_BUCKETS, n // KEYS_PER_BUCKET))
    cuts = keys.agg(F.percentile_approx("ts", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    keys = keys.withColumn("bucket", F.size(F.filter(bounds, lambda b: b <= F.col("ts"))))
    before = Window.partitionBy("curl", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    inside = keys.withColumn("own", F.last("full_ts", ignorenulls=True).over(before))
    earlier = Window.partitionBy("curl").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = keys.groupBy("curl", "bucket").agg(F.max("full_ts").alias("newest")).withColumn("carry", F.last("newest", ignorenulls=True).over(earlier)).select("curl", "bucket", "carry")
    asof = inside.join(carry, ["curl", "bucket"]).select("curl", "ts", F.coalesce("own", "carry").alias("source_ts")).filter("source_ts IS NOT NULL")
    found = visits.join(asof, ["curl", "ts"], "left").join(full.select("curl", F.col("ts").alias("source_ts"), "s_record", "s_headers"), ["curl", "source_ts"], "left")
    header = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    etag, s_etag = _strong(header("headers", "etag")), _strong(header("s_headers", "etag"))
    modified, s_modified = header("headers", "last-modified"), header("s_headers", "last-modified")
    # an entity tag decides where the revisit has one; the date is the weaker validator
    agrees = F.when(etag.isNotNull(), etag.eqNullSafe(s_etag)).when(modified.isNotNull(), modified.eqNullSafe(s_modified)).otherwise(True)
    outcome = F.when(F.col("s_record").isNull(), "orphan").when(agrees, "resolved").otherwise("mismatch")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("s_headers", lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "url", "ts", F.col("curl").alias("canonical_url"), "outcome", F.when(ok, F.col("s_record")).alias("source_record"), F.when(ok, F.col("source_ts")).alias("source_ts"),
        F.when(ok, F.map_concat(kept, allowed)).alias("merged_headers"),
    )


def record(piece: bytes) -> tuple[dict[str, str], bytes]:
    """(lower-case header fields, block) of one record without its version mark; the block is as long as the record says."""
    head, _, rest = piece.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "0")
    return fields, rest[: int(size) if size.isdigit() else 0]


def http_message(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, lower-case header fields and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    words = lines[0].split(" ")
    status = int(words[1]) if len(words) > 1 and words[0].startswith("HTTP/") and words[1].isdigit() else None
    return status, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all WARC files under ``path``: the columns of CAPTURE and body.

    A record ends with an empty line and the next one starts with its version
    mark, so Spark's line reader, told of that separator, hands out records:
    plain files of any size are read in splits, gzip files as streams, and a task
    holds a record at a time. Of a file that is cut off, what can't be read any
    more is left out. Records are numbered by a hash of file and record.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, piece in zip(b["file"], b["piece"], strict=True):
                fields, block = record(piece)
                if fields.get("warc-type") not in ("response", "revisit"):
                    continue
                status, headers, body = http_message(block)
                ts = int(pd.Timestamp(fields["warc-date"]).timestamp()) if fields.get("warc-date") else None
                key = xxhash.xxh64_intdigest(name.encode() + (fields.get("warc-record-id") or "").encode() + (b"" if fields.get("warc-record-id") else piece)) >> 1
                rows.append({"record_id": key, "url": fields.get("warc-target-uri"), "ts": ts, "status": 304 if fields["warc-type"] == "revisit" else status, "headers": headers, "body": body})
            if rows:
                yield pd.DataFrame(rows).astype({"ts": "Int64", "status": "Int64"})

    pieces = spark.read.option("lineSep", SEPARATOR).option("ignoreCorruptFiles", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInPandas(run, CAPTURE + ", body binary")
