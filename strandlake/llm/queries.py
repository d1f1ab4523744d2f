"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, html_text, langid, licenses, mixing, simhash, token_files, toxicity, warc
from .common import fold, read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learnt from the rows outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    score = toxicity.score(docs, model)
    return score.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS points FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i + 1, k, t.replace("'", "''")) for i, (k, t) in enumerate(licenses.TEMPLATES))
    near = licenses.THRESHOLD / (2 - licenses.THRESHOLD)
    words = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
    return rf"""
WITH t0(template, license, text) AS (VALUES {rows}),
t AS (SELECT template, license, len(w) - 1 AS m, w FROM (SELECT template, license, {words} AS w FROM t0)),
tb AS (SELECT template, m, w[i] || ' ' || w[i + 1] AS b, count(*) AS c FROM (SELECT template, m, w, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS did, doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
db AS (SELECT did, i AS pos, w[i] || ' ' || w[i + 1] AS b FROM (SELECT did, w, unnest(range(1, len(w))) AS i FROM d)),
h0 AS (SELECT did, template, m, c, pos, b, row_number() OVER (PARTITION BY did, template ORDER BY pos) AS j, row_number() OVER (PARTITION BY did, template, b ORDER BY pos) AS r FROM db JOIN tb USING (b)),
h AS (SELECT x.did, x.template, x.m, x.pos, coalesce(y.pos, 0) AS before FROM h0 x LEFT JOIN h0 y ON x.did = y.did AND x.template = y.template AND x.b = y.b AND x.r - x.c = y.r),
v AS (SELECT a.did, a.template, a.m, a.pos, e.pos - a.pos + 1 AS n, sum(CASE WHEN e.before < a.pos THEN 1 ELSE 0 END) OVER (PARTITION BY a.did, a.template, a.pos ORDER BY e.pos) AS shared
  FROM h a JOIN h e ON a.did = e.did AND a.template = e.template AND e.pos >= a.pos AND e.pos < a.pos + floor(a.m / {near} + 1e-9)),
best AS (SELECT did, template, arg_max({{'pos': pos, 'n': n, 'dice': dice}}, row(dice, -pos, -n)) AS x FROM (SELECT *, CAST(2 * shared AS DOUBLE) / (m + n) AS dice FROM v WHERE n >= ceil(m * {near} - 1e-9)) WHERE dice >= {licenses.THRESHOLD} GROUP BY ALL)
SELECT doc_id, array_to_string(d.w[x.pos:x.pos + x.n], ' ') AS segment, CAST(template AS INTEGER) AS template, license, x.dice AS dice, x.pos - 1 AS start FROM best JOIN d USING (did) JOIN t USING (template)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A page's first full capture is at SPACING * page_id; its second version and the revisits come so much later.
SPACING, SECOND, AFTER_FIRST, AFTER_SECOND = 4, 6000, 2001, 8001


def captures(pages: DataFrame) -> DataFrame:
    """The crawl that the pages stand for: two versions of every page, and four revisits.

    Revisits come after the first version with its entity tag (weak), after the
    second one with its modification date only, after the second one with the
    first one's tag, and before both without any validator.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("tag"))
    k, text = F.col("page_id"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    at = SPACING * k

    def row(number, ts, status, **headers):
        cells = [x for name, v in headers.items() for x in (F.lit(name.replace("_", "-")), v)]
        return F.struct(number.alias("record_id"), ts.alias("ts"), F.lit(status).alias("status"), F.create_map(*cells).alias("headers"))

    html, first, second = F.lit("text/html"), text('"', F.col("tag"), '"'), text('"', F.col("tag"), '2"')
    every = F.array(
        row(2 * k, at, 200, etag=first, last_modified=text("one ", k), content_type=html, date=text(k)),
        row(2 * k + 1, at + SECOND, 200, etag=second, last_modified=text("two ", k), content_type=html, date=text(k)),
        row(4 * k, at + AFTER_FIRST, 304, etag=text("W/", first), content_length=F.lit("0"), date=text(k, "+")),
        row(4 * k + 1, at + AFTER_SECOND, 304, last_modified=text("two ", k), date=text(k, "++")),
        row(4 * k + 2, at + AFTER_SECOND, 304, etag=first, date=text(k, "++")),
        row(4 * k + 3, at - 1, 304, date=text(k, "-")),
    )
    return p.select("url", F.inline(every))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl that the pages stand for, resolved to a version of its page."""
    found = warc.resolve(captures(read_table(spark, sf_dir, "pages")))
    header = lambda k: F.try_element_at("merged_headers", F.lit(k))
    return found.select("record_id", "canonical_url", "outcome", "source_record", "source_ts", header("date").alias("date"), header("last-modified").alias("last_modified"), header("content-type").alias("content_type"), header("content-length").alias("content_length"))


OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages
), c AS (
  SELECT page_id, tag, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^({warc.TRACKING})(=|$)'))) AS q FROM p
), u AS (SELECT page_id, tag, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS curl FROM c),
f0 AS (
  SELECT curl, {SPACING} * page_id AS ts, 2 * page_id AS rec, '"' || tag || '"' AS etag, 'one ' || page_id AS lm FROM u
  UNION ALL SELECT curl, {SPACING} * page_id + {SECOND}, 2 * page_id + 1, '"' || tag || '2"', 'two ' || page_id FROM u
), f AS (SELECT curl, ts, max(rec) AS s_rec, arg_max(etag, rec) AS s_etag, arg_max(lm, rec) AS s_lm FROM f0 GROUP BY ALL),
v AS (
  SELECT curl, 4 * page_id AS record_id, {SPACING} * page_id + {AFTER_FIRST} AS ts, '"' || tag || '"' AS etag, CAST(NULL AS VARCHAR) AS lm, page_id || '+' AS date FROM u
  UNION ALL SELECT curl, 4 * page_id + 1, {SPACING} * page_id + {AFTER_SECOND}, NULL, 'two ' || page_id, page_id || '++' FROM u
  UNION ALL SELECT curl, 4 * page_id + 2, {SPACING} * page_id + {AFTER_SECOND}, '"' || tag || '"', NULL, page_id || '++' FROM u
  UNION ALL SELECT curl, 4 * page_id + 3, {SPACING} * page_id - 1, NULL, NULL, page_id || '-' FROM u
), j AS (
  SELECT w.*, f.ts AS s_ts, s_rec, s_lm, s_rec IS NOT NULL AND CASE WHEN w.etag IS NOT NULL THEN w.etag = s_etag WHEN w.lm IS NOT NULL THEN w.lm = s_lm ELSE true END AS ok
  FROM (SELECT *, ts - 1 AS before FROM v) w ASOF LEFT JOIN f ON w.curl = f.curl AND w.before >= f.ts
)
SELECT record_id, curl AS canonical_url, CASE WHEN s_rec IS NULL THEN 'orphan' WHEN ok THEN 'resolved' ELSE 'mismatch' END AS outcome, CASE WHEN ok THEN s_rec END AS source_record, CASE WHEN ok THEN s_ts END AS source_ts,
       CASE WHEN ok THEN date END AS date, CASE WHEN ok THEN s_lm END AS last_modified, CASE WHEN ok THEN 'text/html' END AS content_type, CAST(NULL AS VARCHAR) AS content_length
FROM j
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_tokens(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; labels are learnt from the rows outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_source_mix": op5_source_mix,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_decontaminate": op7_decontaminate,
    "op8_main_text": op8_main_text,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_license_scan": _op3_sql(), "op6_warc_revisits": OP6_SQL}
