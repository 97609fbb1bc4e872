"""One query for each corpus operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, icws, lattice, negatives, simhash, spotsigs, substring, templates, toxicity, urllists, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.main_text(_table(spark, sf_dir, "pages"), carry=("page_id", "url"))
    return found.select("page_id", "url", "text", "n_chars", "n_template_blocks", "n_template_chars", "n_marked_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS win FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM d)),
least AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM wins JOIN least USING (win) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(_table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """The tables hold no URL list; this derives dated entries from the hosts and paths of the pages.

    Each host gets an entry of some kind by its md5: itself, a domain of one to three
    labels, or the first segment of its first path with or without a slash; most are
    removed later and some come back.
    """
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    hosts = pages.select(templates.host_of(F.col("url")).alias("host"), path.alias("path")).filter("host != ''").groupBy("host").agg(F.min("path").alias("path"))
    v = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    day = lambda n: F.lit(1_704_067_200) + n * 86_400
    segment = F.concat("host", F.lit("/"), F.regexp_extract("path", "^/([^/]*)", 1))
    own = hosts.select("host", "path", v.alias("v")).select(
        F.when(F.col("v") % 4 == 0, "domain").when(F.col("v") % 4 == 1, "prefix").otherwise("host").alias("kind"),
        F.when(F.col("v") % 64 == 0, F.substring_index("host", ".", -1)).when(F.col("v") % 8 == 0, F.substring_index("host", ".", -2)).when(F.col("v") % 4 == 0, F.substring_index("host", ".", -3))
        .when(F.col("v") % 8 == 1, segment).when(F.col("v") % 8 == 5, F.concat(segment, F.lit("/"))).otherwise(F.col("host")).alias("pattern"),
        F.when(F.col("v") % 3 == 0, "adult").when(F.col("v") % 3 == 1, "malware").otherwise("spam").alias("category"),
        "v",
    )
    added = own.select("kind", "pattern", "category", day(F.col("v") % 500).alias("at"), F.lit("add").alias("action"))
    removed = own.filter("v % 7 != 0").select("kind", "pattern", "category", day(F.col("v") % 500 + 20 + F.col("v") % 211).alias("at"), F.lit("remove").alias("action"))
    again = own.filter("v % 5 = 0").select("kind", "pattern", "category", day(F.col("v") % 500 + 300).alias("at"), F.lit("add").alias("action"))
    return added.unionByName(removed).unionByName(again)


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.unix_timestamp(fetched_at(F.col("page_id"))).alias("fetched_at"))
    return urllists.evaluate(captures, list_entries(pages))


OP5_SQL = r"""
WITH cap AS (SELECT page_id, url, CAST(1704067200 + ((page_id * 104729) % 63072000 + 63072000) % 63072000 AS BIGINT) AS fetched_at,
      coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
      coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS v, host || '/' || regexp_extract(min(path), '^/([^/]*)', 1) AS segment, string_split(host, '.') AS labels FROM cap WHERE host <> '' GROUP BY host),
own AS (SELECT v, CASE v % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'prefix' ELSE 'host' END AS kind,
      CASE WHEN v % 4 = 0 THEN array_to_string(list_slice(labels, greatest(len(labels) - CASE WHEN v % 64 = 0 THEN 0 WHEN v % 8 = 0 THEN 1 ELSE 2 END, 1), len(labels)), '.') WHEN v % 8 = 1 THEN segment WHEN v % 8 = 5 THEN segment || '/' ELSE host END AS pattern,
      CASE v % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS category FROM hosts),
events AS (SELECT kind, pattern, category, moment, max(action) AS action FROM (
      SELECT kind, pattern, category, 1704067200 + (v % 500) * 86400 AS moment, 'add' AS action FROM own
      UNION ALL SELECT kind, pattern, category, 1704067200 + (v % 500 + 20 + v % 211) * 86400, 'remove' FROM own WHERE v % 7 <> 0
      UNION ALL SELECT kind, pattern, category, 1704067200 + (v % 500 + 300) * 86400, 'add' FROM own WHERE v % 5 = 0) GROUP BY ALL),
spans AS (SELECT * FROM (SELECT kind, pattern, category, moment, action, lead(moment) OVER (PARTITION BY kind, pattern, category ORDER BY moment) AS until FROM events) WHERE action = 'add'),
hits AS (SELECT c.page_id, s.category, s.moment FROM cap c JOIN spans s ON c.host <> '' AND s.moment <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until)
      AND ((s.kind = 'host' AND c.host = s.pattern) OR (s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)))
        OR (s.kind = 'prefix' AND (starts_with(c.host || c.path, rtrim(s.pattern, '/') || '/') OR c.host || c.path = s.pattern)))),
found AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(moment) AS active_since FROM hits GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, coalesce(f.n_active, 0) AS n_active, coalesce(f.categories, '') AS categories, CAST(f.active_since AS BIGINT) AS active_since, f.page_id IS NOT NULL AS blocked
FROM cap c LEFT JOIN found f USING (page_id)
"""


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(_table(spark, sf_dir, "documents"))


def fetched_at(page_id: Column) -> Column:
    """The pages table has no fetch times; this gives each page one within 2024 and 2025."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(page_id * 104_729, F.lit(63_072_000)))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_format(fetched_at(F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    headers = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nX-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    records = warc.build_derivatives(_table(spark, sf_dir, "pages"), date=date, headers=headers)
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "source_headers", "source_digest", "content_type", "block_digest", "content_length", F.sha2("header", 256).alias("header_sha256"), F.sha2("block", 256).alias("block_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM bw))),
hits AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(x.named, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items x USING (doc_id)
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icws.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


OP13_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lattice_score": op4_lattice_score,
    "op5_url_lists": op5_url_lists,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_spotsigs": op7_spotsigs,
    "op8_decontamination": op8_decontamination,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {"op3_substring_dedup": OP3_SQL, "op5_url_lists": OP5_SQL, "op8_decontamination": OP8_SQL, "op13_hard_negatives": OP13_SQL}
