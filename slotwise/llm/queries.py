"""Registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, neardup, packing, pii, quality, revisit, secrets, topk, toxicity, urlfilter
from slotwise.llm.common import table


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.maxscore_topk(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op2_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def archive_records(pages: DataFrame) -> DataFrame:
    """Archive records of the pages, up to five of each: a response; a revisit
    by another form of the URL, whose entity tag or time of last change may be
    the same, changed or absent; of every second page a changed response; a
    revisit after it; and of every eighth page a revisit before everything."""
    page, c = F.col("page_id"), F.col("c")
    rows = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c")).where((c != 2) | (page % 2 == 0)).where((c != 4) | (page % 8 == 0))
    is_full = c.isin(0, 2)
    time = page + F.element_at(F.array(*(F.lit(1_000_000 * x) for x in (0, 1, 2, 3, -1))), c + 1)
    other = F.concat(F.regexp_replace("url", "^https?://", "https://www."), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=mail"))
    state = F.when((c == 2) | ((c == 3) & (page % 2 == 0)), "u").otherwise("t")
    tag = F.concat(F.lit('"'), state, (page % 7).cast("string"), F.lit('"'))
    tag = F.when(is_full & (page % 4 != 3), tag).when((c == 1) & (page % 3 == 0), F.lit('"new"')).when((c == 1) & (page % 6 != 1) | (c > 2), F.concat(F.lit("W/"), tag))
    changed = F.when(page % 5 != 4, page % 11 + F.when((c == 1) & (page % 10 == 7), 1).otherwise(0))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length, F.lit("ETag"), tag, F.lit("Date"), time.cast("string"))
    short = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), tag, F.lit("Date"), time.cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    return rows.select(
        (page * 8 + c).alias("record_id"), F.when(c == 1, other).otherwise(F.col("url")).alias("url"), time.alias("time"), F.when(is_full, "response").otherwise("revisit").alias("type"),
        tag.alias("etag"), changed.alias("last_modified"), F.when(is_full, F.md5(F.concat("html", c.cast("string")))).alias("digest"), F.map_filter(F.when(is_full, full).otherwise(short), lambda _, v: v.isNotNull()).alias("headers"),
    )


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisit.resolve(archive_records(table(spark, sf_dir, "pages")))


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_recursive_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "first")


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_maxscore_topk": op1_maxscore_topk,
    "op2_semi_markov_pii": op2_semi_markov_pii,
    "op3_revisit_resolution": op3_revisit_resolution,
    "op4_url_trees": op4_url_trees,
    "op5_recursive_secrets": op5_recursive_secrets,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_fourier_quality": op7_fourier_quality,
    "op8_noisy_channel_toxicity": op8_noisy_channel_toxicity,
    "op9_weighted_minhash": op9_weighted_minhash,
    "op10_cgk_decontamination": op10_cgk_decontamination,
}

ORACLES = {
    "op1_maxscore_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id AS query_id, min(v) AS qv FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
        s AS (SELECT query_id, vec_id, CAST(list_inner_product(qv, v) AS BIGINT) AS score FROM q JOIN e ON vec_id <> query_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op3_revisit_resolution": """
        WITH b AS (
            SELECT page_id, html, c, page_id * 8 + c AS record_id, c IN (0, 2) AS is_full,
                   CASE WHEN c = 1 THEN regexp_replace(url, '^https?://', 'https://www.') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail' ELSE url END AS url,
                   page_id + 1000000 * CASE c WHEN 4 THEN -1 ELSE c END AS time,
                   '"' || CASE WHEN c = 2 OR (c = 3 AND page_id % 2 = 0) THEN 'u' ELSE 't' END || page_id % 7 || '"' AS tag
            FROM (SELECT page_id, url, html, unnest(range(5)) AS c FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL)
            WHERE (c <> 2 OR page_id % 2 = 0) AND (c <> 4 OR page_id % 8 = 0)),
        p AS (
            SELECT *, CASE WHEN is_full AND page_id % 4 <> 3 THEN tag WHEN is_full THEN NULL WHEN c = 1 AND page_id % 3 = 0 THEN '"new"' WHEN c = 1 AND page_id % 6 = 1 THEN NULL ELSE 'W/' || tag END AS etag,
                   CASE WHEN page_id % 5 <> 4 THEN page_id % 11 + CASE WHEN c = 1 AND page_id % 10 = 7 THEN 1 ELSE 0 END END AS last_modified,
                   regexp_replace(regexp_replace(url, '#[\\s\\S]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain
            FROM b),
        k AS (
            SELECT *, regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), '^www\\.|:80$|:443$', '', 'g')
                   || regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
                   list_sort(list_filter(string_split(regexp_extract(plain, '\\?([\\s\\S]*)$', 1), '&'),
                             lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept
            FROM p),
        r AS (
            SELECT record_id, time, is_full, etag, last_modified, html, c, place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key,
                   CASE WHEN is_full THEN record_id END AS full_id
            FROM k),
        a AS (
            SELECT *, last_value(full_id IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY time, record_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_id
            FROM r),
        o AS (
            SELECT a.record_id, a.url_key, a.source_id, a.time, coalesce(a.etag, f.etag) AS tag, f.html, f.c,
                   CASE WHEN a.etag IS NOT NULL AND f.etag IS NOT NULL THEN regexp_replace(a.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') ELSE a.last_modified = f.last_modified END AS same
            FROM a LEFT JOIN r f ON f.record_id = a.source_id WHERE NOT a.is_full)
        SELECT record_id, url_key, source_id, CASE WHEN source_id IS NULL THEN 'no earlier response' WHEN same IS NULL THEN 'no common validator' WHEN same THEN 'resolved' ELSE 'validator mismatch' END AS outcome,
               CASE WHEN same THEN md5(html || c) END AS digest,
               CASE WHEN same THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || length(coalesce(html, '')) || chr(10)
                    || 'content-type: text/html' || chr(10) || 'date: ' || time || CASE WHEN tag IS NULL THEN '' ELSE chr(10) || 'etag: ' || tag END END AS headers
        FROM o
    """,
}
