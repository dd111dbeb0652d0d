"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontaminate, exactdedup, hpylm, mixing, partenum, passages, quality, tokencount, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.language_scores(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = urlfilter.judge_urls(_table(spark, sf_dir, "pages"))
    return r.select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.mix(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = exactdedup.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_language_model, op3_warc, op4_url_filter, op5_mixing, op6_ngram_jaccard, op7_token_counts, op8_quality, op9_passages, op10_exact_dedup)}

SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM n)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win FROM (SELECT r, doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.s, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(source, '') || chr(1) || md5(coalesce(text, ''))), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
r AS (SELECT *, 3 * source_size / w AS r FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT *, (SELECT level FROM l WHERE level <= r ORDER BY r, source NULLS LAST LIMIT 1) AS cut FROM l),
t AS (SELECT source, source_size, CASE WHEN cut IS NULL OR cut > r THEN 3.0::DOUBLE * source_size ELSE w * cut END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS passes FROM t),
q AS (SELECT *, target - passes * source_size AS remain FROM p),
b AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
u AS (SELECT b.*, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
e AS (SELECT u.source, min(u.h) AS edge, arg_min(u.upto - u.words, u.h) AS before, arg_min(u.words, u.h) AS words
      FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source WHERE u.upto > q.remain GROUP BY u.source),
z AS (SELECT q.*, CASE WHEN e.edge IS NULL THEN 2305843009213693952 WHEN 2 * (remain - before) >= words THEN edge + 1 ELSE edge END AS threshold
      FROM q LEFT JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(least(passes + CASE WHEN h < threshold AND passes < 3 THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d""",
}
