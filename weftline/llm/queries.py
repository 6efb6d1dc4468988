"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.decontaminate import contamination
from weftline.llm.hard_negatives import mine
from weftline.llm.html_extract import page_texts
from weftline.llm.ngram_join import ngram_join
from weftline.llm.packing import pack
from weftline.llm.quality_rules import quality
from weftline.llm.quality_trees import quality_scores
from weftline.llm.secret_scan import secret_report
from weftline.llm.substring_dedup import repeated_spans
from weftline.llm.tandem_runs import run_digests
from weftline.llm.toxicity import toxic_documents
from weftline.llm.url_filter import url_verdicts
from weftline.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), unit="line", windows=12)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_substring_dedup, op4_warc, op5_url_filter,
    op6_secret_scan, op7_quality_rules, op8_packing, op9_toxicity, op10_html_extraction,
    op11_tandem_runs, op12_quality_classifier, op13_hard_negatives,
)}

SQL: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
m AS (SELECT h, max(page_id) AS first FROM d GROUP BY h),
bits AS (SELECT DISTINCT h, list_transform(range(40), lambda i: instr('0123456789abcdef', h[i + 1]) - 1) AS x FROM d),
b32 AS (SELECT h, list_aggregate(list_transform(range(32), lambda k:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j:
    ((x[1 + (5 * k + j) // 4] // (1 << (3 - (5 * k + j) % 4))) % 2) * (1 << (4 - j))))::INT]), 'string_agg', '') AS digest FROM bits)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d JOIN m USING (h) JOIN b32 USING (h)
""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS r
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, other) AS k
  FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.other))::INT AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
""",
}
