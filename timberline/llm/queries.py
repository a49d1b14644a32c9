"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import brown, quality, toxicity
from timberline.llm.alignment import align
from timberline.llm.chat import format_chats
from timberline.llm.exact_dedup import exact_groups
from timberline.llm.language import identify
from timberline.llm.merkle import against_edit
from timberline.llm.mixture import curriculum
from timberline.llm.near_dedup import near_groups
from timberline.llm.packing import pack
from timberline.llm.secrets import scan
from timberline.llm.spelling import variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by place; the strings themselves only as digests."""
    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "number", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "predicted")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edit(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), added=True)


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), p AS (
  SELECT conv_id, pos, n, md5(string_agg(md5(role || chr(31) || text), ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS h FROM t
), longer AS (SELECT DISTINCT h FROM p WHERE pos < n
), k AS (
  SELECT min(conv_id) AS conv_id, n, count(*)::BIGINT AS snapshots FROM p WHERE pos = n AND h NOT IN (SELECT h FROM longer) GROUP BY h, n
)
SELECT k.conv_id, ((pos - 1) // 512)::INT AS part, k.n AS n_turns, snapshots,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of integrals 5, 2, 1: rising, falling, highest in the middle."""
    return curriculum(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s AS (
  SELECT *, CASE curve WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS curve FROM s0)
), fill AS (
  SELECT 0 AS i, (SELECT sum(source_size) / sum(w) FROM s)::DOUBLE AS level
  UNION ALL
  SELECT i + 1, (SELECT (sum(source_size) - coalesce(sum(3.0 * source_size) FILTER (3.0 * source_size < w * level), 0)) / sum(w) FILTER (3.0 * source_size >= w * level) FROM s)::DOUBLE
  FROM fill WHERE i < 40
), t AS (
  SELECT source, curve, source_size, least(3.0 * source_size, w * (SELECT max(level) FROM fill))::DOUBLE AS target FROM s
), c AS (
  SELECT doc_id, size, source_size, target, curve,
    (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b,
    (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
, p AS (
  SELECT *, (k * size + greatest(0, least(size, round(target - k * source_size)::BIGINT - b)))::BIGINT AS taken, least(1.0::DOUBLE, b::DOUBLE / target) AS u FROM c
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE curve
  WHEN 0 THEN 10.0::DOUBLE * u / (2.5::DOUBLE + sqrt(6.25::DOUBLE + 50.0::DOUBLE * u))
  WHEN 1 THEN 4.0::DOUBLE * u / (3.0::DOUBLE + sqrt(9.0::DOUBLE - 8.0::DOUBLE * u))
  ELSE CASE WHEN u < 0.5 THEN 2.0::DOUBLE * u / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 4.0::DOUBLE * u))
    ELSE 0.5::DOUBLE + 2.0::DOUBLE * (u - 0.5::DOUBLE) / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 4.0::DOUBLE * (u - 0.5::DOUBLE))) END END, 9) END AS position
FROM p
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_scores": op1_brown_scores,
        "op2_near_dedup": op2_near_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_secret_scan": op4_secret_scan,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_chat_snapshots": op8_chat_snapshots,
        "op9_quality": op9_quality,
        "op10_curriculum_mix": op10_curriculum_mix,
        "op11_token_alignment": op11_token_alignment,
        "op12_language_id": op12_language_id,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": OP5_SQL,
        "op8_chat_snapshots": OP8_SQL,
        "op10_curriculum_mix": OP10_SQL,
    }
