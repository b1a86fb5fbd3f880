"""Query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.mixing import mix

SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (SELECT *, md5(concat_ws(':', 'mix', doc_id::VARCHAR, size::VARCHAR)) AS key FROM rows),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM per),
level AS (
  SELECT *, cap / w AS ratio,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lv
  FROM weighed),
shares AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT max(lv) FROM level WHERE lv <= ratio) * w) AS target FROM level),
budget AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM shares),
placed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key))::BIGINT AS upto, (sum(k.size) OVER (PARTITION BY k.source, k.key))::BIGINT AS tied
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE
  WHEN upto <= rest THEN size WHEN upto - tied >= rest OR tied = 0 THEN 0 ELSE ((rest - upto + tied) * size) // tied END)::BIGINT AS taken
FROM placed
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": SQL}
