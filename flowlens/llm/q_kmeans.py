"""Query of the clustering with Ptolemaic pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm.common import read
from flowlens.llm.ptolemaic import cluster


def op12_ptolemaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


# The quotient of whole numbers rounds toward zero; one less if something negative is left.
_DIV = "(sum(x[i])::HUGEINT // count(*) - CASE WHEN sum(x[i])::HUGEINT % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT"


def _round(i: int) -> str:
    return f"""
near{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT r, j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY r),
m{i} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS x FROM (
  SELECT j, i, {_DIV} AS m FROM near{i} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY j, i) GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (j)),"""


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT coalesce(sha256('1:' || vec_id::VARCHAR), '~') AS h, x FROM v ORDER BY h, x LIMIT 16)),
{"".join(map(_round, range(3)))}
last AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT r, j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c3 c) GROUP BY r)
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM last JOIN v USING (r) JOIN c3 USING (j)
"""

QUERIES = {"op12_ptolemaic": op12_ptolemaic}
ORACLES = {"op12_ptolemaic": SQL}
