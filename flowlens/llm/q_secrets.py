"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.secret_scan import ACCESS, ALLOWED, ASSIGN, CANDIDATE, HEX, KINDS, LEAST_BITS, PATH, TIMES, UNITS, WINDOW, WORDS, _limit, find_secrets


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(name: str, pattern: str) -> str:
    """Matches of a pattern with their place: behind the texts and matches before."""
    return f"""
{name}_m AS (SELECT row_id, regexp_extract_all(text, {_q(pattern)}) AS hits, regexp_split_to_array(text, {_q(pattern)}) AS gaps FROM docs WHERE regexp_matches(text, {_q(pattern)})),
{name} AS (
  SELECT row_id, hits[i] AS hit, (len(gaps[i]) + list_sum(list_transform(gaps[1:i-1], lambda g: len(g))) + list_sum(list_transform(hits[1:i-1], lambda h: len(h))))::BIGINT AS ps, i
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m) WHERE i > 1
  UNION ALL SELECT row_id, hits[1], len(gaps[1])::BIGINT, 1 FROM {name}_m)"""


def _runs(size: int, holds: str) -> str:
    return f"list_transform(list_filter(range(0, len(hit) - {size} + 1), lambda q: {holds}), lambda q: {{'s': q, 'e': q + {size}}})"


_STRETCHES = " || ".join(
    [f"[{{'s': 0::BIGINT, 'e': len(regexp_extract(hit, {_q(PATH)}))::BIGINT}}]"]
    + [_runs(TIMES * k, f"substr(hit, q + 1, {(TIMES - 1) * k}) = substr(hit, q + 1 + {k}, {(TIMES - 1) * k})") for k in range(1, UNITS + 1)]
    + [_runs(len(w), f"substr(hit, q + 1, {len(w)}) = '{w}'") for w in WORDS]
)
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
{_found("assign", ASSIGN)}, {_found("access", ACCESS)}, {_found("hex", HEX)}, {_found("candidate", CANDIDATE)},
suspect AS (SELECT *, CASE WHEN regexp_matches(hit, {_q(LEAST_BITS[0][0])}) THEN {_limit(LEAST_BITS[0][1])}
    WHEN regexp_matches(hit, {_q(LEAST_BITS[1][0])}) THEN {_limit(LEAST_BITS[1][1])} ELSE {_limit(LEAST_BITS[2][1])} END AS most
  FROM (SELECT *, {_STRETCHES} AS allowed FROM candidate WHERE NOT regexp_matches(hit, {_q(ALLOWED)}))),
windows AS (SELECT *, unnest(list_filter(range(0, len(hit) - {WINDOW} + 1), lambda w: len(list_filter(allowed, lambda r: r.s < w + {WINDOW} AND r.e > w)) = 0)) AS w FROM suspect),
letters AS (SELECT row_id, i, ps, most, w, substr(hit, w + unnest(range(1, {WINDOW} + 1)), 1) AS c FROM windows),
counts AS (SELECT row_id, i, ps, most, w, c, count(*) AS n FROM letters GROUP BY ALL),
flagged AS (SELECT row_id, i, ps, w FROM counts GROUP BY row_id, i, ps, most, w HAVING sum(round(n * log2(n) * 1e9)::BIGINT) <= most),
islands AS (SELECT *, w - lag(w) OVER (PARTITION BY row_id, i ORDER BY w) > {WINDOW} AS gap FROM flagged),
numbered AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, i ORDER BY w) AS island FROM islands),
spans AS (
  SELECT row_id, 0 AS kind, ps AS s, ps + len(hit) AS e FROM assign WHERE len(regexp_extract(hit, {_q(ASSIGN)}, 2)) >= 6
  UNION ALL SELECT row_id, 1, ps, ps + len(hit) FROM access UNION ALL SELECT row_id, 2, ps, ps + len(hit) FROM hex
  UNION ALL SELECT row_id, 3, ps + min(w), ps + max(w) + {WINDOW} FROM numbered GROUP BY row_id, i, ps, island),
joined AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS h,
    string_agg((['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    string_agg((['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS every
  FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN joined USING (row_id)
"""

QUERIES = {"op8_secrets": op8_secrets}
ORACLES = {"op8_secrets": SQL}
