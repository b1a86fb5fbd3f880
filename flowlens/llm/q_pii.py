"""Query of the scan for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.pii_anchors import ACCOUNT_TAIL, CUES, IBAN_TAIL, KINDS, SCHEMES, USER_HOST, find_personal


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(name: str, pattern: str) -> str:
    """Matches of a pattern with their place: behind the texts and matches before."""
    return f"""
{name}_m AS (SELECT row_id, regexp_extract_all(text, {_q(pattern)}) AS hits, regexp_split_to_array(text, {_q(pattern)}) AS gaps FROM docs WHERE regexp_matches(text, {_q(pattern)})),
{name} AS (
  SELECT row_id, hits[i] AS hit, (len(gaps[i]) + coalesce(list_sum(list_transform(gaps[1:i-1], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: len(h))), 0))::BIGINT AS ps
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m))"""


_IBAN, _ACCOUNT = f"(?i:iban){IBAN_TAIL}", f"(?i:{'|'.join(CUES)}){ACCOUNT_TAIL}"
_LOGIN = f"(?i:{'|'.join(sorted(SCHEMES, key=len, reverse=True))})://{USER_HOST}"
_CODE = "list_transform(string_split(substr(code, 5) || left(code, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
{_found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}, {_found("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")},
{_found("card", r"[0-9](?:[\x20-]?[0-9])+")}, {_found("phone", r"\+[0-9][\x20().0-9-]+[0-9]")},
{_found("login", _LOGIN)}, {_found("iban", _IBAN)}, {_found("account", _ACCOUNT)},
cards AS (SELECT row_id, ps, hit, list_transform(string_split(list_reverse(string_split(regexp_replace(hit, '[^0-9]', '', 'g'), '')).array_to_string(''), ''), lambda c: ascii(c) - 48) AS d FROM card),
codes AS (SELECT row_id, ps + len(hit) - len(regexp_extract(hit, {_q(_IBAN)}, 1)) AS s, ps + len(hit) AS e, replace(regexp_extract(hit, {_q(_IBAN)}, 1), ' ', '') AS code FROM iban),
numbers AS (SELECT row_id, regexp_extract(hit, {_q(_ACCOUNT)}, 1) AS number, ps + len(hit) AS e FROM account),
spans AS (
  SELECT row_id, 0 AS kind, ps AS s, ps + len(hit) AS e FROM email
  UNION ALL SELECT row_id, 1, ps, ps + len(hit) FROM ip WHERE list_max(list_transform(string_split(hit, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN 999 ELSE p::BIGINT END)) <= 255
  UNION ALL SELECT row_id, 2, ps, ps + len(hit) FROM cards WHERE len(d) BETWEEN 12 AND 19
    AND list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE (2 * x) // 10 + (2 * x) % 10 END)) % 10 = 0
  UNION ALL SELECT row_id, 3, ps, ps + len(hit) FROM phone WHERE len(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 9 AND 15
  UNION ALL SELECT row_id, 4, ps, ps + len(hit) FROM login
  UNION ALL SELECT row_id, 5, s, e FROM codes WHERE list_reduce(list_prepend(0::BIGINT, {_CODE}), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
  UNION ALL SELECT row_id, 6, e - len(number), e FROM numbers WHERE len(replace(number, '-', '')) BETWEEN 6 AND 18),
joined AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS d,
    string_agg(({KINDS})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 4) AS base,
    string_agg(({KINDS})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS every
  FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(d, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN joined USING (row_id)
"""

QUERIES = {"op13_pii": op13_pii}
ORACLES = {"op13_pii": SQL}
