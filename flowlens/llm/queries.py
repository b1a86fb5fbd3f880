"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from flowlens.llm import q_ann, q_bpe, q_kmeans, q_language, q_licenses, q_mixing, q_pii, q_pq, q_records, q_secrets, q_simhash, q_toxicity, q_whitening

MODULES = [q_language, q_mixing, q_toxicity, q_bpe, q_simhash, q_records, q_pq, q_secrets, q_licenses, q_ann, q_whitening, q_kmeans, q_pii]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
