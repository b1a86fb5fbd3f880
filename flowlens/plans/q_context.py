"""Queries: host history, role, assembled context, and the flagship question."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import context as X
from flowlens.operators import graph as G
from flowlens.operators import history as H
from flowlens.plans.base import kept
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query
from flowlens.tables import cut


def _observed(df):
    # Written, since the history reads it for its span and for its rows: a row per window and host, where the flows would be counted twice.
    hosts = G.host_counts(G.endpoints(G.pair_table(df)))
    return cut(H.observations(hosts, X.port_stats(G.port_counts(df))), "observed")


_X = {"log_flows": "x1", "log_bytes": "x2", "log_ports": "x3", "log_peers": "x4"}
_Z = {"z_flows": "z1", "z_bytes": "z2", "z_ports": "z3", "z_peers": "z4"}


def _list(names: dict) -> str:
    return ", ".join(f"{r6(v)} AS {k}" for k, v in names.items())


@query("unusual_hosts", f"""
  SELECT window_id, host, {r6('s')} AS surprise, {_list(_Z)} FROM
  (SELECT *, greatest(abs(z1), abs(z2), abs(z3), abs(z4)) AS s FROM ewma) ORDER BY {r6('s')} DESC, window_id, host LIMIT 20""")
def _(spark, sf):
    scored = H.ewma_zscore(H.ewma_history(_observed(kept(spark, sf))))
    out = scored.select("window_id", "host", S.r6(F.greatest(*[F.abs(F.col(z)) for z in _Z])).alias("surprise"), *[S.r6(F.col(z)).alias(z) for z in _Z])
    return out.orderBy(F.desc("surprise"), "window_id", "host").limit(20)


@query("observations", f"SELECT window_id, host, {_list(_X)} FROM obs")
def _(spark, sf):
    return _observed(kept(spark, sf)).select("window_id", "host", *[S.r6(F.col(c)).alias(c) for c in _X])


@query("ewma_history", f"SELECT window_id, host, {big('rn - 1')} AS earlier_windows, {r6('m1')} AS mean_log_flows, {r6('v1')} AS var_log_flows, {r6('m2')} AS mean_log_bytes, {r6('v2')} AS var_log_bytes FROM ewma")
def _(spark, sf):
    h = H.ewma_history(_observed(kept(spark, sf)))
    names = ["mean_log_flows", "var_log_flows", "mean_log_bytes", "var_log_bytes"]
    return h.select("window_id", "host", F.col("earlier_windows").cast("bigint").alias("earlier_windows"), *[S.r6(F.col(c)).alias(c) for c in names])


@query("ewma_zscore", f"SELECT window_id, host, {_list(_Z)} FROM ewma")
def _(spark, sf):
    z = H.ewma_zscore(H.ewma_history(_observed(kept(spark, sf))))
    return z.select("window_id", "host", *[S.r6(F.col(c)).alias(c) for c in _Z])


@query("peer_novelty", f"SELECT window_id, host, {r6('peer_novelty')} AS peer_novelty FROM novelty")
def _(spark, sf):
    return H.peer_novelty(G.endpoints(G.pair_table(kept(spark, sf)))).select("window_id", "host", S.r6(F.col("peer_novelty")).alias("peer_novelty"))


@query("host_age", f"""
  SELECT window_id, host, {r6('ln(1 + window_id - min(window_id) OVER (PARTITION BY host))')} AS elapsed,
         {r6('ln(1 + least(row_number() OVER (PARTITION BY host ORDER BY window_id) - 1, 60))')} AS active_capped FROM hosts""")
def _(spark, sf):
    nodes = G.nodes(kept(spark, sf))
    both = H.host_age(H.host_age(nodes).withColumnRenamed("log_age_windows", "elapsed"), "active", 60)
    return both.select("window_id", "host", S.r6(F.col("elapsed")).alias("elapsed"), S.r6(F.col("log_age_windows")).alias("active_capped"))


@query("first_seen_flag", "SELECT window_id, host, CASE WHEN rn = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_first_seen FROM obs")
def _(spark, sf):
    return H.first_seen_flag(G.nodes(kept(spark, sf)))


@query("inbound_ratio", f"SELECT window_id, host, {r6('flows_in / (flows_in + flows_out)')} AS inbound_ratio FROM hosts")
def _(spark, sf):
    return X.role_context(kept(spark, sf)).select("window_id", "host", S.r6(F.col("inbound_ratio")).alias("inbound_ratio"))


@query("server_port_share", f"SELECT window_id, host, {r6('coalesce(service / sent, 0)')} AS server_port_share FROM hosts LEFT JOIN portstat USING (window_id, host)")
def _(spark, sf):
    return X.role_context(kept(spark, sf)).select("window_id", "host", S.r6(F.col("server_port_share")).alias("server_port_share"))


@query("dst_port_entropy", f"SELECT window_id, host, {r6('coalesce(entropy, 0)')} AS dst_port_entropy FROM hosts LEFT JOIN portstat USING (window_id, host)")
def _(spark, sf):
    return X.role_context(kept(spark, sf)).select("window_id", "host", S.r6(F.col("dst_port_entropy")).alias("dst_port_entropy"))


@query("role_context", f"SELECT window_id, host, {_list({c: c for c in X.ROLE})} FROM ctx")
def _(spark, sf):
    return X.role_context(kept(spark, sf)).select("window_id", "host", *[S.r6(F.col(c)).alias(c) for c in X.ROLE])


_ALL = X.context_names()


@query("host_context", f"SELECT window_id, host, {_list({c: c for c in _ALL})} FROM ctx")
def _(spark, sf):
    return X.host_context(kept(spark, sf)).select("window_id", "host", *[S.r6(F.col(c)).alias(c) for c in _ALL])


@query("host_context_grouped", f"SELECT window_id, host, {_list({c: c for c in _ALL})} FROM ctx")
def _(spark, sf):
    return X.host_context(kept(spark, sf), grouped=True).select("window_id", "host", *[S.r6(F.col(c)).alias(c) for c in _ALL])


@query("host_context_groups", f"""
  SELECT window_id, host, {_list({c: c for c in X.ROLE})}, {r6('sin(2 * pi() * a)')} AS tod_sin, {r6('cos(2 * pi() * a)')} AS tod_cos FROM ctx
  JOIN (SELECT window_id, ((min(start_ms) / 1000.0::DOUBLE) % 86400.0::DOUBLE) / 86400.0::DOUBLE AS a FROM kept GROUP BY window_id) USING (window_id)""")
def _(spark, sf):
    out = X.host_context(kept(spark, sf), structural=False, behavioural=False, time=True)
    return out.select("window_id", "host", *[S.r6(F.col(c)).alias(c) for c in X.ROLE + X.TIME])
