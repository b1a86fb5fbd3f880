"""Queries: streams, run over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.plans.oracle import r6
from flowlens.plans.registry import query
from flowlens.sources import views as V
from flowlens.streaming import history as H
from flowlens.tables import new_path

HOURS = 6


def _stream(spark, sf):
    events = V.table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return V.events_as_flows(source), V.events_as_flows(events).agg(F.min("start_ms").alias("first")).first()["first"]


_HISTORY = {
    "ewf": f"SELECT *, CAST(floor((start_ms - (SELECT min(start_ms) FROM ev)) / {HOURS * 3600000}.0::DOUBLE) AS BIGINT) AS window_id FROM ev",
    "eends": """SELECT window_id, src_ip AS host, dst_ip AS peer, dst_port AS sent_port, in_bytes + out_bytes AS bytes FROM ewf
      UNION ALL SELECT window_id, dst_ip, src_ip, NULL, in_bytes + out_bytes FROM ewf""",
    "eobs": """SELECT host, window_id, row_number() OVER (PARTITION BY host ORDER BY window_id) AS rn, ln(1 + count(*)) AS x1, ln(1 + sum(bytes)) AS x2,
      ln(1 + count(DISTINCT sent_port)) AS x3, ln(1 + count(DISTINCT peer)) AS x4 FROM eends GROUP BY host, window_id""",
    "obs": "SELECT * FROM eobs",
    "efirst": "SELECT host, peer, min(window_id) AS fw FROM eends GROUP BY ALL",
    "enov": "SELECT window_id, host, avg(CASE WHEN window_id = fw THEN 1.0 ELSE 0.0 END) AS nov FROM (SELECT DISTINCT window_id, host, peer FROM eends) JOIN efirst USING (host, peer) GROUP BY ALL",
    "closed": f"SELECT (max(start_ms) - 3600000 - min(start_ms)) AS reach FROM ev",
}


@query("host_history_stream", f"""
  SELECT host, window_id, {r6('z1')} AS z_flows, {r6('z2')} AS z_bytes, {r6('z3')} AS z_ports, {r6('z4')} AS z_peers, {r6('nov')} AS peer_novelty,
    {r6('ln(1 + window_id - (SELECT min(o.window_id) FROM eobs o WHERE o.host = ewma.host))')} AS log_age_windows, CASE WHEN rn = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_first_seen
  FROM ewma JOIN enov USING (window_id, host), closed WHERE (window_id + 1) * {HOURS * 3600000} <= floor(reach)""", _HISTORY)
def _(spark, sf):
    flows, first = _stream(spark, sf)
    out = H.run_available(H.host_history_stream(flows, HOURS * 3600, first, "1 hour"), new_path(spark, "stream"))
    names = ["z_flows", "z_bytes", "z_ports", "z_peers", "peer_novelty", "log_age_windows", "is_first_seen"]
    return out.select("host", "window_id", *[S.r6(F.col(c)).alias(c) for c in names])


@query("sessions_stream", """
  SELECT src_ip, CAST(round(min(start_ms) * 1000) AS BIGINT) AS start_us, count(*) AS flows, CAST(sum(label) AS BIGINT) AS attack_flows FROM
    (SELECT *, sum(CASE WHEN gap >= 900000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY start_ms, flow_id) AS sid FROM (SELECT *, start_ms - lag(start_ms) OVER (PARTITION BY src_ip ORDER BY start_ms, flow_id) AS gap FROM ev))
  GROUP BY src_ip, sid HAVING max(start_ms) + 900000 <= floor((SELECT max(start_ms) FROM ev) - 600000)""")
def _(spark, sf):
    flows, _ = _stream(spark, sf)
    return H.run_available(H.sessions_stream(flows, "src_ip", "15 minutes", "10 minutes"), new_path(spark, "sessions"))
