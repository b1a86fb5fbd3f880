"""Queries: windows, sessions, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import windows as W
from flowlens.plans.base import DAY, kept, labelled, windowed
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query
from flowlens.sources import flows as IO
from flowlens.sources import views as V
from flowlens.tables import new_path


@query("assign_windows", "SELECT flow_id, window_id FROM wf")
def _(spark, sf):
    return windowed(spark, sf).select("flow_id", "window_id")


@query("min_flows_filter", "SELECT flow_id, window_id FROM kept")
def _(spark, sf):
    return W.min_flows_filter(windowed(spark, sf)).select("flow_id", "window_id")


@query("max_windows", "SELECT flow_id, window_id FROM kept WHERE window_id IN (SELECT window_id FROM win ORDER BY window_id LIMIT 100)")
def _(spark, sf):
    return W.max_windows(windowed(spark, sf), 100).select("flow_id", "window_id")


@query("rewindow", """
  SELECT seconds, window_id, count(*) AS flows FROM (
    SELECT s AS seconds, CAST(floor((start_ms - (SELECT min(start_ms) FROM ev)) / (s * 1000.0::DOUBLE)) AS BIGINT) AS window_id
    FROM ev, (VALUES (30), (300)) v(s)) GROUP BY ALL""")
def _(spark, sf):
    base = W.assign_windows(V.flows_events(spark, sf), 60)
    parts = [W.rewindow(base, s).groupBy("window_id").agg(F.count("*").alias("flows")).select(F.lit(s).alias("seconds"), "window_id", "flows") for s in (30, 300)]
    return parts[0].unionByName(parts[1])


_GAP = 900_000


@query("sessionize", f"""
  SELECT {big('sid')} AS session_id, round(min(start_ms), 3) AS start_ms, round(max(start_ms), 3) AS end_ms,
         {r6('(max(start_ms) - min(start_ms)) / 3600000.0::DOUBLE')} AS hours, count(*) AS flows, {big('sum(label)')} AS attack_flows
  FROM (SELECT *, sum(CASE WHEN gap > {_GAP} THEN 1 ELSE 0 END) OVER (ORDER BY start_ms, flow_id) AS sid FROM
        (SELECT *, start_ms - lag(start_ms) OVER (ORDER BY start_ms, flow_id) AS gap FROM ev)) GROUP BY sid""")
def _(spark, sf):
    s = W.sessionize(V.flows_events(spark, sf), _GAP)
    return s.select(
        "session_id", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), S.r6(F.col("hours")).alias("hours"), "flows", "attack_flows"
    )


@query("window_sessions", """
  SELECT CAST(sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (ORDER BY window_id) AS BIGINT) AS session_id, window_id FROM
    (SELECT window_id, (window_id - lag(window_id) OVER (ORDER BY window_id)) * 600 AS gap FROM
     (SELECT CAST(floor((start_ms - (SELECT min(start_ms) FROM ev)) / 600000.0::DOUBLE) AS BIGINT) AS window_id FROM ev
      GROUP BY 1 HAVING count(*) >= 2))""")
def _(spark, sf):
    table = W.window_table(W.assign_windows(V.flows_events(spark, sf), 600)).withColumn("start_ms", F.col("window_id") * 600000.0)
    return W.assign_sessions(table, W.HOUR_MS).select("session_id", "window_id")


@query("timeline", f"""
  SELECT {big('bin * 600000')} AS bin_start_ms, {big("sum(CASE WHEN attack = 'Benign' THEN 1 ELSE 0 END)")} AS "Benign",
         {big("sum(CASE WHEN attack = 'error' THEN 1 ELSE 0 END)")} AS "error", any_value(m.split) AS split
  FROM tl JOIN (SELECT bin, split FROM (SELECT bin, split, row_number() OVER (PARTITION BY bin ORDER BY count(*) DESC, split) AS rn FROM tl GROUP BY bin, split) WHERE rn = 1) m USING (bin)
  GROUP BY bin""", {"tl": """
  SELECT CAST(floor(start_ms / 600000.0::DOUBLE) AS BIGINT) AS bin, attack, CAST(CASE WHEN CAST(flow_id AS BIGINT) % 10 < 6 THEN 0 WHEN CAST(flow_id AS BIGINT) % 10 < 8 THEN 1 ELSE 2 END AS INTEGER) AS split FROM ev"""})
def _(spark, sf):
    tenth = F.col("flow_id").cast("bigint") % 10
    f = V.flows_events(spark, sf).withColumn("split", F.when(tenth < 6, 0).when(tenth < 8, 1).otherwise(2))
    return W.timeline(f, 10, ["Benign", "error"])


@query("timeline_csv", """
  SELECT CAST(floor(start_ms / 86400000.0::DOUBLE) AS BIGINT) * 86400000 AS bin_start_ms, count(*) AS flows FROM flows GROUP BY ALL""")
def _(spark, sf):
    path = new_path(spark, "timeline")
    df = windowed(spark, sf).withColumn("split", F.lit(0))
    classes = ["Benign", "F-0", "F-1", "F-2", "O-0", "O-1", "O-2"]
    IO.write_timeline(W.timeline(df, 1440, classes), path)
    back = IO.read_flows(spark, path)
    total = sum((S.number(F.col(f"`{c}`")) for c in classes[1:]), S.number(F.col("`Benign`")))
    return back.select(F.col("bin_start_ms").cast("bigint").alias("bin_start_ms"), total.cast("bigint").alias("flows"))


@query("windows_of_split", "SELECT DISTINCT window_id FROM lab WHERE split = 2")
def _(spark, sf):
    return W.windows_of_split(labelled(spark, sf), 2)


@query("window_profile", f"""
  SELECT what, {r6('quantile_cont(size, 0.5)')} AS median, {r6('avg(size)')} AS mean, {r6('quantile_cont(size, 0.95)')} AS p95, {r6('max(size)')} AS largest FROM
  (SELECT 'flows' AS what, count(*)::DOUBLE AS size FROM kept GROUP BY window_id UNION ALL SELECT 'hosts', count(*)::DOUBLE FROM hosts GROUP BY window_id) GROUP BY what""")
def _(spark, sf):
    p = W.window_profile(kept(spark, sf))
    return p.select("what", *[S.r6(F.col(c)).alias(c) for c in ("median", "mean", "p95", "largest")])


@query("late_flows", f"""
  SELECT {r6('avg(late)')} AS late_share, {r6('avg(late) FILTER (label = 1)')} AS late_share_attack, {big('sum(late)')} AS late_flows,
         {r6('quantile_cont(CASE WHEN late > 0 THEN excess END, 0.5)')} AS excess_median_s, {r6('quantile_cont(CASE WHEN late > 0 THEN excess END, 0.95)')} AS excess_p95_s,
         {r6('max(CASE WHEN late > 0 THEN excess END)')} AS excess_max_s, {r6('max(duration_ms) / 1000')} AS duration_max_s
  FROM (SELECT *, CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END AS late FROM (SELECT *,
    (start_ms + duration_ms - ((SELECT min(start_ms) FROM wf) + (window_id + 1) * 86400000.0::DOUBLE)) / 1000.0::DOUBLE AS excess FROM wf))""")
def _(spark, sf):
    out = W.late_flows(windowed(spark, sf), DAY)
    return out.select("late_flows", *[S.r6(F.col(c)).alias(c) for c in out.columns if c != "late_flows"])


@query("window_ordinal", f"SELECT window_id, {big('pos')} AS pos, {big('n_windows')} AS n_windows FROM win")
def _(spark, sf):
    return W.window_ordinal(W.window_table(windowed(spark, sf)))
