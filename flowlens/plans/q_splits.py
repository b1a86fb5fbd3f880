"""Queries: splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import splits as T
from flowlens.operators import windows as W
from flowlens.plans.base import labelled, windowed
from flowlens.plans.oracle import big
from flowlens.plans.registry import query
from flowlens.sources import views as V
from flowlens.tables import cut


def _windows(spark, sf):
    return cut(W.window_ordinal(W.window_table(windowed(spark, sf))))


def _code(expr: str) -> str:
    return f"CAST({expr} AS INTEGER)"


@query("split_chronological", f"SELECT window_id, {_code('split')} AS split FROM winsplit")
def _(spark, sf):
    return T.split_chronological(_windows(spark, sf)).select("window_id", "split")


@query("split_blocked", f"""
  SELECT window_id, {_code("CASE WHEN size < 3 THEN 0 WHEN k < tr THEN 0 WHEN k < tr + least(va, size - tr) THEN 1 ELSE 2 END")} AS split FROM (
    SELECT *, greatest(1, size - va - te) AS tr FROM (
      SELECT *, greatest(1, CAST(floor(size * 0.1::DOUBLE) AS BIGINT)) AS va, greatest(1, CAST(floor(size * 0.2::DOUBLE) AS BIGINT)) AS te FROM (
        SELECT *, CASE WHEN blk = nb - 1 THEN n_windows - blk * per ELSE per END AS size, pos - blk * per AS k FROM (
          SELECT *, least(pos // per, nb - 1) AS blk FROM (
            SELECT *, greatest(1, n_windows // nb) AS per FROM (
              SELECT *, CASE WHEN n_windows < 3 THEN 1 ELSE greatest(1, least(10, n_windows // 3)) END AS nb FROM win))))))""")
def _(spark, sf):
    return T.split_blocked(_windows(spark, sf)).select("window_id", "split")


@query("split_blocked_ratio", f"""
  SELECT window_id, {_code("CASE WHEN k < a THEN 0 WHEN k < a + b THEN 1 ELSE 2 END")} AS split FROM (
    SELECT *, CAST(floor(size * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(size * 0.1::DOUBLE) AS BIGINT) AS b FROM (
      SELECT *, CASE WHEN blk = 9 THEN n_windows - 9 * (n_windows // 10) ELSE n_windows // 10 END AS size, pos - blk * (n_windows // 10) AS k
      FROM (SELECT *, least(pos // (n_windows // 10), 9) AS blk FROM win)))""")
def _(spark, sf):
    return T.split_blocked_ratio(_windows(spark, sf)).select("window_id", "split")


@query("split_random_windows", f"""
  SELECT window_id, {_code("CASE WHEN rn <= a THEN 0 WHEN rn <= b1 THEN 1 ELSE 2 END")} AS split, {_code("CASE WHEN rn <= a THEN 0 WHEN rn <= b2 THEN 1 ELSE 2 END")} AS split_cumulative
  FROM (SELECT window_id, row_number() OVER (ORDER BY md5('7:' || window_id)) AS rn, floor(n_windows * 0.7::DOUBLE) AS a,
        floor(n_windows * 0.7::DOUBLE) + floor(n_windows * 0.1::DOUBLE) AS b1, floor(n_windows * 0.8::DOUBLE) AS b2 FROM win)""")
def _(spark, sf):
    table = _windows(spark, sf)
    first = T.split_random_windows(table, 7).select("window_id", "split")
    second = T.split_random_windows(table, 7, cumulative=True).select("window_id", F.col("split").alias("split_cumulative"))
    return first.join(second, "window_id")


@query("split_random_flows", f"""
  SELECT flow_id, {_code("CASE WHEN rn <= a THEN 0 WHEN rn <= a + b1 THEN 1 ELSE 2 END")} AS split, {_code("CASE WHEN rn <= a THEN 0 WHEN rn <= b2 THEN 1 ELSE 2 END")} AS split_cumulative
  FROM (SELECT flow_id, row_number() OVER (PARTITION BY target ORDER BY md5('42:' || flow_id)) AS rn, round_even(n * 0.7::DOUBLE, 0) AS a,
        round_even(n * 0.1::DOUBLE, 0) AS b1, round_even(n * 0.8::DOUBLE, 0) AS b2
        FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM lab))""")
def _(spark, sf):
    df = labelled(spark, sf).select("flow_id", "target")
    first = T.split_random_flows(df, 42).select("flow_id", "split")
    second = T.split_random_flows(df, 42, cumulative=True).select("flow_id", F.col("split").alias("split_cumulative"))
    return first.join(second, "flow_id")


_EVENT_WINDOWS = {
    "ewin": "SELECT *, CASE WHEN attack = 'error' THEN 1 ELSE 0 END AS target, CAST(floor((start_ms - (SELECT min(start_ms) FROM ev)) / 600000.0::DOUBLE) AS BIGINT) AS window_id FROM ev",
    "ekept": "SELECT * FROM ewin WHERE window_id IN (SELECT window_id FROM ewin GROUP BY window_id HAVING count(*) >= 2)",
    "egap": "SELECT window_id, (window_id - lag(window_id) OVER (ORDER BY window_id)) * 600 AS gap FROM (SELECT DISTINCT window_id FROM ekept)",
    "elimit": "SELECT coalesce(min(CASE WHEN gap > 3600 THEN window_id END), 1e18::DOUBLE) AS lim FROM egap",
}


def _events(spark, sf):
    df = W.assign_windows(V.flows_events(spark, sf), 600).withColumn("target", (F.col("attack") == "error").cast("int"))
    df = W.min_flows_filter(df)
    return df, W.window_table(df)


@query("split_session_flows", f"""
  SELECT flow_id, {_code("CASE WHEN window_id >= lim THEN 2 WHEN rn <= round_even(n * 0.125::DOUBLE, 0) THEN 1 ELSE 0 END")} AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY target, window_id >= lim ORDER BY md5('3:' || flow_id)) AS rn, count(*) OVER (PARTITION BY target, window_id >= lim) AS n
    FROM ekept, elimit)""", _EVENT_WINDOWS)
def _(spark, sf):
    df, table = _events(spark, sf)
    return T.split_session(df, table, 600, 0.125, seed=3).select("flow_id", "split")


@query("split_session_windows", f"""
  SELECT flow_id, {_code("CASE WHEN window_id >= lim THEN 2 WHEN rn <= round_even(n * 0.125::DOUBLE, 0) THEN 1 ELSE 0 END")} AS split FROM (SELECT * FROM ekept, elimit)
  JOIN (SELECT window_id, row_number() OVER (PARTITION BY has ORDER BY md5('3:' || window_id)) AS rn, count(*) OVER (PARTITION BY has) AS n FROM
        (SELECT window_id, max(target) AS has FROM ekept, elimit WHERE window_id < lim GROUP BY window_id)
        UNION ALL SELECT DISTINCT window_id, 0, 0 FROM ekept, elimit WHERE window_id >= lim) w USING (window_id)""", _EVENT_WINDOWS)
def _(spark, sf):
    df, table = _events(spark, sf)
    return T.split_session(df, table, 600, 0.125, seed=3, unit="windows").select("flow_id", "split")


@query("split_aligned", f"""
  SELECT w AS window_id, {_code("CASE WHEN w * 21600 >= (SELECT min(window_id) * 86400 FROM winsplit WHERE split = 2) THEN 2 WHEN w * 21600 >= (SELECT min(window_id) * 86400 FROM winsplit WHERE split = 1) THEN 1 ELSE 0 END")} AS split
  FROM (SELECT CAST(floor((start_ms - (SELECT min(start_ms) FROM flows)) / 21600000.0::DOUBLE) AS BIGINT) AS w FROM flows GROUP BY 1 HAVING count(*) >= 2)""")
def _(spark, sf):
    base = windowed(spark, sf)
    reference = T.split_chronological(W.window_ordinal(W.window_table(base)))
    other = W.window_table(W.rewindow(base, 21600))
    return T.split_aligned(other, 21600, reference, 86400).select("window_id", "split")


@query("sample_keep_attacks", f"""
  SELECT flow_id, target FROM (SELECT *, row_number() OVER (PARTITION BY target > 0 ORDER BY md5('11:' || flow_id)) AS rn FROM lab WHERE split = 0)
  WHERE target > 0 OR rn <= 20000 - (SELECT count(*) FROM lab WHERE split = 0 AND target > 0)""")
def _(spark, sf):
    train = labelled(spark, sf).where(F.col("split") == 0)
    return T.sample_keep_attacks(train, 20000, 11).select("flow_id", "target")


@query("mark_unused", f"""
  SELECT flow_id, {_code("CASE WHEN split = 0 AND target = 0 AND rn > 20000 - (SELECT count(*) FROM lab WHERE split = 0 AND target > 0) THEN 3 ELSE split END")} AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY split, target > 0 ORDER BY md5('11:' || flow_id)) AS rn FROM lab)""")
def _(spark, sf):
    return T.mark_unused(labelled(spark, sf), 20000, 11).select("flow_id", "split")


_CAPPED = {
    "cc": "SELECT target, count(*) AS n FROM lab WHERE split = 0 GROUP BY target",
    # Water filling: with the classes in ascending order, the cap is fixed at the first class that does not fit.
    "fill": """SELECT target, n, 12000 - (sum(n) OVER (ORDER BY n, target) - n) AS rem, count(*) OVER () - row_number() OVER (ORDER BY n, target) + 1 AS lft FROM cc""",
    "cap": "SELECT CASE WHEN (SELECT sum(n) FROM cc WHERE target > 0) <= 6000 THEN NULL ELSE coalesce((SELECT rem // lft FROM fill WHERE n * lft > rem ORDER BY n, target LIMIT 1), (SELECT max(n) FROM cc)) END AS c",
}


@query("sample_class_capped", """
  SELECT flow_id, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('5:' || flow_id)) AS rn FROM lab WHERE split = 0), cap
  WHERE CASE WHEN c IS NOT NULL THEN rn <= c ELSE target > 0 OR rn <= 12000 - (SELECT sum(n) FROM cc WHERE target > 0) END""", _CAPPED)
def _(spark, sf):
    train = labelled(spark, sf).where(F.col("split") == 0)
    return T.sample_class_capped(train, 12000, 5).select("flow_id", "target")


@query("split_summary", f"""
  SELECT {_code('split')} AS split, count(*) AS flows, {big('sum(label)')} AS attack_flows, count(DISTINCT window_id) AS windows, min(start_ms) AS start_ms, max(start_ms) AS end_ms
  FROM lab GROUP BY split""")
def _(spark, sf):
    return T.split_summary(labelled(spark, sf))


@query("class_counts_per_split", """
  SELECT attack, count(*) FILTER (split = 0) AS train, count(*) FILTER (split = 1) AS val, count(*) FILTER (split = 2) AS test FROM lab GROUP BY attack""")
def _(spark, sf):
    return T.class_counts_per_split(labelled(spark, sf))


@query("missing_classes", "SELECT attack FROM lab GROUP BY attack HAVING count(*) FILTER (split = 2 AND l_tax > 0.03 AND attack <> 'O-1') = 0")
def _(spark, sf):
    # Test flows without one class, so that the answer is not empty.
    df = labelled(spark, sf)
    in_test = (F.col("split") == 2) & (F.col("l_tax") > 0.03) & (F.col("attack") != "O-1")
    return T.missing_classes(df.withColumn("split", F.when(in_test, 2).otherwise(0)))


_SHARED = {
    "rnd": """SELECT flow_id, CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 0 ELSE 2 END AS split FROM
      (SELECT flow_id, row_number() OVER (PARTITION BY target ORDER BY md5('42:' || flow_id)) AS rn, count(*) OVER (PARTITION BY target) AS n FROM lab)""",
}


@query("shared_test", f"""
  SELECT count(*) AS flows, {big('sum(label)')} AS attacks, count(DISTINCT window_id) AS windows FROM lab JOIN rnd USING (flow_id) WHERE lab.split = 2 AND rnd.split = 2""", _SHARED)
def _(spark, sf):
    df = labelled(spark, sf)
    return T.shared_test_summary(df, T.split_random_flows(df.drop("split"), 42))


@query("class_counts_by_day", """
  SELECT strftime(make_timestamp(CAST(floor(start_ms / 86400000.0::DOUBLE) AS BIGINT) * 86400000000), '%Y-%m-%d') AS day, attack, count(*) AS flows FROM kept GROUP BY ALL""")
def _(spark, sf):
    from flowlens.plans.base import kept

    return T.class_counts_by_day(kept(spark, sf))
