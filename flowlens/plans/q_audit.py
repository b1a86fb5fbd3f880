"""Queries: audits and probes that are relational."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import audit as A
from flowlens.operators import context as X
from flowlens.operators import graph as G
from flowlens.operators import metrics as E
from flowlens.plans.base import N_CLASSES, kept, labelled, predictions, prepared, windowed
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query
from flowlens.sources import views as V


def _r(*columns):
    return [S.r6(F.col(c)).alias(c) for c in columns]


# The lineitem view draws classes at random, so every host attacks. The identity audits read the flows with
# labels that hang on the source: only these sources attack, and they do so in the later half of the windows too.
_BAD = ["10.0.3.1", "10.0.7.1", "8.8.10.1", "10.0.11.1"]
_IDENT = {
    "idn": f"""SELECT flow_id, window_id, src_ip, dst_ip, dst_port, start_ms, split,
      CASE WHEN src_ip IN ({', '.join(f"'{b}'" for b in _BAD)}) AND label = 1 AND NOT (src_ip = '10.0.11.1' AND split < 2) THEN 1 ELSE 0 END AS label,
      CASE WHEN src_ip IN ({', '.join(f"'{b}'" for b in _BAD)}) AND label = 1 AND NOT (src_ip = '10.0.11.1' AND split < 2) THEN target ELSE 0 END AS target,
      CASE WHEN src_ip IN ({', '.join(f"'{b}'" for b in _BAD)}) AND label = 1 AND NOT (src_ip = '10.0.11.1' AND split < 2) THEN attack ELSE 'Benign' END AS attack FROM lab""",
}


def _ident(spark, sf):
    df = labelled(spark, sf)
    bad = F.col("src_ip").isin(_BAD) & (F.col("label") == 1) & ~((F.col("src_ip") == "10.0.11.1") & (F.col("split") < 2))
    return df.select(
        "flow_id", "window_id", "src_ip", "dst_ip", "dst_port", "start_ms", "split", F.when(bad, 1).otherwise(0).alias("label"),
        F.when(bad, F.col("target")).otherwise(0).alias("target"), F.when(bad, F.col("attack")).otherwise(S.BENIGN).alias("attack"),
    )


@query("dataset_stats", f"""
  SELECT (SELECT count(*) FROM flows) AS flows_raw, count(*) AS flows_kept, (SELECT count(*) FROM flows) - count(*) AS flows_dropped, {r6('avg(label)')} AS attack_rate,
         (SELECT count(DISTINCT host) FROM hosts) AS unique_hosts, count(DISTINCT CASE WHEN label = 1 THEN src_ip END) AS attack_sources FROM kept""")
def _(spark, sf):
    out = A.dataset_stats(V.flows_lineitem(spark, sf), kept(spark, sf))
    return out.withColumn("attack_rate", S.r6(F.col("attack_rate")))


@query("top_k", f"SELECT src_ip, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM kept WHERE label = 1)')} AS share FROM kept WHERE label = 1 GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10")
def _(spark, sf):
    return A.top_k(kept(spark, sf).where(F.col("label") == 1), "src_ip").select("src_ip", "n", *_r("share"))


@query("keys_for_share", f"""
  SELECT count(*) FILTER (cum < 0.9 * total) + 1 AS n_keys FROM
  (SELECT sum(n) OVER (ORDER BY n DESC, src_ip) AS cum, sum(n) OVER () AS total FROM (SELECT src_ip, count(*) AS n FROM kept WHERE label = 1 GROUP BY src_ip))""")
def _(spark, sf):
    return A.keys_for_share(kept(spark, sf).where(F.col("label") == 1), "src_ip")


@query("host_overlap", f"""
  SELECT (SELECT count(*) FROM htr) AS hosts_train, (SELECT count(*) FROM hte) AS hosts_test, (SELECT count(*) FROM atr) AS attackers_train,
    (SELECT count(DISTINCT src_ip) FROM idn WHERE split = 2 AND label = 1) AS attackers_test,
    (SELECT count(DISTINCT src_ip) FROM idn WHERE split = 2 AND label = 1 AND src_ip NOT IN (SELECT h FROM atr)) AS attackers_new,
    {r6('(SELECT avg(CASE WHEN h IN (SELECT h FROM htr) THEN 1.0 ELSE 0 END) FROM hte)')} AS test_hosts_seen,
    {r6('avg(CASE WHEN src_ip IN (SELECT h FROM htr) THEN 1.0 ELSE 0 END)')} AS test_flows_src_seen,
    {r6('avg(CASE WHEN src_ip IN (SELECT h FROM htr) AND dst_ip IN (SELECT h FROM htr) THEN 1.0 ELSE 0 END)')} AS test_flows_both_seen,
    {r6('avg(CASE WHEN src_ip IN (SELECT h FROM atr) THEN 1.0 ELSE 0 END) FILTER (label = 1)')} AS test_attacks_from_known FROM idn WHERE split = 2""",
       {**_IDENT, "htr": "SELECT src_ip AS h FROM idn WHERE split = 0 UNION SELECT dst_ip FROM idn WHERE split = 0",
        "hte": "SELECT src_ip AS h FROM idn WHERE split = 2 UNION SELECT dst_ip FROM idn WHERE split = 2",
        "atr": "SELECT DISTINCT src_ip AS h FROM idn WHERE split = 0 AND label = 1"})
def _(spark, sf):
    out = A.host_overlap(_ident(spark, sf))
    return out.select("hosts_train", "hosts_test", "attackers_train", "attackers_test", "attackers_new", *_r("test_hosts_seen", "test_flows_src_seen", "test_flows_both_seen", "test_attacks_from_known"))


@query("dual_role_sources", "SELECT src_ip FROM idn GROUP BY src_ip HAVING max(label) = 1 AND min(label) = 0", _IDENT)
def _(spark, sf):
    return A.dual_role_sources(_ident(spark, sf))


_KEYS = {"src": ["src_ip"], "dst": ["dst_ip"], "port": ["dst_port"], "pair": ["src_ip", "dst_ip"], "pair+port": ["src_ip", "dst_ip", "dst_port"]}


def _probe_sql(seen_only: bool) -> tuple[str, dict]:
    parts = []
    for name, keys in _KEYS.items():
        on = ", ".join(keys)
        parts.append(f"""SELECT '{name}' AS probe, t.target AS y, coalesce(m.target, 0) AS p, CAST(m.target IS NOT NULL AS INT) AS seen FROM (SELECT * FROM idn WHERE split = 2) t LEFT JOIN
          (SELECT {on}, target FROM (SELECT {on}, target, row_number() OVER (PARTITION BY {on} ORDER BY count(*) DESC, target) AS rn FROM idn WHERE split = 0 GROUP BY {on}, target) WHERE rn = 1) m USING ({on})""")
    where = "WHERE seen = 1" if seen_only else ""
    extra = {
        **_IDENT, "asked": " UNION ALL ".join(parts), "scored_rows": f"SELECT * FROM asked {where}",
        "pcls": """SELECT probe, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT probe, y AS class, CAST(y = p AS INT) AS tp, 0 AS fp, CAST(y <> p AS INT) AS fn FROM scored_rows
          UNION ALL SELECT probe, p, 0, 1, 0 FROM scored_rows WHERE y <> p) GROUP BY ALL""",
    }
    body = f"""SELECT probe, {r6('any_value(m)')} AS macro_f1, {r6('2 * sum(CAST(y > 0 AND p > 0 AS INT)) / nullif(2 * sum(CAST(y > 0 AND p > 0 AS INT)) + sum(CAST((y > 0) <> (p > 0) AS INT)), 0)')} AS binary_f1,
      {r6('sum(CAST(y = 0 AND p > 0 AS INT)) / sum(CAST(y = 0 AS INT))')} AS false_positive_rate
      FROM scored_rows JOIN (SELECT probe, avg(2 * tp / (2 * tp + fp + fn)) FILTER (tp + fn > 0) AS m FROM pcls GROUP BY probe) USING (probe) GROUP BY probe"""
    if seen_only:
        body = f"""SELECT x.*, n_flows, share_of_test, share_of_attacks FROM ({body}) x JOIN (SELECT probe, {big('sum(seen)')} AS n_flows, {r6('avg(seen)')} AS share_of_test,
          {r6('avg(seen) FILTER (y > 0)')} AS share_of_attacks FROM asked GROUP BY probe) USING (probe)"""
    return body, extra


@query("identity_probe", *_probe_sql(False))
def _(spark, sf):
    out = A.identity_probe(_ident(spark, sf), _KEYS)
    return out.select("probe", *_r("macro_f1"), *[S.r6(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ("binary_f1", "false_positive_rate")])


@query("identity_probe_seen", *_probe_sql(True))
def _(spark, sf):
    out = A.identity_probe(_ident(spark, sf), _KEYS, seen_only=True)
    return out.select("probe", "n_flows", *_r("macro_f1", "binary_f1", "false_positive_rate", "share_of_test", "share_of_attacks"))


_INNER = ["10.0.1.1", "10.0.2.1"], ["10.0.12.1", "8.8.15.1"]


@query("set_flow_counts", f"""
  SELECT count(*) FILTER (dst_ip IN (SELECT d FROM vic)) AS benign_to_victims, count(*) FILTER (dst_ip IN (SELECT s FROM att)) AS benign_to_attackers,
    count(*) FILTER (src_ip IN (SELECT s FROM att)) AS benign_from_attackers, count(*) FILTER (src_ip IN (SELECT d FROM vic) AND dst_ip IN (SELECT s FROM att)) AS benign_victim_to_attacker,
    {r6("avg(CASE WHEN (src_ip IN ('10.0.1.1', '10.0.2.1') AND dst_ip IN ('10.0.12.1', '8.8.15.1')) OR (dst_ip IN ('10.0.1.1', '10.0.2.1') AND src_ip IN ('10.0.12.1', '8.8.15.1')) THEN 1.0 ELSE 0 END)")} AS core_share
  FROM idn WHERE label = 0""", {**_IDENT, "vic": "SELECT DISTINCT dst_ip AS d FROM idn WHERE label = 1", "att": "SELECT DISTINCT src_ip AS s FROM idn WHERE label = 1"})
def _(spark, sf):
    out = A.set_flow_counts(_ident(spark, sf), *_INNER)
    return out.select("benign_to_victims", "benign_to_attackers", "benign_from_attackers", "benign_victim_to_attacker", *_r("core_share"))


@query("per_source_class_range", """
  SELECT attack, min(coalesce(n, 0)) AS least, max(coalesce(n, 0)) AS most FROM (SELECT DISTINCT src_ip FROM idn WHERE label = 1) CROSS JOIN (SELECT DISTINCT attack FROM idn WHERE label = 1)
  LEFT JOIN (SELECT src_ip, attack, count(*) AS n FROM idn WHERE label = 1 GROUP BY ALL) USING (src_ip, attack) GROUP BY attack""", _IDENT)
def _(spark, sf):
    return A.per_source_class_range(_ident(spark, sf)).select("attack", F.col("least").cast("bigint").alias("least"), "most")


@query("value_share", f"SELECT label, protocol, {r6('count(*) / sum(count(*)) OVER (PARTITION BY label)')} AS share FROM kept GROUP BY label, protocol")
def _(spark, sf):
    return A.value_share(kept(spark, sf), "protocol").select("label", "protocol", *_r("share"))


_EVS = {"evs": "SELECT *, CASE WHEN CAST(flow_id AS BIGINT) % 10 < 7 THEN 0 ELSE 2 END AS split, CAST(floor(start_ms / 60000) AS BIGINT) % 1440 AS minute FROM ev"}


@query("clock_overlap", f"SELECT {r6('avg(CASE WHEN minute IN (SELECT minute FROM evs WHERE split = 0) THEN 1.0 ELSE 0 END)')} AS share FROM evs WHERE split = 2", _EVS)
def _(spark, sf):
    f = V.flows_events(spark, sf).withColumn("split", F.when(F.col("flow_id").cast("bigint") % 10 < 7, 0).otherwise(2))
    return A.clock_overlap(f).select(*_r("share"))


_NODES = {
    **_IDENT,
    "nd": """SELECT h.window_id, h.host, ln(1 + flows_out) AS out_degree, coalesce(entropy, 0) AS dst_port_entropy, flows_in + flows_out AS degree,
      CASE WHEN h.host IN (SELECT src_ip FROM idn WHERE label = 1) THEN 1 ELSE 0 END AS is_attacker, split,
      ln(1 + h.window_id - min(h.window_id) OVER (PARTITION BY h.host)) AS log_age_windows
      FROM hosts h LEFT JOIN portstat p ON p.window_id = h.window_id AND p.host = h.host JOIN winsplit w ON w.window_id = h.window_id""",
}


def _nodes(spark, sf):
    """Host-windows with a few context columns, the split of their window and whether the host attacks."""
    from flowlens.operators import history as H

    def build():
        df = labelled(spark, sf)
        hosts = G.host_counts(G.endpoints(G.pair_table(df)))
        table = hosts.join(X.port_stats(G.port_counts(df)), G.NODE, "left")
        splits = df.select("window_id", "split").distinct()
        bad = A.attack_sources(_ident(spark, sf)).withColumn("is_attacker", F.lit(1))
        table = H.host_age(table).join(splits, "window_id").join(bad, "host", "left")
        return table.select(
            "window_id", "host", F.log1p("flows_out").alias("out_degree"), F.coalesce("dst_port_entropy", F.lit(0.0)).alias("dst_port_entropy"),
            (F.col("flows_in") + F.col("flows_out")).alias("degree"), F.coalesce("is_attacker", F.lit(0)).alias("is_attacker"), "split", "log_age_windows",
        )

    return prepared(spark, sf, "nodes", build)


@query("percentile_band_share", f"""
  SELECT {r6('avg(inside) FILTER (is_attacker = 1)')} AS band_attackers, {r6('avg(inside) FILTER (is_attacker = 0)')} AS band_others, {big('coalesce(sum(inside) FILTER (is_attacker = 0), 0)')} AS band_others_n
  FROM (SELECT is_attacker, CASE WHEN round(out_degree, 9) BETWEEN lo1 AND hi1 AND round(dst_port_entropy, 9) BETWEEN lo2 AND hi2 THEN 1.0 ELSE 0 END AS inside FROM nd,
    (SELECT quantile_cont(round(out_degree, 9), 0.05) AS lo1, quantile_cont(round(out_degree, 9), 0.95) AS hi1, quantile_cont(round(dst_port_entropy, 9), 0.05) AS lo2, quantile_cont(round(dst_port_entropy, 9), 0.95) AS hi2 FROM nd WHERE is_attacker = 1))""", _NODES)
def _(spark, sf):
    nodes = _nodes(spark, sf).withColumns({c: F.round(c, 9) for c in ("out_degree", "dst_port_entropy")})
    out = A.percentile_band_share(nodes, ["out_degree", "dst_port_entropy"])
    return out.select(*_r("band_attackers", "band_others"), F.col("band_others_n").cast("bigint").alias("band_others_n"))


@query("context_shares", f"""
  SELECT count(*) AS host_windows, {r6('avg(CASE WHEN peer_novelty = 0 THEN 1.0 ELSE 0 END)')} AS novelty_zero_share, count(*) FILTER (is_first_seen > 0.5) AS first_seen,
    {r6('max(log_age_windows)')} AS max_log_age, count(DISTINCT CASE WHEN is_private > 0.5 THEN host END) AS private_hosts FROM ctx""")
def _(spark, sf):
    out = A.context_shares(X.host_context(kept(spark, sf), structural=False))
    return out.select("host_windows", "first_seen", "private_hosts", *_r("novelty_zero_share", "max_log_age"))


@query("reply_share", f"""
  SELECT model, seed, count(*) AS n_flows, {r6('avg(CASE WHEN y_pred <> 0 THEN 1.0 ELSE 0 END)')} AS share, CAST(avg(CASE WHEN y_pred <> 0 THEN 1.0 ELSE 0 END) > 0.5 AS INTEGER) AS flagged
  FROM pred WHERE y_true = 0 AND dst_ip IN (SELECT src_ip FROM idn WHERE label = 1) GROUP BY model, seed""", _IDENT)
def _(spark, sf):
    out = A.reply_share(predictions(spark, sf), A.attack_sources(_ident(spark, sf)))
    return out.select("model", "seed", "n_flows", *_r("share"), "flagged")


@query("range_shift", f"""
  SELECT CAST(is_attacker AS INTEGER) AS is_attacker, CAST(split AS INTEGER) AS split, {r6('quantile_cont(log_age_windows, 0.01)')} AS p1, {r6('quantile_cont(log_age_windows, 0.99)')} AS p99, {r6('max(log_age_windows)')} AS largest,
    {r6('avg(CASE WHEN log_age_windows > top THEN 1.0 ELSE 0 END)')} AS above_train_max FROM nd JOIN (SELECT is_attacker, max(log_age_windows) AS top FROM nd WHERE split = 0 GROUP BY is_attacker) USING (is_attacker)
  GROUP BY is_attacker, split""", _NODES)
def _(spark, sf):
    out = A.range_shift(_nodes(spark, sf), "log_age_windows", ["is_attacker"])
    return out.select("is_attacker", "split", *_r("p1", "p99", "largest", "above_train_max"))


@query("leak_alarm", f"SELECT model, seed, {r6('macro_f1')} AS macro_f1 FROM runmacro WHERE macro_f1 > 0.2")
def _(spark, sf):
    prf = E.per_class_prf(E.class_counts(predictions(spark, sf)), N_CLASSES)
    # The scores are synthetic, so the alarm is set where some runs pass it and some do not.
    return A.leak_alarm(E.macro_f1(prf), 0.2).select("model", "seed", *_r("macro_f1"))


_EDGES = [1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 22.0, 32.0, 46.0, 68.0, 100.0]


@query("binned_profile", f"""
  SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {r6('quantile_cont(degree, 0.5)')} AS median_x, {r6('avg(dst_port_entropy)')} AS mean_y FROM
  (SELECT *, {' + '.join(f'CAST(degree >= {e} AS INT)' for e in _EDGES)} AS bin FROM nd) GROUP BY bin HAVING count(*) >= 20""", _NODES)
def _(spark, sf):
    return A.binned_profile(_nodes(spark, sf), "degree", "dst_port_entropy", _EDGES).select("bin", "n", *_r("median_x", "mean_y"))


@query("density_histogram", f"""
  SELECT CAST(is_attacker AS INTEGER) AS is_attacker, bin, n, {r6('n / (sum(n) OVER (PARTITION BY is_attacker) * w)')} AS density FROM
  (SELECT is_attacker, {big('least(floor((x - lo) / w), 38)')} AS bin, count(*) AS n, any_value(w) AS w FROM (SELECT is_attacker, CAST(degree AS DOUBLE) AS x, lo, hi, (hi - lo) / 39 AS w FROM nd,
    (SELECT quantile_cont(CAST(degree AS DOUBLE), 0.005) AS lo, quantile_cont(CAST(degree AS DOUBLE), 0.995) AS hi FROM nd)) WHERE x BETWEEN lo AND hi GROUP BY ALL)""", _NODES)
def _(spark, sf):
    return A.density_histogram(_nodes(spark, sf), "degree", "is_attacker").select("is_attacker", "bin", "n", *_r("density"))


_SPEAR = {
    **_NODES,
    "gate": """SELECT m AS model, degree, ('0x' || substr(md5(m || ':' || window_id || ':' || host), 1, 2))::BIGINT / 256.0::DOUBLE + CASE WHEN m = 'forest' THEN 0.02::DOUBLE * degree ELSE 0 END AS g
      FROM nd, (VALUES ('forest'), ('boost')) v(m)""",
}


@query("spearman", f"""
  SELECT model, {r6('corr(rx, ry)')} AS rho, {r6('avg(g) FILTER (degree <= 10)')} AS mean_low, {r6('avg(g) FILTER (degree >= 100)')} AS mean_high FROM
  (SELECT *, rank() OVER (PARTITION BY model ORDER BY degree) + (count(*) OVER (PARTITION BY model, degree) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY model ORDER BY g) + (count(*) OVER (PARTITION BY model, g) - 1) / 2.0 AS ry FROM gate) GROUP BY model""", _SPEAR)
def _(spark, sf):
    nodes = _nodes(spark, sf).select("window_id", "host", "degree", F.explode(F.array(F.lit("forest"), F.lit("boost"))).alias("model"))
    digest = F.md5(F.concat_ws(":", "model", F.col("window_id").cast("string"), "host"))
    gate = S.hash_int(digest, 1, 2) / 256.0 + F.when(F.col("model") == "forest", 0.02 * F.col("degree")).otherwise(0.0)
    return A.spearman(nodes.withColumn("g", gate), "degree", "g", ["model"]).select("model", *_r("rho", "mean_low", "mean_high"))


@query("shuffled_context", f"""
  SELECT r.flow_id, {r6('g.l_tax')} AS l_tax, {r6('g.in_bytes')} AS in_bytes FROM (SELECT flow_id, row_number() OVER (ORDER BY md5('0:' || flow_id)) AS k FROM kept) r
  JOIN (SELECT l_tax, in_bytes, row_number() OVER (ORDER BY md5('9:' || flow_id)) AS k FROM kept) g USING (k)""")
def _(spark, sf):
    df = kept(spark, sf).select("flow_id", "l_tax", "in_bytes")
    return A.permuted_rows(df, "flow_id", ["l_tax", "in_bytes"], 9).select("flow_id", *_r("l_tax", "in_bytes"))
