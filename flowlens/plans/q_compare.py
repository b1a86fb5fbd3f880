"""Queries: bootstrap comparison and seed statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import compare as C
from flowlens.operators import metrics as E
from flowlens.operators import splits as T
from flowlens.plans.base import N_CLASSES, labelled, predictions
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query

N_BOOT = 2000
PAIRS = {"forest-boost": [("forest", 1), ("boost", -1)], "boost-plain": [("boost", 1), ("plain", -1)]}
NESTED = {**PAIRS, "change": [("forest", 1), ("boost", -1), ("boost", -1), ("plain", 1)]}


def _r(*columns):
    return [S.r6(F.col(c)).alias(c) for c in columns]


def _rows(comparisons) -> str:
    return ", ".join(f"('{n}', {i}, '{m}', {c}::DOUBLE)" for n, parts in comparisons.items() for i, (m, c) in enumerate(parts))


_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END"
_BOOT = {
    "ppos": "SELECT *, dense_rank() OVER (ORDER BY window_id) - 1 AS p FROM pred",
    "pn": "SELECT count(DISTINCT window_id) AS n FROM pred",
    "wcount": """SELECT model, seed, window_id, p, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
      SELECT model, seed, window_id, p, y_true AS class, CAST(y_true = y_pred AS INT) AS tp, 0 AS fp, CAST(y_true <> y_pred AS INT) AS fn FROM ppos
      UNION ALL SELECT model, seed, window_id, p, y_pred, 0, 1, 0 FROM ppos WHERE y_true <> y_pred) GROUP BY ALL""",
    "samp": f"""SELECT rep, start + o AS p, count(*) AS mult FROM (
      SELECT rep, j, o, n, ('0x' || substr(md5('0:' || rep || ':' || j), 1, 8))::BIGINT % greatest(n - 9, 1) AS start
      FROM pn, range({N_BOOT}) a(rep), range(100000) b(j), range(10) c(o) WHERE j < ceil(n / 10.0) AND j * 10 + o < n) WHERE start + o < n GROUP BY ALL""",
    "repf": f"""SELECT rep, model, seed, avg(f1) FILTER (tp + fn > 0) AS fa, avg(f1) FILTER (tp + fn > 0 AND class > 0) AS fx FROM
      (SELECT *, {_F1} AS f1 FROM (SELECT rep, model, seed, class, sum(mult * tp) AS tp, sum(mult * fp) AS fp, sum(mult * fn) AS fn FROM samp JOIN wcount USING (p) GROUP BY ALL)) GROUP BY ALL""",
    "repm": "SELECT rep, model, seed, 'all' AS metric, fa AS f FROM repf UNION ALL SELECT rep, model, seed, 'attacks', fx FROM repf",
    "fullm": "SELECT model, seed, 'all' AS metric, macro_f1 AS f FROM runmacro UNION ALL SELECT model, seed, 'attacks', macro_f1_attacks FROM runmacro",
    "comp": f"SELECT * FROM (VALUES {_rows(NESTED)}) v(comparison, part, model, coef)",
    "seedix": "SELECT model, seed, row_number() OVER (PARTITION BY model ORDER BY seed) - 1 AS ix, count(*) OVER (PARTITION BY model) AS ns FROM (SELECT DISTINCT model, seed FROM pred)",
    "picks": f"""SELECT comparison, part, model, coef, rep, i, ('0x' || substr(md5('pick0:' || comparison || ':' || part || ':' || rep || ':' || i), 1, 8))::BIGINT % ns AS ix
      FROM comp JOIN (SELECT DISTINCT model, ns FROM seedix) USING (model), range({N_BOOT}) a(rep), range(1000) b(i) WHERE i < ns""",
    "pointm": "SELECT comparison, metric, sum(coef * f) AS delta FROM comp JOIN (SELECT model, metric, avg(f) AS f FROM fullm GROUP BY ALL) USING (model) GROUP BY ALL",
    "winrep": "SELECT comparison, metric, rep, sum(coef * f) AS w FROM comp JOIN (SELECT rep, model, metric, avg(f) AS f FROM repm GROUP BY ALL) USING (model) GROUP BY ALL",
    "partrep": """SELECT comparison, metric, rep, part, coef, avg(r.f) AS two, avg(u.f) AS so, median(r.f) AS med,
        list_avg(list_slice(list_sort(list(r.f)), CAST(floor(count(*) * 0.2) AS BIGINT) + 1, CAST(count(*) - floor(count(*) * 0.2) AS BIGINT))) AS trim
      FROM picks JOIN seedix USING (model, ix) JOIN repm r USING (rep, model, seed) JOIN fullm u USING (model, seed, metric) GROUP BY ALL""",
    "tworep": "SELECT comparison, metric, rep, sum(coef * two) AS two, sum(coef * so) AS so, sum(coef * med) AS med, sum(coef * trim) AS trim FROM partrep GROUP BY ALL",
}


@query("window_counts", f"SELECT model, seed, window_id, class, {big('tp')} AS tp, {big('fp')} AS fp, {big('fn')} AS fn FROM wcount", _BOOT)
def _(spark, sf):
    return C.window_counts(predictions(spark, sf)).select("model", "seed", "window_id", "class", "tp", "fp", "fn")


@query("block_samples", f"SELECT {big('rep')} AS replicate, {big('p')} AS pos, mult AS multiplicity FROM samp", _BOOT)
def _(spark, sf):
    n = predictions(spark, sf).select("window_id").distinct().count()
    return C.sampled_windows(C.block_samples(spark, n, N_BOOT))


def _iv(col: str, level: str, name: str) -> str:
    return f"{r6(f'quantile_cont({col}, (1 - {level}) / 2)')} AS {name}_lo, {r6(f'quantile_cont({col}, 1 - (1 - {level}) / 2)')} AS {name}_hi"


@query("paired_bootstrap", f"""
  SELECT comparison, metric, {r6('any_value(delta)')} AS delta, {_iv('w', '0.95', 'window')}, {r6('avg(CASE WHEN w <= 0 THEN 1.0 ELSE 0 END)')} AS p_le_0
  FROM winrep JOIN pointm USING (comparison, metric) WHERE comparison <> 'change' GROUP BY ALL""", _BOOT)
def _(spark, sf):
    out = C.paired_bootstrap(predictions(spark, sf), PAIRS, N_BOOT)
    return out.select("comparison", "metric", *_r("delta", "window_lo", "window_hi", "p_le_0"))


@query("contrast", f"""
  SELECT comparison, metric, {r6('any_value(delta)')} AS delta, {_iv('two', '0.95', 'two')}, {_iv('two', '0.9', 'two90')}, {_iv('two', '(1 - 0.05::DOUBLE / 3)', 'bonferroni')},
    {_iv('w', '0.95', 'window')}, {_iv('so', '0.95', 'seed')}, {r6('stddev_samp(two)')} AS two_sd, {r6('avg(CASE WHEN two <= 0 THEN 1.0 ELSE 0 END)')} AS p_le_0
  FROM tworep JOIN winrep USING (comparison, metric, rep) JOIN pointm USING (comparison, metric) GROUP BY comparison, metric""", _BOOT)
def _(spark, sf):
    out = C.contrast(predictions(spark, sf), NESTED, N_BOOT)
    return out.select("comparison", "metric", *_r(*[c for c in out.columns if c not in ("comparison", "metric")]))


@query("contrast_robust", f"SELECT comparison, metric, {_iv('med', '0.95', 'median')}, {_iv('trim', '0.95', 'trim20')} FROM tworep GROUP BY comparison, metric", _BOOT)
def _(spark, sf):
    out = C.contrast(predictions(spark, sf), NESTED, N_BOOT, robust=True)
    return out.select("comparison", "metric", *_r("median_lo", "median_hi", "trim20_lo", "trim20_hi"))


@query("mde_equivalence", f"""
  SELECT comparison, metric, {r6('2.801585218112969::DOUBLE * stddev_samp(two)')} AS mde, CAST(quantile_cont(two, 0.05) > -0.02 AND quantile_cont(two, 0.95) < 0.02 AS INTEGER) AS equivalent
  FROM tworep GROUP BY comparison, metric""", _BOOT)
def _(spark, sf):
    return C.detectable(C.contrast(predictions(spark, sf), NESTED, N_BOOT)).select("comparison", "metric", *_r("mde"), "equivalent")


@query("holm", f"""
  SELECT comparison, metric, {r6('p')} AS p, {r6('max(raw) OVER (PARTITION BY metric ORDER BY p, comparison)')} AS p_holm FROM
  (SELECT *, least(1.0, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p, comparison) + 1) * p) AS raw FROM
    (SELECT comparison, metric, least(1.0, 2 * least(q, 1 - q)) AS p FROM (SELECT comparison, metric, avg(CASE WHEN two <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS q FROM tworep GROUP BY ALL)))""", _BOOT)
def _(spark, sf):
    p = C.contrast(predictions(spark, sf), NESTED, N_BOOT).select("comparison", "metric", C.two_sided(F.col("p_le_0")).alias("p"))
    return C.holm(p, "metric").select("comparison", "metric", *_r("p", "p_holm"))


# Run (plain, 2) lacks the flows of class 3, and half of them stand a second time in run (plain, 1).
@query("same_rows_guard", """
  SELECT count(*) AS flows, (SELECT count(*) FROM (SELECT DISTINCT model, seed FROM pred)) AS runs,
    count(*) FILTER (t <> (SELECT count(*) FROM (SELECT DISTINCT model, seed FROM pred)) OR r <> (SELECT count(*) FROM (SELECT DISTINCT model, seed FROM pred))) AS mismatched
  FROM (SELECT flow_id, count(*) AS t, count(DISTINCT model || ':' || seed) AS r FROM (
    SELECT model, seed, flow_id FROM pred WHERE NOT (model = 'plain' AND seed = 2 AND y_true = 3)
    UNION ALL SELECT model, seed, flow_id FROM pred WHERE model = 'plain' AND seed = 1 AND y_true = 3 AND flow_id < '8') GROUP BY flow_id)""")
def _(spark, sf):
    pred = predictions(spark, sf)
    lacking = (F.col("model") == "plain") & (F.col("seed") == 2) & (F.col("y_true") == 3)
    again = (F.col("model") == "plain") & (F.col("seed") == 1) & (F.col("y_true") == 3) & (F.col("flow_id") < "8")
    return C.same_rows(pred.where(~lacking).unionByName(pred.where(again)))


_SIDES = {"sd": """SELECT c AS comparison, s AS side, seed, macro_f1 AS value FROM runmacro JOIN (VALUES ('forest-boost', 'a', 'forest'), ('forest-boost', 'b', 'boost'),
  ('boost-plain', 'a', 'boost'), ('boost-plain', 'b', 'plain')) v(c, s, model) USING (model)"""}
_TWO = {"forest-boost": ("forest", "boost"), "boost-plain": ("boost", "plain")}


def _runs(pred):
    prf = E.per_class_prf(E.class_counts(pred), N_CLASSES)
    return E.macro_f1(prf).withColumnRenamed("macro_f1", "value")


def _sides(spark, sf):
    return C.sides(_runs(predictions(spark, sf)), _TWO)


_AB = """SELECT comparison, avg(value) FILTER (side = 'a') AS ma, avg(value) FILTER (side = 'b') AS mb, var_samp(value) FILTER (side = 'a') AS va, var_samp(value) FILTER (side = 'b') AS vb,
  count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM sd GROUP BY comparison"""


@query("welch", f"""
  SELECT comparison, {r6('ma - mb')} AS difference, {r6('sqrt(va / na + vb / nb)')} AS se,
    {r6('(va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))')} AS df FROM ({_AB})""", _SIDES)
def _(spark, sf):
    return C.welch(_sides(spark, sf)).select("comparison", *_r("difference", "se", "df"))


@query("hodges_lehmann", f"""
  SELECT comparison, {r6('median(d)')} AS shift, {r6('list_sort(list(d))[1 + k]')} AS lo, {r6('list_sort(list(d))[count(*) - k]')} AS hi, {r6('avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0 END)')} AS p_superior FROM
  (SELECT a.comparison, a.value - b.value AS d, CAST(greatest(floor(na * nb / 2.0 - 1.959963984540054 * sqrt(na * nb * (na + nb + 1) / 12.0)), 0) AS BIGINT) AS k
   FROM sd a JOIN sd b ON a.comparison = b.comparison AND a.side = 'a' AND b.side = 'b' JOIN ({_AB}) n ON n.comparison = a.comparison) GROUP BY comparison, k""", _SIDES)
def _(spark, sf):
    return C.hodges_lehmann(_sides(spark, sf)).select("comparison", *_r("shift", "lo", "hi", "p_superior"))


@query("variance_ratio", f"""
  SELECT comparison, {r6('va / vb')} AS var_ratio, {r6('sqrt(va)')} AS sd_a, {r6('sqrt(vb)')} AS sd_b, {r6('w')} AS brown_forsythe FROM ({_AB}) JOIN
  (SELECT comparison, (sum(n) - 2) * sum(n * (m - g) ** 2) / sum(n * v) AS w FROM (SELECT *, sum(n * m) OVER (PARTITION BY comparison) / sum(n) OVER (PARTITION BY comparison) AS g FROM
    (SELECT comparison, side, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM (SELECT comparison, side, abs(value - median(value) OVER (PARTITION BY comparison, side)) AS z FROM sd) GROUP BY ALL)) GROUP BY comparison) USING (comparison)""", _SIDES)
def _(spark, sf):
    return C.variance_ratio(_sides(spark, sf)).select("comparison", *_r("var_ratio", "sd_a", "sd_b", "brown_forsythe"))


_SHARED = {
    **_SIDES,
    "rnd": """SELECT flow_id, CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 0 ELSE 2 END AS split FROM
      (SELECT flow_id, row_number() OVER (PARTITION BY target ORDER BY md5('42:' || flow_id)) AS rn, count(*) OVER (PARTITION BY target) AS n FROM lab)""",
    "shp": "SELECT * FROM pred WHERE flow_id IN (SELECT flow_id FROM rnd WHERE split = 2)",
    "shc": """SELECT model, seed, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT model, seed, y_true AS class, CAST(y_true = y_pred AS INT) AS tp, 0 AS fp, CAST(y_true <> y_pred AS INT) AS fn FROM shp
      UNION ALL SELECT model, seed, y_pred, 0, 1, 0 FROM shp WHERE y_true <> y_pred) GROUP BY ALL""",
    "shm": f"SELECT model, avg(m) AS m FROM (SELECT model, seed, avg({_F1}) FILTER (tp + fn > 0) AS m FROM shc GROUP BY ALL) GROUP BY model",
}


@query("gap_share", f"""
  SELECT comparison, {r6('gap')} AS gap, {r6('same')} AS same, {r6('CASE WHEN gap > 0 THEN same / gap END')} AS share FROM
  (SELECT comparison, ma - mb AS gap, x.m - y.m AS same FROM ({_AB}) JOIN shm x ON x.model = split_part(comparison, '-', 1) JOIN shm y ON y.model = split_part(comparison, '-', 2))""", _SHARED)
def _(spark, sf):
    pred = predictions(spark, sf)
    other = T.split_random_flows(labelled(spark, sf).select("flow_id", "target"), 42)
    shared = pred.join(other.where(F.col("split") == 2).select("flow_id"), "flow_id", "left_semi")
    return C.gap_share(_sides(spark, sf), C.sides(_runs(shared), _TWO)).select("comparison", *_r("gap", "same", "share"))


@query("gap_change", f"""
  SELECT 'change' AS comparison, {r6('c')} AS change, {r6('s')} AS se, {r6('c - 1.96 * s')} AS lo, {r6('c + 1.96 * s')} AS hi FROM
  (SELECT sum(coef * m) AS c, sqrt(sum(coef * coef * q)) AS s FROM (SELECT model, avg(macro_f1) AS m, var_samp(macro_f1) / count(*) AS q FROM runmacro GROUP BY model)
   JOIN comp USING (model) WHERE comparison = 'change')""", _BOOT)
def _(spark, sf):
    out = C.gap_change(_runs(predictions(spark, sf)), {"change": NESTED["change"]})
    return out.select("comparison", *_r("change", "se", "lo", "hi"))


@query("failure_rates", f"""
  SELECT model, count(*) FILTER (s > 0.35) AS failed, count(*) AS runs, {r6('avg(CASE WHEN s > 0.35 THEN 1.0 ELSE 0 END)')} AS rate FROM
  (SELECT model, seed, avg(CASE WHEN y_pred <> 0 THEN 1.0 ELSE 0 END) AS s FROM pred WHERE y_true = 0 GROUP BY ALL) GROUP BY model""")
def _(spark, sf):
    calm = predictions(spark, sf).where(F.col("y_true") == 0).groupBy("model", "seed").agg(F.avg((F.col("y_pred") != 0).cast("double")).alias("s"))
    flags = calm.withColumn("flagged", (F.col("s") > 0.35).cast("int"))
    return C.failure_rates(flags).select("model", "failed", "runs", *_r("rate"))
