"""Queries: scoring metrics on the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import metrics as E
from flowlens.plans.base import N_CLASSES, labelled, predictions
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query


def _prf(spark, sf):
    return E.per_class_prf(E.class_counts(predictions(spark, sf)), N_CLASSES)


def _r(*columns):
    return [S.r6(F.col(c)).alias(c) for c in columns]


@query("confusion", f"""
  SELECT model, seed, t.target AS y_true, p.target AS y_pred, {big('count(flow_id)')} AS n FROM (SELECT DISTINCT model, seed FROM pred) r CROSS JOIN cls t CROSS JOIN cls p
  LEFT JOIN pred x ON x.model = r.model AND x.seed = r.seed AND x.y_true = t.target AND x.y_pred = p.target GROUP BY r.model, r.seed, t.target, p.target""".replace(
    "SELECT model, seed, t.target", "SELECT r.model, r.seed, t.target"))
def _(spark, sf):
    return E.confusion(predictions(spark, sf), N_CLASSES)


@query("confusion_percent", f"""
  SELECT model, y_true, y_pred, {r6('avg(100.0 * n / t)')} AS percent FROM
  (SELECT *, sum(n) OVER (PARTITION BY model, seed, y_true) AS t FROM (SELECT s.model, s.seed, s.y_true, s.target AS y_pred, count(flow_id) AS n FROM
    (SELECT * FROM (SELECT DISTINCT model, seed, y_true FROM pred) CROSS JOIN cls) s LEFT JOIN pred x ON x.model = s.model AND x.seed = s.seed AND x.y_true = s.y_true AND x.y_pred = s.target
    GROUP BY ALL)) GROUP BY model, y_true, y_pred""")
def _(spark, sf):
    return E.confusion_percent(E.confusion(predictions(spark, sf), N_CLASSES)).select("model", "y_true", "y_pred", *_r("percent"))


@query("per_class_prf", f"""
  SELECT model, seed, class, {big('tp')} AS tp, {big('fp')} AS fp, {big('fn')} AS fn, {big('support')} AS support, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM prf""")
def _(spark, sf):
    return _prf(spark, sf).select("model", "seed", "class", "tp", "fp", "fn", "support", *_r("precision", "recall", "f1"))


@query("macro_f1", f"SELECT model, seed, {r6('avg(f1) FILTER (support > 0)')} AS macro_f1, {r6('avg(f1) FILTER (support > 0 AND class IN (0, 2, 4))')} AS macro_f1_kept FROM prf GROUP BY ALL")
def _(spark, sf):
    prf = _prf(spark, sf)
    kept = E.macro_f1(prf, keep=[0, 2, 4]).withColumnRenamed("macro_f1", "macro_f1_kept")
    return E.macro_f1(prf).join(kept, E.RUN).select("model", "seed", *_r("macro_f1", "macro_f1_kept"))


SUMMARY = {
    "macro_f1": "avg(f1) FILTER (support > 0)", "macro_f1_attacks": "avg(f1) FILTER (support > 0 AND class > 0)",
    "weighted_f1": "sum(f1 * support) / sum(support)", "accuracy": "sum(tp) / sum(support)",
}


@query("summary_metrics", f"SELECT model, seed, {', '.join(f'{r6(v)} AS {k}' for k, v in SUMMARY.items())} FROM prf GROUP BY ALL")
def _(spark, sf):
    return E.summary_metrics(_prf(spark, sf)).select("model", "seed", *_r(*SUMMARY))


@query("balanced_accuracy", f"SELECT model, seed, {r6('avg(recall) FILTER (support > 0)')} AS balanced_accuracy FROM prf GROUP BY ALL")
def _(spark, sf):
    return E.summary_metrics(_prf(spark, sf)).select("model", "seed", *_r("balanced_accuracy"))


BINARY = """SELECT model, seed, sum(CAST(y_true > 0 AND y_pred > 0 AS INT)) AS tp, sum(CAST(y_true = 0 AND y_pred > 0 AS INT)) AS fp,
  sum(CAST(y_true > 0 AND y_pred = 0 AS INT)) AS fn, sum(CAST(y_true = 0 AND y_pred = 0 AS INT)) AS tn FROM pred GROUP BY ALL"""


@query("binary_metrics", f"""
  SELECT model, seed, {r6('2 * tp / (2 * tp + fp + fn)')} AS binary_f1, {r6('tp / (tp + fp)')} AS binary_precision, {r6('tp / (tp + fn)')} AS detection_rate,
         {r6('fp / (fp + tn)')} AS false_positive_rate FROM ({BINARY})""")
def _(spark, sf):
    return E.binary_metrics(predictions(spark, sf)).select("model", "seed", *_r("binary_f1", "binary_precision", "detection_rate", "false_positive_rate"))


@query("average_precision", f"""
  SELECT model, seed, {r6('sum(pos * cp / cn) / sum(pos)')} AS pr_auc FROM
  (SELECT model, seed, pos, sum(pos) OVER w AS cp, sum(n)  OVER w AS cn FROM
   (SELECT model, seed, 1 - scores[1] AS s, sum(CAST(y_true > 0 AS INT))::DOUBLE AS pos, count(*) AS n FROM pred GROUP BY ALL) WINDOW w AS (PARTITION BY model, seed ORDER BY s DESC)) GROUP BY ALL""")
def _(spark, sf):
    return E.average_precision(E.attack_score(predictions(spark, sf))).select("model", "seed", *_r("pr_auc"))


@query("roc_auc", f"""
  SELECT model, seed, {r6('(sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(n - pos))')} AS roc_auc FROM
  (SELECT model, seed, pos, n, sum(n) OVER w - n + (n + 1) / 2.0 AS rk FROM
   (SELECT model, seed, 1 - scores[1] AS s, sum(CAST(y_true > 0 AS INT))::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY ALL) WINDOW w AS (PARTITION BY model, seed ORDER BY s)) GROUP BY ALL""")
def _(spark, sf):
    return E.roc_auc(E.attack_score(predictions(spark, sf))).select("model", "seed", *_r("roc_auc"))


_AGGREGATED = {"agg": f"""SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n_seeds FROM (
  {' UNION ALL '.join(f"SELECT model, seed, '{k}' AS metric, {v} AS value FROM prf GROUP BY model, seed" for k, v in SUMMARY.items())}) GROUP BY model, metric"""}


def _aggregated(spark, sf):
    return E.aggregate_seeds(E.run_table(_prf(spark, sf)).where(F.col("metric") != "balanced_accuracy"))


@query("aggregate_seeds", f"SELECT model, metric, {r6('mean')} AS mean, {r6('std')} AS std, n_seeds FROM agg", _AGGREGATED)
def _(spark, sf):
    return _aggregated(spark, sf).select("model", "metric", *_r("mean", "std"), "n_seeds")


@query("aggregate_seeds_per_class", f"SELECT model, class, {r6('avg(f1)')} AS mean, {r6('coalesce(stddev_samp(f1), 0)')} AS std FROM prf GROUP BY ALL")
def _(spark, sf):
    runs = _prf(spark, sf).select("model", "seed", "class", F.col("f1").alias("value"))
    return E.aggregate_seeds(runs, ["model", "class"]).select("model", "class", *_r("mean", "std"))


@query("leaderboard", f"SELECT model, metric, {r6('mean')} AS mean, {r6('std')} AS std, CAST(mean = max(mean) OVER (PARTITION BY metric) AS INTEGER) AS is_best FROM agg", _AGGREGATED)
def _(spark, sf):
    return E.leaderboard(_aggregated(spark, sf)).select("model", "metric", *_r("mean", "std"), "is_best")


@query("argmax_class", "SELECT model, seed, flow_id, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS first_best FROM pred")
def _(spark, sf):
    return predictions(spark, sf).select("model", "seed", "flow_id", S.first_argmax(F.col("scores")).alias("first_best"))


@query("class_weights", f"""
  SELECT target, n, {r6('w')} AS inverse, {r6('sqrt(w)')} AS sqrt FROM
  (SELECT target, n, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS w FROM (SELECT target, count(*) AS n FROM lab WHERE split = 0 GROUP BY target))""")
def _(spark, sf):
    train = labelled(spark, sf).where(F.col("split") == 0)
    root = E.class_weights(train, "sqrt", N_CLASSES).select("target", S.r6(F.col("weight")).alias("sqrt"))
    return E.class_weights(train, "inverse", N_CLASSES).select("target", "n", S.r6(F.col("weight")).alias("inverse")).join(root, "target")


_W = "(1 + ('0x' || substr(md5(flow_id), 1, 2))::BIGINT % 3)"
_WCOUNTS = {"wc": f"""SELECT model, seed, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT model, seed, y_true AS class, CASE WHEN y_true = y_pred THEN {_W} ELSE 0 END AS tp, 0 AS fp, CASE WHEN y_true <> y_pred THEN {_W} ELSE 0 END AS fn FROM pred
  UNION ALL SELECT model, seed, y_pred, 0, {_W}, 0 FROM pred WHERE y_true <> y_pred) GROUP BY ALL"""}


@query("weighted_macro_f1", f"SELECT model, seed, {r6('avg(2 * tp / (2 * tp + fp + fn)::DOUBLE) FILTER (tp + fn > 0)')} AS macro_f1 FROM wc GROUP BY ALL", _WCOUNTS)
def _(spark, sf):
    pred = predictions(spark, sf).withColumn("weight", 1 + S.hash_int(F.md5("flow_id"), 1, 2) % 3)
    return E.weighted_macro_f1(pred, "weight").select("model", "seed", *_r("macro_f1"))


_LOSS = {"cw": "SELECT target AS y_true, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE AS w FROM (SELECT target, count(*) AS n FROM lab WHERE split = 0 GROUP BY target)"}


@query("log_loss", f"""
  SELECT model, seed, {r6('sum(-ln(p)) / count(*)')} AS cross_entropy, {r6('sum(-w * ln(p)) / sum(w)')} AS weighted, {r6('sum(-w * (1 - p) * (1 - p) * ln(p)) / sum(w)')} AS focal
  FROM (SELECT *, greatest(scores[y_true + 1], 1e-12) AS p FROM pred JOIN cw USING (y_true)) GROUP BY ALL""", _LOSS)
def _(spark, sf):
    pred = predictions(spark, sf)
    weights = E.class_weights(labelled(spark, sf).where(F.col("split") == 0), "inverse", N_CLASSES)
    plain = E.log_loss(pred).select("model", "seed", S.r6(F.col("loss")).alias("cross_entropy"))
    weighted = E.log_loss(pred, weights).select("model", "seed", S.r6(F.col("loss")).alias("weighted"))
    focal = E.log_loss(pred, weights, 2.0).select("model", "seed", S.r6(F.col("loss")).alias("focal"))
    return plain.join(weighted, E.RUN).join(focal, E.RUN)


@query("class_list_mean", f"SELECT model, seed, {r6('avg(f1)')} AS mean_f1 FROM prf WHERE class IN (1, 3, 6) GROUP BY ALL")
def _(spark, sf):
    return E.class_list_mean(_prf(spark, sf), [1, 3, 6]).select("model", "seed", *_r("mean_f1"))
