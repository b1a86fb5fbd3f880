"""Exact multi-class, binary and ranking metrics, all from counts.

A prediction table has ``model, seed, flow_id, y_true, y_pred`` and ``scores``; one row per flow and run.
Everything after :func:`class_counts` works on one row per (run, class).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.ordering import average_ranks, running
from flowlens.tables import cut

RUN = ["model", "seed"]


def outcome_counts(pred: DataFrame, by: Sequence[str] = tuple(RUN), weight: str | None = None) -> DataFrame:
    """Rows per (run, true class, predicted class): at most classes² rows per run."""
    n = F.count("*") if weight is None else F.sum(weight)
    return pred.groupBy(*by, "y_true", "y_pred").agg(n.alias("n"))


def confusion(pred: DataFrame, n_classes: int, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Counts of every (true, predicted) cell, zero cells included."""
    found = outcome_counts(pred, by)
    ids = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = found.select(*by).distinct().select(*by, F.explode(ids).alias("y_true")).select("*", F.explode(ids).alias("y_pred"))
    return grid.join(found, [*by, "y_true", "y_pred"], "left").na.fill(0, ["n"])


def confusion_percent(cells: DataFrame) -> DataFrame:
    """Cells as percent of their true class, averaged over seeds."""
    share = cells.groupBy("model", "seed", "y_true").agg(F.sum("n").alias("_row"))
    joined = cells.join(share, ["model", "seed", "y_true"])
    percent = F.when(F.col("_row") > 0, 100.0 * F.col("n") / F.col("_row")).otherwise(0.0)
    return joined.groupBy("model", "y_true", "y_pred").agg(F.avg(percent).alias("percent"))


def class_counts(pred: DataFrame, by: Sequence[str] = tuple(RUN), weight: str | None = None) -> DataFrame:
    """True positives, false positives and false negatives per (run, class), for classes that occur."""
    return counts_of_outcomes(outcome_counts(pred, by, weight), by)


def counts_of_outcomes(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.col("y_true") == F.col("y_pred")
    role = lambda c, tp, fp, fn: F.struct(F.col(c).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    n, zero = F.col("n"), F.col("n") * 0
    roles = F.when(hit, F.array(role("y_true", n, zero, zero))).otherwise(
        F.array(role("y_true", zero, zero, n), role("y_pred", zero, n, zero))
    )
    rows = outcomes.select(*by, F.explode(roles).alias("r")).select(*by, "r.*")
    return rows.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1_of_counts() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def per_class_prf(counts: DataFrame, n_classes: int | None = None, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 on an empty denominator."""
    if n_classes is not None:
        every = counts.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class"))
        counts = every.join(counts, [*by, "class"], "left").na.fill(0, ["tp", "fp", "fn"])
    return counts.select(
        *by, "class", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        f1_of_counts().alias("f1"),
    )


def macro_f1(prf: DataFrame, by: Sequence[str] = tuple(RUN), keep: Sequence[int] | None = None) -> DataFrame:
    """Mean F1 over the classes that occur among the true labels, optionally only those in ``keep``."""
    counted = F.col("support") > 0
    if keep is not None:
        counted = counted & F.col("class").isin(list(keep))
    return prf.groupBy(*by).agg(F.avg(F.when(counted, F.col("f1"))).alias("macro_f1"))


def summary_metrics(prf: DataFrame, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Macro-F1, macro-F1 over attacks, weighted F1, accuracy and balanced accuracy per run."""
    present = F.col("support") > 0
    return prf.groupBy(*by).agg(
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.avg(F.when(present & (F.col("class") > 0), F.col("f1"))).alias("macro_f1_attacks"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
    )


def binary_metrics(pred: DataFrame, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Benign against any attack: F1, precision, detection rate, false positive rate."""
    return binary_of_outcomes(outcome_counts(pred, by), by)


def binary_of_outcomes(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    attack, alarm = F.col("y_true") > 0, F.col("y_pred") > 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    cells = outcomes.groupBy(*by).agg(
        count(attack & alarm).alias("tp"), count(~attack & alarm).alias("fp"), count(attack & ~alarm).alias("fn"), count(~attack & ~alarm).alias("tn")
    )
    return cells.select(
        *by, f1_of_counts().alias("binary_f1"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("binary_precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("detection_rate"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
    )


def attack_score(pred: DataFrame, out: str = "score") -> DataFrame:
    return pred.withColumn(out, 1.0 - F.get("scores", F.lit(0)))


def average_precision(pred: DataFrame, by: Sequence[str] = tuple(RUN), score: str = "score") -> DataFrame:
    """Sum of recall steps times precision over the distinct thresholds; NULL if one class is missing.

    Flows collapse to distinct scores first; the running counts are ordered inside score ranges only.
    """
    by = list(by)
    tallies = pred.groupBy(*by, score).agg(F.count_if(F.col("y_true") > 0).alias("pos"), F.count("*").alias("n"))
    ordered = running(tallies, by, score, ["pos", "n"], descending=True)
    total = F.sum("pos")
    area = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    return ordered.groupBy(*by).agg(F.when((total > 0) & (total < F.sum("n")), area / total).alias("pr_auc"))


def roc_auc(pred: DataFrame, by: Sequence[str] = tuple(RUN), score: str = "score") -> DataFrame:
    """Area under the ROC curve from average ranks; ties count half. NULL if one class is missing."""
    by = list(by)
    tallies = cut(pred.groupBy(*by, score).agg(F.count_if(F.col("y_true") > 0).alias("pos"), F.count("*").alias("n")))
    ranks = average_ranks(tallies.select(*by, score, "n"), by, score, "rank")
    joined = ranks.join(tallies.select(*by, score, "pos"), [*by, score])
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    area = (F.sum(F.col("pos") * F.col("rank")) - pos * (pos + 1) / 2.0) / (pos * neg)
    return joined.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), area).alias("roc_auc"))


def run_table(prf: DataFrame) -> DataFrame:
    """Long table (model, seed, metric, value) of the summary metrics."""
    wide = summary_metrics(prf)
    names = [c for c in wide.columns if c not in RUN]
    return wide.unpivot(RUN, names, "metric", "value")


def run_records(prf: DataFrame) -> DataFrame:
    """One record per run with its metrics and per-class scores as maps."""
    wide = summary_metrics(prf)
    names = [c for c in wide.columns if c not in RUN]
    metrics = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    one = F.create_map(F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"), F.lit("f1"), F.col("f1"), F.lit("support"), F.col("support").cast("double"))
    per_class = prf.groupBy(*RUN).agg(F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("string"), one))).alias("per_class"))
    return wide.select(*RUN, metrics.alias("metrics")).join(per_class, RUN)


def aggregate_seeds(runs: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Mean and sample standard deviation over seeds; 0 for a single seed, NaN and NULL left out."""
    usable = runs.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n_seeds")
    )


def leaderboard(aggregated: DataFrame) -> DataFrame:
    """Models with their mean and deviation per metric and a flag for the best of each metric."""
    best = Window.partitionBy("metric")
    return aggregated.withColumn("is_best", (F.col("mean") == F.max("mean").over(best)).cast("int"))


def class_weights(df: DataFrame, scheme: str = "inverse", n_classes: int | None = None, label: str = "target") -> DataFrame:
    """Weight per class: N / (C * n), its square root, or 1; 1 for a class without rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    if n_classes is not None:
        every = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(label))
        counts = every.join(counts, label, "left").na.fill(0, ["n"])
    whole = Window.partitionBy(F.lit(0))  # one row per class
    total, classes = F.sum("n").over(whole), F.count("*").over(whole)
    raw = F.when(F.col("n") > 0, total / (classes * F.col("n"))).otherwise(F.lit(1.0))
    weight = {"inverse": raw, "sqrt": F.sqrt(raw), "none": F.lit(1.0)}
    if scheme not in weight:
        raise ValueError(f"unknown scheme {scheme}")
    return counts.select(label, "n", weight[scheme].alias("weight"))


def log_loss(pred: DataFrame, weights: DataFrame | None = None, gamma: float = 0.0, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Weighted cross-entropy of a scored table, or its focal form with ``gamma`` > 0.

    The weights are written first, so that their size is known: they are sent to the rows, and no class of rows is moved to one task.
    """
    p = F.greatest(F.get("scores", F.col("y_true")), F.lit(1e-12))
    if weights is None:
        weighted = pred.withColumn("_w", F.lit(1.0))
    else:
        weighted = pred.join(cut(weights.select(F.col("target").alias("y_true"), F.col("weight").alias("_w")), "weights"), "y_true")
    loss = -F.col("_w") * F.pow(1.0 - p, F.lit(float(gamma))) * F.log(p)
    return weighted.groupBy(*by).agg((F.sum(loss) / F.sum("_w")).alias("loss"))


def class_list_mean(prf: DataFrame, classes: Sequence[int], by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Mean F1 over a named list of classes."""
    return prf.where(F.col("class").isin(list(classes))).groupBy(*by).agg(F.avg("f1").alias("mean_f1"))


def weighted_macro_f1(pred: DataFrame, weight: str, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    return macro_f1(per_class_prf(class_counts(pred, by, weight), by=by), by)
