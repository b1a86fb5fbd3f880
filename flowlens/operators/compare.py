"""Comparing scored models: block bootstrap over windows, two-level intervals, seed statistics.

The bootstrap never resamples flows. Predictions collapse to counts per (run, window, class); sums over
every run of ``block`` consecutive windows are prepared once; a replicate is then a draw of n / block
block sums. All comparisons, runs and both averages go through one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.ordering import positions
from flowlens.operators.metrics import RUN, class_counts, f1_of_counts, ratio
from flowlens.tables import cut

# Smallest effect of interest in macro-F1, and the family size of the Bonferroni interval.
SMALLEST_EFFECT = 0.02
PLANNED = 3
MDE_FACTOR = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.80)
COUNTS = ["tp", "fp", "fn"]


def window_counts(pred: DataFrame, by: Sequence[str] = tuple(RUN)) -> DataFrame:
    """True positives, false positives and false negatives per (run, window, class)."""
    return class_counts(pred, [*by, "window_id"])


def positioned_counts(pred: DataFrame) -> tuple[DataFrame, int]:
    """Window counts with the position of the window among the scored windows, and their number."""
    counts = cut(window_counts(pred))
    places = cut(positions(counts, "window_id", "pos", "n_windows"))
    first = places.select("n_windows").first()
    return cut(counts.join(places.select("window_id", "pos"), "window_id")), first["n_windows"] if first else 0


def block_samples(spark: SparkSession, n: int, n_boot: int, block: int = 10, seed: int = 0) -> DataFrame:
    """Draws (replicate, place, start, length): ceil(n / block) random blocks whose lengths add up to n."""
    per = -(-n // block)
    ids = spark.range(n_boot * per).select((F.col("id") / per).cast("bigint").alias("replicate"), (F.col("id") % per).alias("place"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("place").cast("string")))
    return ids.select(
        "replicate", "place", (S.hash_int(digest) % max(n - block + 1, 1)).alias("start"),
        F.least(F.lit(block), F.lit(n) - F.col("place") * block).cast("int").alias("length"),
    )


def sampled_windows(samples: DataFrame) -> DataFrame:
    """(replicate, pos, multiplicity) of drawn blocks."""
    drawn = samples.select("replicate", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    return drawn.groupBy("replicate", "pos").agg(F.count("*").alias("multiplicity"))


def block_sums(counts: DataFrame, n: int, block: int = 10) -> DataFrame:
    """Counts of every whole block and of every shortened last block, per (run, class, start)."""
    short = n - block * (-(-n // block) - 1)
    steps = F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("step")
    spread = counts.select(*RUN, "class", "pos", *COUNTS, steps).withColumn("start", F.col("pos") - F.col("step"))
    spread = spread.where((F.col("start") >= 0) & (F.col("start") <= max(n - block, 0)))
    parts = [F.sum(c).alias(c) for c in COUNTS] + [F.sum(F.when(F.col("step") < short, F.col(c)).otherwise(0)).alias(f"short_{c}") for c in COUNTS]
    return spread.groupBy(*RUN, "class", "start").agg(*parts)


def _macros(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro-F1 over all classes and over attacks, for classes with support, as rows (by, metric, f)."""
    scored = sums.withColumn("f1", f1_of_counts())
    present = F.col("tp") + F.col("fn") > 0
    both = scored.groupBy(*by).agg(
        F.avg(F.when(present, F.col("f1"))).alias("all"), F.avg(F.when(present & (F.col("class") > 0), F.col("f1"))).alias("attacks")
    )
    return both.unpivot(list(by), ["all", "attacks"], "metric", "f")


def replicate_macros(counts: DataFrame, n: int, n_boot: int, block: int = 10, seed: int = 0) -> DataFrame:
    """Macro-F1 of every run on every replicate."""
    samples = block_samples(counts.sparkSession, n, n_boot, block, seed)
    sums = cut(block_sums(counts, n, block))
    joined = samples.join(sums, "start")
    pick = lambda c: F.sum(F.when(F.col("length") < block, F.col(f"short_{c}")).otherwise(F.col(c))).alias(c)
    drawn = joined.groupBy("replicate", *RUN, "class").agg(*[pick(c) for c in COUNTS])
    return _macros(drawn, ["replicate", *RUN])


def whole_macros(counts: DataFrame) -> DataFrame:
    return _macros(counts.groupBy(*RUN, "class").agg(*[F.sum(c).alias(c) for c in COUNTS]), RUN)


def comparison_table(spark: SparkSession, comparisons: dict[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """Rows (comparison, part, model, coef) of linear combinations of models."""
    rows = [(name, i, model, float(coef)) for name, parts in comparisons.items() for i, (model, coef) in enumerate(parts)]
    return spark.createDataFrame(rows, "comparison string, part int, model string, coef double")


def _compared(pred: DataFrame, comparisons: dict[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """The predictions of the models that take part."""
    return pred.where(F.col("model").isin(sorted({model for parts in comparisons.values() for model, _ in parts})))


def _interval(col: str, level: float, name: str) -> list[Column]:
    """Percentile interval over the replicates of one comparison: n_boot values, by construction."""
    tail = (1.0 - level) / 2.0
    return [F.percentile(col, F.lit(tail)).alias(f"{name}_lo"), F.percentile(col, F.lit(1.0 - tail)).alias(f"{name}_hi")]


def paired_bootstrap(pred: DataFrame, comparisons: dict[str, Sequence[tuple[str, float]]], n_boot: int = 2000, block: int = 10, seed: int = 0) -> DataFrame:
    """Difference of seed-averaged macro-F1 with a window-resampling interval and P(difference <= 0).

    Raises if the runs compared did not score the same flows.
    """
    require_same_rows(_compared(pred, comparisons))
    counts, n = positioned_counts(pred)
    table = comparison_table(pred.sparkSession, comparisons)
    mean = lambda f, by: f.groupBy(*by, "model", "metric").agg(F.avg("f").alias("f"))
    combine = lambda f, by: f.join(table, "model").groupBy("comparison", "metric", *by).agg(F.sum(F.col("coef") * F.col("f")).alias("delta"))
    point = combine(mean(whole_macros(counts), []), [])
    drawn = combine(mean(replicate_macros(counts, n, n_boot, block, seed), ["replicate"]), ["replicate"])
    spread = drawn.groupBy("comparison", "metric").agg(*_interval("delta", 0.95, "window"), _share_le_0("delta").alias("p_le_0"))
    return point.join(spread, ["comparison", "metric"])


def _share_le_0(col: str) -> Column:
    return F.avg((F.col(col) <= 0).cast("double"))


def seed_picks(parts: DataFrame, runs: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """Seeds drawn with replacement per (comparison, part, replicate): as many as the model has."""
    order = Window.partitionBy("model").orderBy("seed")  # one row per training run
    indexed = runs.select("model", "seed").distinct().withColumn("place", F.row_number().over(order) - 1)
    sizes = indexed.groupBy("model").agg(F.count("*").alias("n_seeds"))
    drawn = (
        parts.join(sizes, "model")
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)).cast("array<bigint>")))
        .withColumn("draw", F.explode(F.sequence(F.lit(0), (F.col("n_seeds") - 1).cast("int"))))
    )
    digest = F.md5(F.concat_ws(":", F.lit(f"pick{seed}"), "comparison", *[F.col(c).cast("string") for c in ("part", "replicate", "draw")]))
    return drawn.withColumn("place", (S.hash_int(digest) % F.col("n_seeds")).cast("int")).join(indexed, ["model", "place"]).drop("place")


def trimmed_mean(values: Column, cut_share: float = 0.2) -> Column:
    """Mean of a sorted array without its lowest and highest share of entries."""
    n = F.size(values)
    off = F.floor(n * cut_share).cast("int")
    middle = F.slice(values, off + 1, n - 2 * off)
    return F.aggregate(middle, F.lit(0.0), lambda a, x: a + x) / F.size(middle)


def median_of(values: Column) -> Column:
    n = F.size(values)
    low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def contrast(
    pred: DataFrame, comparisons: dict[str, Sequence[tuple[str, float]]], n_boot: int = 2000, block: int = 10, seed: int = 0,
    robust: bool = False,
) -> DataFrame:
    """Linear combinations of seed-averaged macro-F1, resampling windows and seeds.

    Replicates draw blocks of windows shared by all models and, per model, its seeds. Intervals: two-level
    at 95 %, 90 % and Bonferroni, windows only, seeds only. Two parts with coefficients 1 and -1 give a
    difference, four a difference of differences. ``robust`` adds the two-level interval with the median
    and the 20 % trimmed mean over the drawn seeds in place of the mean. Raises if the runs compared did not score the same flows.
    """
    require_same_rows(_compared(pred, comparisons))
    counts, n = positioned_counts(pred)
    table = cut(comparison_table(pred.sparkSession, comparisons))
    whole = cut(whole_macros(counts))
    drawn = cut(replicate_macros(counts, n, n_boot, block, seed))
    picks = seed_picks(table, whole, n_boot, seed)
    keys = ["comparison", "metric", "replicate"]
    stat = F.avg("f")
    seeds_of = picks.join(drawn, ["replicate", "model", "seed"]).join(whole.withColumnRenamed("f", "f_whole"), ["model", "seed", "metric"])
    # A part's drawn seeds: as many rows as the model has training runs.
    parts = seeds_of.groupBy(*keys, "part", "coef").agg(
        stat.alias("two"), F.avg("f_whole").alias("seed_only"), *([F.sort_array(F.collect_list("f")).alias("fs")] if robust else [])
    )
    sums = [F.sum(F.col("coef") * F.col(c)).alias(c) for c in ("two", "seed_only")]
    if robust:
        sums += [F.sum(F.col("coef") * median_of(F.col("fs"))).alias("median"), F.sum(F.col("coef") * trimmed_mean(F.col("fs"))).alias("trim20")]
    two = parts.groupBy(*keys).agg(*sums)
    windows = drawn.groupBy("replicate", "model", "metric").agg(F.avg("f").alias("f")).join(table, "model")
    windows = windows.groupBy(*keys).agg(F.sum(F.col("coef") * F.col("f")).alias("window_only"))
    spread = two.join(windows, keys).groupBy("comparison", "metric").agg(
        *_interval("two", 0.95, "two"), *_interval("two", 0.90, "two90"), *_interval("two", 1.0 - 0.05 / PLANNED, "bonferroni"),
        *_interval("window_only", 0.95, "window"), *_interval("seed_only", 0.95, "seed"),
        F.stddev_samp("two").alias("two_sd"), _share_le_0("two").alias("p_le_0"),
        *(_interval("median", 0.95, "median") + _interval("trim20", 0.95, "trim20") if robust else []),
    )
    point = whole.groupBy("model", "metric").agg(F.avg("f").alias("f")).join(table, "model")
    point = point.groupBy("comparison", "metric").agg(F.sum(F.col("coef") * F.col("f")).alias("delta"))
    return point.join(spread, ["comparison", "metric"])


def same_rows(pred: DataFrame) -> DataFrame:
    """Whether every run scored the same flows: flows scored, runs, and flows that some run lacks or repeats.

    A flow is in order if it has as many rows as there are runs, each of another run: rows of one run do not stand in for another one.
    """
    per_run = pred.groupBy(*RUN).agg(F.count("*").alias("n"))
    per_flow = pred.groupBy("flow_id").agg(F.count("*").alias("times"), F.size(F.collect_set(F.struct(*RUN))).alias("runs"))  # one entry per run
    facts = per_flow.groupBy("times", "runs").agg(F.count("*").alias("flows"))
    staged = facts.withColumn("_runs", per_run.agg(F.count("*").alias("r")).scalar())
    wrong = (F.col("times") != F.col("_runs")) | (F.col("runs") != F.col("_runs"))
    return staged.agg(F.sum("flows").alias("flows"), F.max("_runs").alias("runs"), F.coalesce(F.sum(F.when(wrong, F.col("flows"))), F.lit(0)).alias("mismatched"))


def require_same_rows(pred: DataFrame) -> None:
    found = same_rows(pred).first()
    if found["mismatched"]:
        raise ValueError(f"{found['mismatched']} flows are not scored exactly once by every run")


def sides(runs: DataFrame, pairs: dict[str, tuple[str, str]], value: str = "value") -> DataFrame:
    """(comparison, side, seed, value) of the runs of two models per comparison."""
    rows = [(name, side, model) for name, (a, b) in pairs.items() for side, model in (("a", a), ("b", b))]
    table = runs.sparkSession.createDataFrame(rows, "comparison string, side string, model string")
    return runs.join(table, "model").select("comparison", "side", "seed", F.col(value).alias("value"))


def _of(side: str, fn) -> Column:
    return fn(F.when(F.col("side") == side, F.col("value")))


def welch(table: DataFrame) -> DataFrame:
    """Difference of means with its standard error and Welch's degrees of freedom."""
    facts = table.groupBy("comparison").agg(
        *[_of(s, fn).alias(f"{n}_{s}") for s in "ab" for n, fn in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    qa, qb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    df = (qa + qb) * (qa + qb) / (qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))
    return facts.select("comparison", (F.col("m_a") - F.col("m_b")).alias("difference"), F.sqrt(qa + qb).alias("se"), df.alias("df"))


def _kth_difference(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The k-th smallest a[i] - b[j], found by bisection on its rank: no pair is ever formed."""
    low, high = a.min() - b.max(), a.max() - b.min()
    while True:
        middle = low + (high - low) / 2.0
        if not low < middle < high:
            # The interval has closed on two neighbouring numbers.
            return low if (len(b) - np.searchsorted(b, a - low, "left")).sum() > k else high
        if (len(b) - np.searchsorted(b, a - middle, "left")).sum() > k:
            high = middle
        else:
            low = middle


def _shift(z: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.sort(pdf.loc[pdf["side"] == "a", "value"].to_numpy(float))
        b = np.sort(pdf.loc[pdf["side"] == "b", "value"].to_numpy(float))
        n, m = len(a), len(b)
        total = n * m
        k = int(np.floor(total / 2.0 - z * np.sqrt(total * (n + m + 1) / 12.0)))
        k = min(max(k, 0), total - 1)
        middle = (_kth_difference(a, b, (total - 1) // 2) + _kth_difference(a, b, total // 2)) / 2.0
        below, upto = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        superior = (below.sum() + (upto - below).sum() / 2.0) / total
        return pd.DataFrame(
            {"comparison": [pdf["comparison"].iloc[0]], "shift": [middle], "lo": [_kth_difference(a, b, k)],
             "hi": [_kth_difference(a, b, total - 1 - k)], "p_superior": [superior]}
        )

    return run


def hodges_lehmann(table: DataFrame, level: float = 0.95) -> DataFrame:
    """Median of all differences between the runs of two models, its order-statistic interval, and the
    probability that a run of the first beats one of the second. A group holds one value per training run."""
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    return table.groupBy("comparison").applyInPandas(_shift(z), "comparison string, shift double, lo double, hi double, p_superior double")


def variance_ratio(table: DataFrame) -> DataFrame:
    """Ratio of seed variances and the Brown-Forsythe statistic (deviations from the median)."""
    middle = table.groupBy("comparison", "side").agg(F.percentile("value", F.lit(0.5)).alias("_mid"))
    dev = table.join(middle, ["comparison", "side"]).withColumn("value", F.abs(F.col("value") - F.col("_mid")))
    per = dev.groupBy("comparison", "side").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    grand = total / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    w = per.groupBy("comparison").agg(((n - 2) * between / within).alias("brown_forsythe"))
    ratios = table.groupBy("comparison").agg((_of("a", F.var_samp) / _of("b", F.var_samp)).alias("var_ratio"), _of("a", F.stddev_samp).alias("sd_a"), _of("b", F.stddev_samp).alias("sd_b"))
    return ratios.join(w, "comparison")


def two_sided(p_le_0: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * F.least(p_le_0, 1.0 - p_le_0))


def holm(table: DataFrame, family: str = "family", name: str = "comparison", p: str = "p") -> DataFrame:
    """Holm's step-down adjustment within each family of planned comparisons."""
    ordered = Window.partitionBy(family).orderBy(p, name)
    size = F.count("*").over(Window.partitionBy(family))
    raw = F.least(F.lit(1.0), (size - F.row_number().over(ordered) + 1) * F.col(p))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(upto)).drop("_raw")


def detectable(contrasts: DataFrame, margin: float = SMALLEST_EFFECT) -> DataFrame:
    """Minimum detectable effect at 80 % power, and equivalence: 90 % interval inside the margin."""
    return contrasts.withColumns(
        {
            "mde": F.lit(MDE_FACTOR) * F.col("two_sd"),
            "equivalent": ((F.col("two90_lo") > -margin) & (F.col("two90_hi") < margin)).cast("int"),
        }
    )


def gap_share(own: DataFrame, shared: DataFrame) -> DataFrame:
    """Share of the gap between own test sets that survives on shared flows.

    Both tables: (comparison, side, seed, value), side a the optimistic protocol, b the strict one.
    """
    gap = lambda t, out: t.groupBy("comparison").agg((_of("a", F.avg) - _of("b", F.avg)).alias(out))
    return gap(own, "gap").join(gap(shared, "same"), "comparison").withColumn("share", F.when(F.col("gap") > 0, F.col("same") / F.col("gap")))


def gap_change(runs: DataFrame, comparisons: dict[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """Linear combination of run means with a normal interval from seed noise."""
    table = comparison_table(runs.sparkSession, comparisons)
    per = runs.groupBy("model").agg(F.avg("value").alias("m"), (F.var_samp("value") / F.count("*")).alias("q")).join(table, "model")
    out = per.groupBy("comparison").agg(F.sum(F.col("coef") * F.col("m")).alias("change"), F.sqrt(F.sum(F.col("coef") * F.col("coef") * F.col("q"))).alias("se"))
    return out.withColumns({"lo": F.col("change") - 1.96 * F.col("se"), "hi": F.col("change") + 1.96 * F.col("se")})


def failure_rates(flags: DataFrame, group: str = "model", flag: str = "flagged") -> DataFrame:
    return flags.groupBy(group).agg(F.count_if(F.col(flag) == 1).alias("failed"), F.count("*").alias("runs"), ratio(F.count_if(F.col(flag) == 1), F.count("*")).alias("rate"))
