"""Train / validation / test splits and training samples.

Codes: 0 train, 1 validation, 2 test, 3 unused. Window splits work on the window table (one row per
window with ``pos`` and ``n_windows``); flow splits cut a hash order per class at an exact row number
without sorting or moving a class as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.ordering import cut_keys
from flowlens.operators.windows import session_bounds
from flowlens.tables import cut

TRAIN, VAL, TEST, UNUSED = 0, 1, 2, 3


def share(n: Column, part: float) -> Column:
    """floor(n * part) in double arithmetic."""
    return F.floor(n.cast("double") * F.lit(float(part)))


def by_position(pos: Column, train: Column, val: Column) -> Column:
    return F.when(pos < train, TRAIN).when(pos < train + val, VAL).otherwise(TEST)


def split_chronological(windows: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    n = F.col("n_windows")
    return windows.withColumn("split", by_position(F.col("pos"), share(n, train), share(n, val)))


def split_blocked(windows: DataFrame, blocks: int = 10, val: float = 0.1, test: float = 0.2) -> DataFrame:
    """Consecutive blocks of windows, each cut into train, validation and test in time order."""
    n = F.col("n_windows")
    count = F.when(n < 3, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(blocks), F.floor(n / 3))))
    per = F.greatest(F.lit(1), F.floor(n / count))
    block = F.least(F.floor(F.col("pos") / per), count - 1)
    size = F.when(block == count - 1, n - block * per).otherwise(per)
    n_val = F.greatest(F.lit(1), share(size, val))
    n_test = F.greatest(F.lit(1), share(size, test))
    n_train = F.greatest(F.lit(1), size - n_val - n_test)
    n_val = F.least(n_val, size - n_train)
    place = F.col("pos") - block * per
    code = F.when(size < 3, F.lit(TRAIN)).otherwise(by_position(place, n_train, n_val))
    return windows.withColumn("split", code)


def split_blocked_ratio(windows: DataFrame, blocks: int = 10, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Variant with block sizes of n // blocks, the last block taking the rest, cut by ratios."""
    n = F.col("n_windows")
    per = F.greatest(F.lit(1), F.floor(n / blocks))
    block = F.least(F.floor(F.col("pos") / per), F.lit(blocks - 1))
    size = F.when(block == blocks - 1, n - block * per).otherwise(per)
    return windows.withColumn("split", by_position(F.col("pos") - block * per, share(size, train), share(size, val)))


def _hash_cut(df: DataFrame, by: Sequence[str], id_col: str, seed: int, wanted: DataFrame, cuts: Sequence[str]) -> DataFrame:
    """``df`` with one column per cut: the digest up to which rows of the group belong to the cut."""
    keyed = df.withColumn("_hash", S.hash_order(seed, F.col(id_col)))
    keys = cut(cut_keys(keyed, by, "_hash", wanted).groupBy(*by).pivot("cut", list(cuts)).agg(F.first("upto_key")))
    return keyed.join(keys, list(by))


def _cuts(sizes: DataFrame, by: Sequence[str], **wanted: Column) -> DataFrame:
    """Long form (by, cut, k) of several row numbers per group; written once, as it is read several times."""
    ks = F.explode(F.array(*[F.struct(F.lit(n).alias("cut"), k.cast("bigint").alias("k")) for n, k in wanted.items()]))
    return cut(sizes.select(*by, ks.alias("_c")).select(*by, "_c.cut", "_c.k"))


def split_random_windows(windows: DataFrame, seed: int, train: float = 0.7, val: float = 0.1, cumulative: bool = False) -> DataFrame:
    """Whole windows in hash order. ``cumulative`` cuts validation at floor((train + val) * n) instead of
    adding floor(val * n) windows."""
    n = F.col("n_windows")
    grouped = windows.withColumn("_all", F.lit(0))
    first = share(n, train)
    second = share(n, round(train + val, 10)) if cumulative else first + share(n, val)
    wanted = _cuts(grouped.select("_all", "n_windows").limit(1), ["_all"], a=first, b=second)
    cuts = _hash_cut(grouped, ["_all"], "window_id", seed, wanted, ["a", "b"])
    code = F.when(F.col("_hash") <= F.col("a"), TRAIN).when(F.col("_hash") <= F.col("b"), VAL).otherwise(TEST)
    return cuts.withColumn("split", code).drop("_hash", "_all", "a", "b")


def split_random_flows(
    df: DataFrame, seed: int, label: str = "target", id_col: str = "flow_id", train: float = 0.7, val: float = 0.1,
    cumulative: bool = False,
) -> DataFrame:
    """Flows at random, stratified by class; shares are rounded half to even."""
    n = F.col("n").cast("double")
    first = F.bround(n * train, 0)
    second = F.bround(n * round(train + val, 10), 0) if cumulative else first + F.bround(n * val, 0)
    wanted = _cuts(df.groupBy(label).agg(F.count("*").alias("n")), [label], a=first, b=second)
    cuts = _hash_cut(df, [label], id_col, seed, wanted, ["a", "b"])
    code = F.when(F.col("_hash") <= F.col("a"), TRAIN).when(F.col("_hash") <= F.col("b"), VAL).otherwise(TEST)
    return cuts.withColumn("split", code).drop("_hash", "a", "b")


def split_session(
    df: DataFrame, windows: DataFrame, seconds: float, val_share: float, seed: int, unit: str = "flows",
    gap_seconds: float = 3600.0, label: str = "target", id_col: str = "flow_id",
) -> DataFrame:
    """The first recording session trains and validates, everything after the first long gap tests.

    ``windows`` is the table of kept windows. Validation takes a share of the session's flows per class
    (``unit="flows"``) or of its windows, apart for windows with and without attacks (``unit="windows"``).
    """
    starts = windows.select((F.col("window_id") * (seconds * 1000.0)).alias("start_ms"))
    second = session_bounds(starts, gap_seconds * 1000.0).where(F.col("session_id") == 0)
    limit = second.select(F.max("next_start")).scalar()
    placed = df.withColumn("_limit", limit).withColumn("_first", F.col("window_id") * (seconds * 1000.0) < F.col("_limit")).drop("_limit")
    placed = placed.withColumn("_first", F.col("_first").cast("int"))
    if unit == "flows":
        n = F.bround(F.col("n").cast("double") * val_share, 0)
        sizes = placed.where(F.col("_first") == 1).groupBy(label).agg(F.count("*").alias("n"))
        wanted = _cuts(sizes, [label], v=n)
        first = _hash_cut(placed.where(F.col("_first") == 1), [label], id_col, seed, wanted, ["v"])
        first = first.withColumn("split", F.when(F.col("_hash") <= F.col("v"), VAL).otherwise(TRAIN)).drop("_hash", "v")
        rest = placed.where(F.col("_first") == 0).withColumn("split", F.lit(TEST))
        return first.unionByName(rest).drop("_first")
    per_window = placed.groupBy("window_id", "_first").agg(F.max((F.col(label) > 0).cast("int")).alias("has_attack"))
    table = cut(per_window)
    sizes = table.where(F.col("_first") == 1).groupBy("has_attack").agg(F.count("*").alias("n"))
    wanted = _cuts(sizes, ["has_attack"], v=F.bround(F.col("n").cast("double") * val_share, 0))
    coded = _hash_cut(table.where(F.col("_first") == 1), ["has_attack"], "window_id", seed, wanted, ["v"])
    coded = coded.select("window_id", F.when(F.col("_hash") <= F.col("v"), VAL).otherwise(TRAIN).alias("split"))
    rest = table.where(F.col("_first") == 0).select("window_id", F.lit(TEST).alias("split"))
    return placed.drop("_first").join(cut(coded.unionByName(rest)), "window_id")


def split_aligned(windows: DataFrame, seconds: float, reference: DataFrame, reference_seconds: float) -> DataFrame:
    """Windows of another length take the split periods of a reference window table (window_id, split)."""
    start = F.col("window_id") * float(reference_seconds)
    first = lambda code: reference.where(F.col("split") == code).select(F.min(start).alias("s")).scalar()
    placed = windows.withColumns({"_val": first(VAL), "_test": first(TEST), "_start": F.col("window_id") * float(seconds)})
    code = F.when(F.col("_start") >= F.col("_test"), TEST).when(F.col("_start") >= F.col("_val"), VAL).otherwise(TRAIN)
    return placed.withColumn("split", code).drop("_val", "_test", "_start")


def sample_keep_attacks(df: DataFrame, limit: int, seed: int, label: str = "target", id_col: str = "flow_id") -> DataFrame:
    """All attack rows plus random benign rows up to ``limit`` rows in total."""
    grouped = df.withColumn("_attack", (F.col(label) > 0).cast("int"))
    sizes = grouped.groupBy("_attack").agg(F.count("*").alias("n"))
    counts = df.agg(F.count_if(F.col(label) > 0).alias("a")).scalar()
    sizes = sizes.withColumn("_a", counts)
    keep = F.when(F.col("_attack") == 1, F.col("n")).otherwise(F.least("n", F.greatest(F.lit(0), F.lit(limit) - F.col("_a"))))
    wanted = _cuts(sizes, ["_attack"], keep=keep)
    cuts = _hash_cut(grouped, ["_attack"], id_col, seed, wanted, ["keep"])
    return cuts.where((F.col("_attack") == 1) | (F.col("_hash") <= F.col("keep"))).drop("_attack", "_hash", "keep")


def mark_unused(df: DataFrame, limit: int, seed: int, label: str = "target", id_col: str = "flow_id") -> DataFrame:
    """Training flows outside the sample get code 3: they stay in the graphs and leave the loss."""
    train = df.where(F.col("split") == TRAIN)
    sizes = train.groupBy((F.col(label) > 0).cast("int").alias("_attack")).agg(F.count("*").alias("n"))
    attacks = train.agg(F.count_if(F.col(label) > 0).alias("a")).scalar()
    sizes = sizes.withColumn("_a", attacks).where(F.col("_attack") == 0)
    wanted = _cuts(sizes, ["_attack"], keep=F.least("n", F.greatest(F.lit(0), F.lit(limit) - F.col("_a"))))
    hashed = df.withColumn("_hash", S.hash_order(seed, F.col(id_col)))
    benign = hashed.where((F.col("split") == TRAIN) & (F.col(label) == 0)).withColumn("_attack", F.lit(0))
    bound = cut_keys(benign, ["_attack"], "_hash", wanted).select(F.max("upto_key").alias("k")).scalar()
    marked = hashed.withColumn("_keep", bound)
    outside = (F.col("split") == TRAIN) & (F.col(label) == 0) & (F.col("_hash") > F.col("_keep"))
    return marked.withColumn("split", F.when(outside, UNUSED).otherwise(F.col("split"))).drop("_hash", "_keep")


def class_quotas(sizes: DataFrame, budget: int, label: str = "target") -> DataFrame:
    """(label, k): rows of each class in a training sample of about ``budget`` rows; ``sizes`` has one row (label, n) per class.

    If attacks exceed half of the budget, every class is cut at one level, the highest that the budget bears. Going through the classes by
    size, the level is what the smaller ones leave, shared by the class and the larger ones, at the first class that is too large for
    it. Otherwise all attacks are taken and benign rows (class 0) fill the rest.
    """
    every, by_size = Window.partitionBy(F.lit(0)), Window.orderBy("n", label)
    smaller = F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    larger = F.count("*").over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = sizes.withColumns({
        "_share": F.floor((F.lit(budget) - smaller) / larger),
        "_attacks": F.coalesce(F.sum(F.when(F.col(label) > 0, F.col("n"))).over(every), F.lit(0)),
    })
    ranked = ranked.withColumn("_tight", F.col("n") > F.col("_share")).withColumn("_first", F.min(F.when(F.col("_tight"), F.struct("n", label, "_share"))).over(every))
    level = F.coalesce(F.col("_first._share"), F.col("n"))
    filled = F.when(F.col(label) > 0, F.col("n")).otherwise(F.least("n", F.lit(budget) - F.col("_attacks")))
    k = F.when(F.col("_attacks") <= budget // 2, filled).otherwise(F.least("n", level))
    return ranked.select(label, k.cast("bigint").alias("k"))


def sample_class_capped(df: DataFrame, budget: int, seed: int, label: str = "target", id_col: str = "flow_id") -> DataFrame:
    """Training sample of about ``budget`` rows, see ``class_quotas``; within a class the rows of least hash are taken."""
    quotas = class_quotas(df.groupBy(label).agg(F.count("*").alias("n")), budget, label)
    wanted = cut(quotas.select(label, F.lit("keep").alias("cut"), "k"))
    cuts = _hash_cut(df, [label], id_col, seed, wanted, ["keep"])
    return cuts.where(F.col("_hash") <= F.col("keep")).drop("_hash", "keep")


def split_summary(df: DataFrame) -> DataFrame:
    """Flows, attacks, windows and period per split. Windows are counted after collapsing flows per window."""
    per_window = df.groupBy("split", "window_id").agg(
        F.count("*").alias("flows"), F.sum("label").alias("attacks"), F.min("start_ms").alias("start_ms"), F.max("start_ms").alias("end_ms")
    )
    return per_window.groupBy("split").agg(
        F.sum("flows").alias("flows"), F.sum("attacks").alias("attack_flows"), F.count("*").alias("windows"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    )


def class_counts_per_split(df: DataFrame) -> DataFrame:
    """Flows per class with a column per split."""
    counts = df.groupBy("attack").pivot("split", [TRAIN, VAL, TEST]).agg(F.count(F.lit(1))).na.fill(0)
    return counts.select("attack", F.col("0").alias("train"), F.col("1").alias("val"), F.col("2").alias("test"))


def missing_classes(df: DataFrame, split: int = TEST) -> DataFrame:
    """Classes without a single flow in the split."""
    counts = df.groupBy("attack").agg(F.count_if(F.col("split") == split).alias("n"))
    return counts.where(F.col("n") == 0).select("attack")


def shared_test(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flows that two splits both test on."""
    ids = b.where(F.col("split") == TEST).select("flow_id")
    return a.where(F.col("split") == TEST).join(ids, "flow_id", "left_semi")


def shared_test_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    per_window = shared_test(a, b).groupBy("window_id").agg(F.count("*").alias("flows"), F.sum("label").alias("attacks"))
    return per_window.agg(F.sum("flows").alias("flows"), F.sum("attacks").alias("attacks"), F.count("*").alias("windows"))


def class_counts_by_day(df: DataFrame) -> DataFrame:
    """Flows per UTC day and class, long form: only the pairs that occur."""
    return df.groupBy(S.to_day(F.col("start_ms")).alias("day"), "attack").agg(F.count("*").alias("flows"))
