"""Shortcut audits: who attacks, what identities give away, and whether the past leaks into the test.

Flows are expected with ``label`` (0/1), ``target`` (class number), ``attack`` (class name) and ``split``.
Host sets are distinct-address tables; flows meet them as semi joins, or collapse to counts per address
first so that one busy address is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.ordering import average_ranks, hash_positions, quantiles, running
from flowlens.operators import metrics as E
from flowlens.tables import cut

TRAIN, VAL, TEST = 0, 1, 2


def _share(flag: Column, of: Column | None = None) -> Column:
    value = flag.cast("double")
    return F.avg(value if of is None else F.when(of, value))


def dataset_stats(all_flows: DataFrame, kept: DataFrame) -> DataFrame:
    """Flows raw, kept and dropped, attack rate, hosts and attack sources."""
    hosts = kept.select(F.explode(F.array("src_ip", "dst_ip")).alias("host")).distinct().agg(F.count("*").alias("n"))
    sources = kept.where(F.col("label") == 1).select("src_ip").distinct().agg(F.count("*").alias("n"))
    raw = all_flows.agg(F.count("*").alias("n"))
    facts = kept.agg(F.count("*").alias("flows_kept"), F.avg(F.col("label").cast("double")).alias("attack_rate"))
    wide = facts.withColumns({"flows_raw": raw.scalar(), "unique_hosts": hosts.scalar(), "attack_sources": sources.scalar()})
    return wide.withColumn("flows_dropped", F.col("flows_raw") - F.col("flows_kept"))


def top_k(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values with count and share of all rows; ties by value."""
    counts = cut(df.groupBy(col).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.orderBy(F.desc("n"), col).limit(k).withColumn("_t", total).select(col, "n", (F.col("n") / F.col("_t")).alias("share"))


def keys_for_share(df: DataFrame, col: str, share: float = 0.9) -> DataFrame:
    """The smallest number of keys that together hold ``share`` of the rows.

    Keys with the same count are interchangeable, so counts collapse to (count, number of keys) and the
    running sum is ordered over distinct counts only.
    """
    sizes = df.groupBy(col).agg(F.count("*").alias("n"))
    levels = sizes.groupBy("n").agg(F.count("*").alias("keys")).withColumn("rows", F.col("n") * F.col("keys"))
    ordered = cut(running(levels, [], "n", ["keys", "rows"], descending=True))
    total = ordered.agg(F.max("cum_rows").alias("t")).scalar()
    wanted = F.lit(float(share)) * F.col("_t")
    # Level in which the share is reached: all keys above it, and as many of its own as are still missing.
    before = F.col("cum_rows") - F.col("rows")
    missing = F.ceil((wanted - before) / F.col("n"))
    hit = ordered.withColumn("_t", total).where((before < wanted) & (F.col("cum_rows") >= wanted))
    return hit.select((F.col("cum_keys") - F.col("keys") + missing).cast("bigint").alias("n_keys"))


def _hosts_of(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array("src_ip", "dst_ip")).alias("host")).distinct()


def host_overlap(df: DataFrame) -> DataFrame:
    """How much of the test period's hosts and attackers the training period already showed."""
    per_pair = cut(
        df.where(F.col("split").isin(TRAIN, TEST)).groupBy("split", "src_ip", "dst_ip").agg(F.count("*").alias("n"), F.sum("label").alias("attacks"))
    )
    train, test = per_pair.where(F.col("split") == TRAIN), per_pair.where(F.col("split") == TEST)
    train_hosts = cut(_hosts_of(train).withColumn("seen", F.lit(1)))
    attackers = cut(train.where(F.col("attacks") > 0).select("src_ip").distinct().withColumn("known", F.lit(1)))
    hosts = _hosts_of(test).join(train_hosts, "host", "left").agg(
        F.count("*").alias("hosts_test"), F.avg(F.coalesce("seen", F.lit(0)).cast("double")).alias("test_hosts_seen")
    )
    side = lambda c, name: train_hosts.select(F.col("host").alias(c), F.col("seen").alias(name))
    flagged = test.join(side("src_ip", "src_seen"), "src_ip", "left").join(side("dst_ip", "dst_seen"), "dst_ip", "left").join(attackers, "src_ip", "left")
    n, a = F.sum("n"), F.sum("attacks")
    part = lambda c, of: F.coalesce(F.sum(F.when(c, F.col(of))), F.lit(0))
    src, both, known = F.col("src_seen").isNotNull(), F.col("src_seen").isNotNull() & F.col("dst_seen").isNotNull(), F.col("known").isNotNull()
    flows = flagged.agg(
        (part(src, "n") / n).alias("test_flows_src_seen"), (part(both, "n") / n).alias("test_flows_both_seen"),
        F.when(a > 0, part(known, "attacks") / a).alias("test_attacks_from_known"),
    )
    sources = test.where(F.col("attacks") > 0).select("src_ip").distinct().join(attackers, "src_ip", "left").agg(
        F.count("*").alias("attackers_test"), F.count_if(F.col("known").isNull()).alias("attackers_new")
    )
    out = flows.withColumns(
        {
            "hosts_train": train_hosts.agg(F.count("*").alias("n")).scalar(),
            "attackers_train": attackers.agg(F.count("*").alias("n")).scalar(),
            **{c: hosts.select(c).scalar() for c in ("hosts_test", "test_hosts_seen")},
            **{c: sources.select(c).scalar() for c in ("attackers_test", "attackers_new")},
        }
    )
    return out


def dual_role_sources(df: DataFrame) -> DataFrame:
    """Sources that send attacks and benign flows."""
    sides = df.groupBy("src_ip").agg(F.max("label").alias("attacks"), F.min("label").alias("calm"))
    return sides.where((F.col("attacks") == 1) & (F.col("calm") == 0)).select("src_ip")


def majority_class(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent training class per key, the smallest class on a tie."""
    counts = train.groupBy(*keys, "target").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("target", F.struct(F.col("n"), -F.col("target"))).alias("majority"))


def identity_outcomes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(seen, y_true, y_pred, n) of a lookup that answers with the majority class of the key.

    The test flows collapse to counts per (key, class) before they meet the lookup table, so a key that
    holds a third of all flows joins as a handful of rows.
    """
    lookup = majority_class(df.where(F.col("split") == TRAIN), keys)
    asked = df.where(F.col("split") == TEST).groupBy(*keys, "target").agg(F.count("*").alias("n"))
    joined = asked.join(lookup, list(keys), "left")
    return joined.groupBy(
        F.col("majority").isNotNull().cast("int").alias("seen"), F.col("target").alias("y_true"), F.coalesce("majority", F.lit(0)).alias("y_pred")
    ).agg(F.sum("n").alias("n"))


def identity_probe(df: DataFrame, key_sets: dict[str, Sequence[str]], seen_only: bool = False) -> DataFrame:
    """Scores of predicting a flow's class from its addresses and ports alone; unseen keys are Benign.

    ``seen_only`` scores the test flows whose key occurs in training, and says how many those are.
    """
    outcomes = None
    for name, keys in key_sets.items():
        one = identity_outcomes(df, keys).withColumn("probe", F.lit(name))
        outcomes = one if outcomes is None else outcomes.unionByName(one)
    outcomes = cut(outcomes)
    by = ["probe"]
    scored = outcomes.where(F.col("seen") == 1) if seen_only else outcomes
    prf = E.per_class_prf(E.counts_of_outcomes(scored, by), by=by)
    table = E.summary_metrics(prf, by).select("probe", "macro_f1").join(E.binary_of_outcomes(scored, by), by)
    if not seen_only:
        return table
    seen, attack = F.col("seen") == 1, F.col("y_true") > 0
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    cover = outcomes.groupBy(*by).agg(
        part(seen).alias("n_flows"), (part(seen) / F.sum("n")).alias("share_of_test"), (part(seen & attack) / part(attack)).alias("share_of_attacks")
    )
    return table.join(cover, by)


def set_flow_counts(df: DataFrame, clients: Sequence[str] = (), servers: Sequence[str] = ()) -> DataFrame:
    """Benign flows to victims, to attackers, from attackers, from a victim to an attacker, and the share
    of benign flows between named client and server hosts."""
    pairs = cut(df.groupBy("src_ip", "dst_ip").agg(F.sum("label").alias("attacks"), F.sum(1 - F.col("label")).alias("benign")))
    bad = pairs.where(F.col("attacks") > 0)
    mark = lambda c, side, name: bad.select(F.col(c).alias(side)).distinct().withColumn(name, F.lit(1))
    flagged = (
        pairs.join(mark("dst_ip", "dst_ip", "to_victim"), "dst_ip", "left")
        .join(mark("src_ip", "dst_ip", "to_attacker"), "dst_ip", "left")
        .join(mark("src_ip", "src_ip", "from_attacker"), "src_ip", "left")
        .join(mark("dst_ip", "src_ip", "from_victim"), "src_ip", "left")
    )
    has = lambda c: F.col(c).isNotNull()
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("benign"))), F.lit(0))
    inner = F.col("src_ip").isin(list(clients)) & F.col("dst_ip").isin(list(servers))
    inner = inner | (F.col("src_ip").isin(list(servers)) & F.col("dst_ip").isin(list(clients)))
    return flagged.agg(
        part(has("to_victim")).alias("benign_to_victims"), part(has("to_attacker")).alias("benign_to_attackers"),
        part(has("from_attacker")).alias("benign_from_attackers"), part(has("from_victim") & has("to_attacker")).alias("benign_victim_to_attacker"),
        (part(inner) / F.sum("benign")).alias("core_share"),
    )


def per_source_class_range(df: DataFrame) -> DataFrame:
    """Smallest and largest number of flows of each attack class over the attack sources (0 counts)."""
    attacks = df.where(F.col("label") == 1)
    counts = cut(attacks.groupBy("src_ip", "attack").agg(F.count("*").alias("n")))
    sources = counts.select("src_ip").distinct().agg(F.count("*").alias("n")).scalar()
    ranges = counts.groupBy("attack").agg(F.min("n").alias("low"), F.max("n").alias("most"), F.count("*").alias("having")).withColumn("_sources", sources)
    return ranges.select("attack", F.when(F.col("having") < F.col("_sources"), 0).otherwise(F.col("low")).alias("least"), "most")


def value_share(df: DataFrame, col: str, by: str = "label") -> DataFrame:
    """Share of every value within each group."""
    counts = cut(df.groupBy(by, col).agg(F.count("*").alias("n")))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, by).select(by, col, (F.col("n") / F.col("_t")).alias("share"))


def clock_overlap(df: DataFrame) -> DataFrame:
    """Share of test flows in a minute of the day that training flows also occupy. 1440 rows decide it."""
    minutes = df.groupBy(S.minute_of_day(F.col("start_ms")).alias("minute")).agg(
        F.count_if(F.col("split") == TRAIN).alias("train"), F.count_if(F.col("split") == TEST).alias("test")
    )
    return minutes.agg((F.sum(F.when(F.col("train") > 0, F.col("test")).otherwise(0)) / F.sum("test")).alias("share"))


def attack_sources(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == 1).select(F.col("src_ip").alias("host")).distinct()


def percentile_band_share(nodes: DataFrame, columns: Sequence[str], group: str = "is_attacker", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Shares of attackers and of other hosts inside the attackers' percentile band on all ``columns``."""
    inside, staged = F.lit(True), nodes
    for c in columns:
        band = cut(quantiles(nodes.where(F.col(group) == 1), [], c, {"lo": low, "hi": high}))
        staged = staged.withColumns({f"_lo_{c}": band.select("lo").scalar(), f"_hi_{c}": band.select("hi").scalar()})
        inside = inside & F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
    flagged = staged.withColumn("_in", inside.cast("int"))
    own = F.col(group) == 1
    return flagged.agg(
        _share(F.col("_in"), own).alias("band_attackers"), _share(F.col("_in"), ~own).alias("band_others"),
        F.coalesce(F.sum(F.when(~own, F.col("_in"))), F.lit(0)).alias("band_others_n"),
    )


def context_shares(context: DataFrame) -> DataFrame:
    """Host-window pairs, share without a new peer, first sights, private hosts, largest log age."""
    private = context.where(F.col("is_private") > 0.5).select("host").distinct().agg(F.count("*").alias("n"))
    facts = context.agg(
        F.count("*").alias("host_windows"), _share(F.col("peer_novelty") == 0).alias("novelty_zero_share"),
        F.count_if(F.col("is_first_seen") > 0.5).alias("first_seen"), F.max("log_age_windows").alias("max_log_age"),
    )
    return facts.withColumn("private_hosts", private.scalar())


def reply_share(pred: DataFrame, attackers: DataFrame, limit: float = 0.5) -> DataFrame:
    """Per run: share of benign flows to attackers that are called attacks, and whether it passes ``limit``."""
    calm = pred.where(F.col("y_true") == 0).groupBy("model", "seed", "dst_ip").agg(
        F.count("*").alias("n"), F.count_if(F.col("y_pred") != 0).alias("called")
    )
    sent = calm.join(attackers.select(F.col("host").alias("dst_ip")), "dst_ip", "left_semi")
    runs = sent.groupBy("model", "seed").agg(F.sum("n").alias("n_flows"), (F.sum("called") / F.sum("n")).alias("share"))
    return runs.withColumn("flagged", (F.col("share") > limit).cast("int"))


def range_shift(nodes: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """p1, p99 and maximum of a column per split, and the share of rows above the training maximum."""
    by = list(by)
    spread = quantiles(nodes, [*by, "split"], col, {"p1": 0.01, "p99": 0.99})
    values = cut(nodes.groupBy(*by, "split", col).agg(F.count("*").alias("n")))
    own = values.where(F.col("split") == TRAIN)
    if by:
        tops = values.join(own.groupBy(*by).agg(F.max(col).alias("_top")), by)
    else:
        tops = values.withColumn("_top", own.agg(F.max(col).alias("t")).scalar())
    facts = tops.groupBy(*by, "split").agg(
        F.max(col).alias("largest"), (F.sum(F.when(F.col(col) > F.col("_top"), F.col("n")).otherwise(0)) / F.sum("n")).alias("above_train_max")
    )
    return facts.join(spread, [*by, "split"])


def leak_alarm(runs: DataFrame, limit: float = 0.99) -> DataFrame:
    """Runs whose macro-F1 is too good to be true."""
    return runs.where(F.col("macro_f1") > limit)


def log_bins(col: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value."""
    return sum((F.when(col >= F.lit(float(e)), 1).otherwise(0) for e in edges[1:]), F.when(col >= F.lit(float(edges[0])), 1).otherwise(0))


def binned_profile(df: DataFrame, x: str, y: str, edges: Sequence[float], min_rows: int = 20) -> DataFrame:
    """Median x and mean y per bin, for bins with enough rows."""
    binned = df.withColumn("bin", log_bins(F.col(x), edges))
    means = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean_y")).where(F.col("n") >= min_rows)
    return means.join(quantiles(binned, ["bin"], x, {"median_x": 0.5}), "bin")


def density_histogram(df: DataFrame, col: str, group: str, bins: int = 39, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Density of a column per group on equal bins between two percentiles of all rows."""
    span = cut(quantiles(df, [], col, {"lo": low, "hi": high}))
    staged = df.withColumns({"_lo": span.select("lo").scalar(), "_hi": span.select("hi").scalar()})
    staged = staged.withColumn("_hi", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo") + 1))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))
    counts = staged.where(F.col(col).between(F.col("_lo"), F.col("_hi"))).groupBy(group, place.alias("bin")).agg(F.count("*").alias("n"), F.max(width).alias("_w"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("_t"))
    return counts.join(totals, group).select(group, "bin", "n", (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks, and the mean of y where x is at most 10 and at least 100."""
    by = list(by)
    cells = cut(df.groupBy(*by, x, y).agg(F.count("*").alias("n")))
    rank = lambda c, out: average_ranks(cells.groupBy(*by, c).agg(F.sum("n").alias("n")), by, c, out).drop("n")
    ranked = cells.join(rank(x, "_rx"), [*by, x]).join(rank(y, "_ry"), [*by, y])
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * c) / n
    rx, ry = F.col("_rx"), F.col("_ry")
    cov = mean(rx * ry) - mean(rx) * mean(ry)
    spread = F.sqrt((mean(rx * rx) - mean(rx) * mean(rx)) * (mean(ry * ry) - mean(ry) * mean(ry)))
    part = lambda c: F.sum(F.when(c, F.col("n") * F.col(y))) / F.sum(F.when(c, F.col("n")))
    return ranked.groupBy(*by).agg((cov / spread).alias("rho"), part(F.col(x) <= 10).alias("mean_low"), part(F.col(x) >= 100).alias("mean_high"))


def permuted_rows(df: DataFrame, id_col: str, columns: Sequence[str], seed: int) -> DataFrame:
    """The given columns moved to other rows by a random permutation: place k of one hash order receives
    the values of place k of another. Both orders are cut into digest ranges, never sorted as a whole."""
    receivers = hash_positions(df.drop(*columns), S.hash_order(0, F.col(id_col)), "_place")
    givers = hash_positions(df.select(id_col, *columns), S.hash_order(seed, F.col(id_col)), "_place").drop(id_col)
    return receivers.join(givers, "_place").drop("_place")
