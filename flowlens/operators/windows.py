"""Tumbling windows, sessions, timelines and window statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.ordering import positions, quantiles
from flowlens.tables import cut

HOUR_MS = 3_600_000.0


def assign_windows(df: DataFrame, seconds: float, origin_ms: float | None = None) -> DataFrame:
    """Window number of each flow, counted from the earliest start in the data (or from ``origin_ms``)."""
    width = float(seconds) * 1000.0
    if origin_ms is not None:
        return df.withColumn("window_id", F.floor((F.col("start_ms") - F.lit(float(origin_ms))) / width))
    first = df.agg(F.min("start_ms").alias("first")).scalar()
    return df.withColumn("_first", first).withColumn("window_id", F.floor((F.col("start_ms") - F.col("_first")) / width)).drop("_first")


def window_table(df: DataFrame, min_flows: int = 2) -> DataFrame:
    """Kept windows with their number of flows."""
    return df.groupBy("window_id").agg(F.count("*").alias("n_flows")).where(F.col("n_flows") >= min_flows)


def window_ordinal(windows: DataFrame) -> DataFrame:
    """Windows with their dense 0-based position in time and the number of windows."""
    return positions(windows, "window_id", "pos", "n_windows")


def min_flows_filter(df: DataFrame, n: int = 2) -> DataFrame:
    """Flows of windows with at least ``n`` flows.

    Counting is map-side combined and the window table is written, so its size is known: while it is
    small the filter is a broadcast semi join that moves no flow, beyond that a shuffle join.
    """
    return df.join(cut(window_table(df, n).select("window_id")), "window_id", "left_semi")


def max_windows(df: DataFrame, k: int, n: int = 2) -> DataFrame:
    """Flows of the first ``k`` kept windows."""
    first = positions(window_table(df, n)).where(F.col("pos") < k).select("window_id")
    return df.join(cut(first), "window_id", "left_semi")


def rewindow(df: DataFrame, seconds: float) -> DataFrame:
    return assign_windows(df.drop("window_id"), seconds)


def session_starts(df: DataFrame, gap_ms: float = HOUR_MS) -> DataFrame:
    """First start time of every session: more than ``gap_ms`` after the start before it.

    Only the edges of hours matter across hours, so the single ordered pass sees one row per
    occupied time bucket (of length ``gap_ms``), never the flows.
    """
    bucketed = df.select("start_ms").withColumn("_b", F.floor(F.col("start_ms") / gap_ms))
    # Inside one bucket two neighbours are never more than gap_ms apart, so a session can only begin
    # at the first start of a bucket.
    edges = bucketed.groupBy("_b").agg(F.min("start_ms").alias("first"), F.max("start_ms").alias("last"))
    # Buckets next to each other are compared inside a chunk; the chunk edge looks into the chunk before.
    chunked = edges.withColumn("_chunk", F.floor(F.col("_b") / 4096))
    ends = chunked.groupBy("_chunk").agg(F.max("last").alias("chunk_last"))
    ends = ends.select("_chunk", F.lag("chunk_last").over(Window.orderBy("_chunk")).alias("before_chunk"))
    inside = Window.partitionBy("_chunk").orderBy("_b")
    seen = chunked.withColumn("_before", F.lag("last").over(inside)).join(ends, "_chunk")
    before = F.coalesce("_before", "before_chunk")
    return seen.where(before.isNull() | (F.col("first") - before > gap_ms)).select(F.col("first").alias("session_start"))


def session_bounds(df: DataFrame, gap_ms: float = HOUR_MS) -> DataFrame:
    """Sessions as half-open ranges [session_start, next_start) with their number in time order."""
    starts = session_starts(df, gap_ms)
    # One row per session: sessions are separated by at least gap_ms, so their number is bounded by the time span.
    order = Window.orderBy("session_start")
    return starts.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("session_id"),
        "session_start",
        F.coalesce(F.lead("session_start").over(order), F.lit(float("inf"))).alias("next_start"),
    )


def session_buckets(df: DataFrame, gap_ms: float = HOUR_MS) -> DataFrame:
    """Occupied time buckets of length ``gap_ms`` with their session, first and last start, flows and attacks.

    A session starts at a bucket's first flow, so a bucket never holds flows of two sessions.
    """
    starts = session_bounds(df, gap_ms)
    attacks = F.sum("label") if "label" in df.columns else F.sum(F.lit(0))
    per_bucket = (
        df.withColumn("_b", F.floor(F.col("start_ms") / gap_ms))
        .groupBy("_b")
        .agg(F.min("start_ms").alias("start_ms"), F.max("start_ms").alias("end_ms"), F.count("*").alias("flows"), attacks.alias("attacks"))
    )
    marks = starts.select(F.floor(F.col("session_start") / gap_ms).alias("_b"), "session_id")
    marked = cut(per_bucket.join(marks, "_b", "left")).withColumn("_chunk", F.floor(F.col("_b") / 4096))
    # Last session number seen so far: inside a chunk by an ordered pass, before it by the chunk table.
    tops = marked.groupBy("_chunk").agg(F.max("session_id").alias("_top"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_chunk", F.max("_top").over(earlier).alias("_carry"))
    inside = Window.partitionBy("_chunk").orderBy("_b")
    known = marked.withColumn("_seen", F.max("session_id").over(inside)).join(tops, "_chunk")
    return known.withColumn("session_id", F.coalesce("_seen", "_carry")).drop("_seen", "_carry", "_chunk")


def assign_sessions(df: DataFrame, gap_ms: float = HOUR_MS) -> DataFrame:
    """Rows with the number of their session: an equi-join on the time bucket."""
    table = cut(session_buckets(df, gap_ms).select("_b", "session_id"))
    return df.withColumn("_b", F.floor(F.col("start_ms") / gap_ms)).join(table, "_b").drop("_b")


def sessionize(df: DataFrame, gap_ms: float = HOUR_MS) -> DataFrame:
    """Sessions with start, end, hours, flows and attack flows; flows collapse to time buckets first."""
    return session_buckets(df, gap_ms).groupBy("session_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        ((F.max("end_ms") - F.min("start_ms")) / HOUR_MS).alias("hours"),
        F.sum("flows").alias("flows"),
        F.sum("attacks").alias("attack_flows"),
    )


def timeline(df: DataFrame, minutes: float, classes: list[str], split: str = "split") -> DataFrame:
    """Flows per time bin and class, with the split most flows of the bin belong to (smallest on a tie)."""
    width = minutes * 60_000.0
    counts = df.groupBy(F.floor(F.col("start_ms") / width).alias("bin"), split).pivot("attack", classes).agg(F.count(F.lit(1)))
    counts = counts.na.fill(0, classes)
    total = sum((F.col(f"`{c}`") for c in classes[1:]), F.col(f"`{classes[0]}`"))
    return counts.groupBy("bin").agg(
        *[F.sum(f"`{c}`").alias(c) for c in classes],
        F.max_by(split, F.struct(total, -F.col(split))).alias("split"),
    ).select((F.col("bin") * width).cast("bigint").alias("bin_start_ms"), *[f"`{c}`" for c in classes], "split")


def windows_of_split(df: DataFrame, split: int, col: str = "split") -> DataFrame:
    return df.where(F.col(col) == split).select("window_id").distinct()


def window_profile(df: DataFrame) -> DataFrame:
    """Flows and hosts per window: median, mean, 95th percentile, largest."""
    flows = df.groupBy("window_id").agg(F.count("*").cast("double").alias("size")).select(F.lit("flows").alias("what"), "size")
    ends = df.select("window_id", F.explode(F.array("src_ip", "dst_ip")).alias("host")).distinct()
    hosts = ends.groupBy("window_id").agg(F.count("*").cast("double").alias("size")).select(F.lit("hosts").alias("what"), "size")
    sizes = cut(flows.unionByName(hosts))
    middle = quantiles(sizes, ["what"], "size", {"median": 0.5, "p95": 0.95})
    rest = sizes.groupBy("what").agg(F.avg("size").alias("mean"), F.max("size").alias("largest"))
    return rest.join(middle, "what")


def window_end(df: DataFrame, seconds: float) -> Column:
    """Scalar-anchored end of each flow's window (same anchor as :func:`assign_windows`)."""
    return F.col("_first") + (F.col("window_id") + 1) * (float(seconds) * 1000.0)


def late_flows(df: DataFrame, seconds: float, duration: str = "duration_ms") -> DataFrame:
    """Flows that end after their window closes: share, share among attacks, count, size of the excess."""
    first = df.agg(F.min("start_ms").alias("first")).scalar()
    excess = (F.col("start_ms") + F.col(duration) - window_end(df, seconds)) / 1000.0
    timed = df.withColumn("_first", first).withColumn("excess_s", excess)
    late = (F.col("excess_s") > 0).cast("double")
    facts = timed.agg(
        F.avg(late).alias("late_share"),
        F.avg(F.when(F.col("label") == 1, late)).alias("late_share_attack"),
        F.sum(late).cast("bigint").alias("late_flows"),
        F.max(F.when(F.col("excess_s") > 0, F.col("excess_s"))).alias("excess_max_s"),
        (F.max(duration) / 1000.0).alias("duration_max_s"),
    )
    middle = quantiles(timed.where(F.col("excess_s") > 0), [], "excess_s", {"excess_median_s": 0.5, "excess_p95_s": 0.95})
    middle = cut(middle)
    return facts.withColumns({c: middle.select(c).scalar() for c in middle.columns})
