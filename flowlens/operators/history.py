"""A host's present against its own past: EWMA z-scores, peer novelty, age.

Nothing here keeps a host's history in memory. Mean and variance of an EWMA are linear recurrences,
``s[t] = d * s[t-1] + u[t]``. A host's rows are cut into chunks of consecutive windows, and these into blocks; inside a block
``s[t] = d^t * sum(u[i] * d^-i)``, a running sum whose weights stay within the range of a double. A block as a whole is an affine
map of what enters it, and a prefix scan over the maps gives what enters each block, exactly, across any number of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scans import affine_prefix
from flowlens.tables import cut

OBSERVED = ["log_flows", "log_bytes", "log_ports", "log_peers"]
VARIANCE_FLOOR = 1e-6
Z_LIMIT = 10.0
#: Consecutive windows of a chunk: a host's rows that one task orders at most.
CHUNK = 4096


def observations(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """log(1 + x) of flows, bytes, distinct destination ports and peers per host and window.

    ``hosts`` is the host-count table, ``ports`` has one row per (window, host) with ``n_ports``.
    """
    joined = hosts.join(ports.select("window_id", "host", "n_ports"), ["window_id", "host"], "left")
    return joined.select(
        "window_id", "host",
        F.log1p(F.col("flows_in") + F.col("flows_out")).alias("log_flows"),
        F.log1p("bytes").alias("log_bytes"),
        F.log1p(F.coalesce("n_ports", F.lit(0))).alias("log_ports"),
        F.log1p("peers").alias("log_peers"),
    )


def _block_rows(decay: float, chunk: int) -> int:
    """Rows over which the weights d^-t stay far inside the range of a double."""
    if decay in (0.0, 1.0):
        return chunk
    return max(1, min(chunk, math.floor(500.0 / -math.log(decay))))


class _Recurrence:
    """``s[t] = decay * s[t-1] + u[t]`` per host, over rows with their chunk ``_chunk`` and their place in it ``_at``.

    With one chunk and one block nothing enters from outside and there is nothing to join.
    """

    def __init__(self, decay: float, host: str, order: str, low: int, high: int, chunk: int):
        self.decay, self.host, self.order, self.low, self.high = decay, host, order, low, high
        self.rows = _block_rows(decay, chunk)
        self.blocks = -(-chunk // self.rows)
        self.alone = low == high and self.blocks == 1

    def solve(self, df: DataFrame, inputs: dict[str, Column]) -> DataFrame:
        """Adds for every input ``u`` the value after the row under its name, and the value before the row as ``_before_<name>``."""
        place = F.col("_at") % self.rows
        chunk = Window.partitionBy(self.host, "_chunk").orderBy(self.order)
        inside = chunk if self.blocks == 1 else Window.partitionBy(self.host, "_chunk", "_block").orderBy(self.order)
        if self.blocks > 1:
            df = df.withColumn("_block", F.floor(F.col("_at") / self.rows))
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        weight = F.pow(F.lit(self.decay), place)
        if self.decay == 0.0:
            df = df.withColumns(inputs)
        else:
            df = df.withColumns({n: F.sum(u / weight).over(upto) * weight for n, u in inputs.items()})
        if self.alone:
            return df.withColumns({f"_before_{n}": F.lag(n).over(inside) for n in inputs})
        block = F.col("_block") if self.blocks > 1 else F.lit(0)
        df = cut(df.withColumn("_pos", ((F.col("_chunk") - self.low) * self.blocks + block).cast("bigint")), "blocks")
        count = F.max(place) + 1
        maps = df.groupBy(self.host, "_pos").agg(
            F.array(*[F.pow(F.lit(self.decay), count) for _ in inputs]).alias("a"), F.max_by(F.array(*inputs), place).alias("b")
        )
        top = (self.high - self.low + 1) * self.blocks - 1
        entering = affine_prefix(maps.withColumnRenamed("_pos", "pos"), [self.host], 0, top).withColumnRenamed("pos", "_pos")
        df = df.join(entering, [self.host, "_pos"])
        df = df.withColumns({n: F.col(n) + F.col("before")[i] * weight * self.decay for i, n in enumerate(inputs)})
        rows = Window.partitionBy(self.host, "_pos").orderBy(self.order)
        df = df.withColumns({f"_before_{n}": F.when(place == 0, F.col("before")[i]).otherwise(F.lag(n).over(rows)) for i, n in enumerate(inputs)})
        return df.drop("before", "_pos", "_block")


def ewma_history(
    obs: DataFrame, columns: Sequence[str] = tuple(OBSERVED), alpha: float = 0.3, host: str = "host", order: str = "window_id",
    between: tuple[int, int] | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Mean and variance of every column after each window in which the host is active.

    The first observation sets mean = x and variance = 1; later ones update
    mean += alpha * (x - mean) and var = (1 - alpha) * (var + alpha * (x - mean)^2). Gaps do not decay.
    Columns: ``mean_<c>``, ``var_<c>`` after the window; ``prior_mean_<c>``, ``prior_var_<c>`` before it.

    One row per host and window is expected. ``between`` names the least and greatest window, if the caller knows them, and saves a pass. No
    task orders more than ``chunk`` windows of a host at once; if all windows lie in one chunk, it is one shuffle and no join.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha lies between 0 and 1")
    decay = 1.0 - alpha
    if between is None:
        between = tuple(obs.agg(F.min(order), F.max(order)).first())
    low, high = (0, 0) if between[0] is None else (between[0] // chunk, between[1] // chunk)
    inside = Window.partitionBy(host, "_chunk").orderBy(order)
    df = obs.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_at", F.row_number().over(inside) - 1)
    if low == high:
        df = df.withColumn("earlier_windows", F.col("_at"))
    else:
        counts = obs.groupBy(host, F.floor(F.col(order) / chunk).alias("pos")).agg(F.count("*").cast("double").alias("n"))
        counts = counts.select(host, "pos", F.array(F.lit(1.0)).alias("a"), F.array("n").alias("b"))
        earlier = affine_prefix(counts, [host], low, high).select(host, F.col("pos").alias("_chunk"), F.col("before")[0].cast("int").alias("_earlier"))
        df = df.join(earlier, [host, "_chunk"]).withColumn("earlier_windows", F.col("_at") + F.col("_earlier")).drop("_earlier")
    first = F.col("earlier_windows") == 0
    scan = _Recurrence(decay, host, order, low, high, chunk)
    df = scan.solve(df, {f"mean_{c}": F.when(first, F.col(c)).otherwise(alpha * F.col(c)) for c in columns})
    df = df.withColumns({f"prior_mean_{c}": F.when(~first, F.col(f"_before_mean_{c}")) for c in columns})
    step = {c: decay * alpha * F.pow(F.col(c) - F.col(f"prior_mean_{c}"), 2) for c in columns}
    df = scan.solve(df, {f"var_{c}": F.when(first, F.lit(1.0)).otherwise(step[c]) for c in columns})
    df = df.withColumns({f"prior_var_{c}": F.when(~first, F.col(f"_before_var_{c}")) for c in columns})
    return df.drop("_chunk", "_at", *[f"_before_{k}_{c}" for k in ("mean", "var") for c in columns])


def ewma_zscore(history: DataFrame, columns: Sequence[str] = tuple(OBSERVED)) -> DataFrame:
    """z of every column against the history before the window, within ±10; 0 on the first window."""

    def z(c: str) -> Column:
        spread = F.sqrt(F.greatest(F.col(f"prior_var_{c}"), F.lit(VARIANCE_FLOOR)))
        raw = (F.col(c) - F.col(f"prior_mean_{c}")) / spread
        # greatest and least pass over NULL, so the first window is decided before they see it.
        return F.when(raw.isNull(), F.lit(0.0)).otherwise(F.greatest(F.least(raw, F.lit(Z_LIMIT)), F.lit(-Z_LIMIT)))

    return history.withColumns({f"z_{c[4:] if c.startswith('log_') else c}": z(c) for c in columns})


def peer_novelty(ends: DataFrame) -> DataFrame:
    """Share of a host's peers in a window that it never met before. No state: a peer is new in the
    window of its first meeting, a minimum per (host, peer) over rows already reduced to one per window."""
    first = F.min("window_id").over(Window.partitionBy("host", "peer"))
    flagged = ends.select("window_id", "host", "peer").withColumn("_new", (F.col("window_id") == first).cast("double"))
    return flagged.groupBy("window_id", "host").agg(F.avg("_new").alias("peer_novelty"))


def host_age(df: DataFrame, mode: str = "elapsed", cap: float | None = None) -> DataFrame:
    """log(1 + age): windows since the host was first seen, or earlier windows in which it was active."""
    if mode not in ("elapsed", "active"):
        raise ValueError(f"unknown age mode {mode}")
    if mode == "active":
        age = F.row_number().over(Window.partitionBy("host").orderBy("window_id")) - 1
    else:
        age = F.col("window_id") - F.min("window_id").over(Window.partitionBy("host"))
    age = age.cast("double")
    return df.withColumn("log_age_windows", F.log1p(age if cap is None else F.least(age, F.lit(float(cap)))))


def first_seen_flag(df: DataFrame) -> DataFrame:
    first = F.min("window_id").over(Window.partitionBy("host"))
    return df.withColumn("is_first_seen", (F.col("window_id") == first).cast("double"))
