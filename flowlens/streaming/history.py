"""Host history on a stream: window counts close with the watermark, then update a state per host.

State per host is four means and variances, the first window and the number of active windows, plus one
entry per peer ever met; peers live in the state store (RocksDB), not in memory. A host's rows of one
micro-batch are its closed windows times their peers, bounded by the trigger's input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators.history import VARIANCE_FLOOR, Z_LIMIT

OUTPUT = (
    "host string, window_id bigint, z_flows double, z_bytes double, z_ports double, z_peers double, "
    "peer_novelty double, log_age_windows double, is_first_seen double"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(flows: DataFrame, watermark: str) -> DataFrame:
    """Event time from start_ms, with the time to wait for late flows."""
    moment = F.timestamp_micros(F.round(F.col("start_ms") * 1000).cast("bigint"))
    return flows.withColumn("event_time", moment).withWatermark("event_time", watermark)


def _span(micros: int) -> str:
    return f"{micros} microseconds"


def window_pairs(flows: DataFrame, seconds: int, origin_ms: float) -> DataFrame:
    """Streaming counts per (window, host, peer). The origin of the windows is given by the caller, since a
    stream has no earliest flow; distinct ports are bounded by the 65,536 port numbers."""
    width = int(seconds) * 1_000_000
    origin = round(origin_ms * 1000)
    side = lambda host, peer, sent: F.struct(F.col(host).alias("host"), F.col(peer).alias("peer"), F.lit(sent).alias("sent"))
    both = F.explode(F.array(side("src_ip", "dst_ip", 1), side("dst_ip", "src_ip", 0)))
    ends = flows.select("event_time", "in_bytes", "out_bytes", "dst_port", both.alias("e")).select("*", "e.*")
    span = F.window("event_time", _span(width), startTime=_span(origin % width))
    counts = ends.groupBy(span.alias("w"), "host", "peer").agg(
        F.count("*").alias("flows"), F.sum(F.col("in_bytes") + F.col("out_bytes")).alias("bytes"),
        F.collect_set(F.when(F.col("sent") == 1, F.col("dst_port"))).alias("ports"),
    )
    start = F.unix_micros("w.start") - F.lit(origin)
    return counts.select(F.floor(start / width).alias("window_id"), "host", "peer", "flows", "bytes", "ports")


class HostHistory(StatefulProcessor):
    """Read the past, emit, update: window by window in time order."""

    def __init__(self, alpha: float = 0.3) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stats = handle.getValueState("stats", "means array<double>, variances array<double>, first_window bigint")
        self.peers = handle.getMapState("peers", "peer string", "first_window bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        past = self.stats.get() if self.stats.exists() else None
        means, variances, first = (list(past[0]), list(past[1]), past[2]) if past else (None, None, None)
        out = []
        for window, part in batch.groupby("window_id", sort=True):
            window = int(window)
            ports = {int(p) for ps in part["ports"] for p in ps}
            x = [math.log1p(float(v)) for v in (part["flows"].sum(), part["bytes"].sum(), len(ports), len(part))]
            fresh = 0
            for peer in part["peer"]:
                if not self.peers.containsKey((peer,)):
                    fresh += 1
                    self.peers.updateValue((peer,), (window,))
            if means is None:
                z, first = [0.0] * 4, window
                means, variances = list(x), [1.0] * 4
            else:
                gap = [v - m for v, m in zip(x, means)]
                z = [max(-Z_LIMIT, min(Z_LIMIT, g / math.sqrt(max(v, VARIANCE_FLOOR)))) for g, v in zip(gap, variances)]
                means = [m + self.alpha * g for m, g in zip(means, gap)]
                variances = [(1 - self.alpha) * (v + self.alpha * g * g) for v, g in zip(variances, gap)]
            out.append((key[0], window, *z, fresh / len(part), math.log1p(window - first), float(window == first)))
        self.stats.update((means, variances, first))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def host_history_stream(flows: DataFrame, seconds: int, origin_ms: float, watermark: str = "10 minutes", alpha: float = 0.3) -> DataFrame:
    """Behavioural context of every (host, window), emitted when the watermark closes the window.

    Flows later than the watermark are dropped; :func:`flowlens.operators.windows.late_flows` says how
    long to wait. A window's total is not known per host, so small windows are not filtered here.
    """
    pairs = window_pairs(timed(flows, watermark), seconds, origin_ms)
    return pairs.groupBy("host").transformWithStateInPandas(
        statefulProcessor=HostHistory(alpha), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def sessions_stream(flows: DataFrame, key: str = "src_ip", gap: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Sessions per source on a stream with their flows and attacks; closed when the watermark passes."""
    spans = timed(flows, watermark).groupBy(F.session_window("event_time", gap).alias("s"), key).agg(
        F.count("*").alias("flows"), F.sum("label").alias("attack_flows")
    )
    return spans.select(key, F.unix_micros("s.start").alias("start_us"), "flows", "attack_flows")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything that has arrived, append the results as Parquet, and read them back."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
