"""Role context and the assembled host context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.addresses import is_private
from flowlens.operators import graph as G
from flowlens.operators import history as H
from flowlens.tables import cut

# Names and order of the context columns per group.
STRUCTURAL = ["in_degree", "out_degree", "unique_peers", "pagerank", "clustering"]
BEHAVIOURAL = ["z_flows", "z_bytes", "z_ports", "z_peers", "peer_novelty", "log_age_windows", "is_first_seen"]
ROLE = ["is_private", "inbound_ratio", "server_port_share", "dst_port_entropy", "log_total_flows"]
TIME = ["tod_sin", "tod_cos"]


def context_names(structural: bool = True, behavioural: bool = True, role: bool = True, time: bool = False) -> list[str]:
    chosen = ((structural, STRUCTURAL), (behavioural, BEHAVIOURAL), (role, ROLE), (time, TIME))
    return [name for on, names in chosen if on for name in names]


def port_stats(ports: DataFrame) -> DataFrame:
    """Distinct ports, share of service ports and port entropy of the flows each host sent in a window.

    With n flows per port and N in all, the entropy is log2(N) - sum(n * log2 n) / N: one aggregation.
    """
    sent = F.sum("n").cast("double")
    service = F.sum(F.when(S.is_service_port(F.col("dst_port")), F.col("n")).otherwise(0))
    return ports.groupBy("window_id", "host").agg(
        F.count("*").alias("n_ports"),
        (service / sent).alias("server_port_share"),
        (F.log2(sent) - F.sum(F.col("n") * F.log2("n")) / sent).alias("dst_port_entropy"),
    )


def role_columns(df: DataFrame) -> DataFrame:
    """Role columns for rows with flows_in, flows_out and the port statistics."""
    total = F.col("flows_in") + F.col("flows_out")
    return df.withColumns(
        {
            "is_private": is_private(F.col("host")),
            "inbound_ratio": F.when(total > 0, F.col("flows_in") / total).otherwise(0.0),
            "server_port_share": F.coalesce("server_port_share", F.lit(0.0)),
            "dst_port_entropy": F.coalesce("dst_port_entropy", F.lit(0.0)),
            "log_total_flows": F.log1p(total),
        }
    )


def role_context(df: DataFrame) -> DataFrame:
    hosts = G.host_counts(G.endpoints(G.pair_table(df)))
    joined = hosts.join(port_stats(G.port_counts(df)), G.NODE, "left")
    return role_columns(joined).select(*G.NODE, *ROLE)


def time_context(df: DataFrame) -> DataFrame:
    """Sine and cosine of the UTC time of day of the first flow of each window."""
    angle = S.day_angle(F.col("first_ms"))
    first = df.groupBy("window_id").agg(F.min("start_ms").alias("first_ms"))
    return first.select("window_id", F.sin(angle).alias("tod_sin"), F.cos(angle).alias("tod_cos"))


def behavioural_context(df: DataFrame, alpha: float = 0.3, age_mode: str = "elapsed", age_cap: float | None = None) -> DataFrame:
    return host_context(df, structural=False, role=False, alpha=alpha, age_mode=age_mode, age_cap=age_cap)


def host_context(
    df: DataFrame, structural: bool = True, behavioural: bool = True, role: bool = True, time: bool = False,
    alpha: float = 0.3, age_mode: str = "elapsed", age_cap: float | None = None, iters: int = 30, damping: float = 0.85,
    grouped: bool = False,
) -> DataFrame:
    """All context columns per (window, host). Input: flows of kept windows with window_id.

    The flows are read twice: once for the pair table, which is written since four branches read it, and
    once for the port table. Tables per (window, host) share that partitioning, so their joins add no
    shuffle; the history comes last and moves the assembled rows once, to their host. ``grouped`` works small windows whole in tasks, see ``graph.structure``.
    """
    pairs = cut(G.pair_table(df), "pairs")
    ends = G.endpoints(pairs)
    if behavioural or structural:
        ends = cut(ends, "endpoints")
    table = G.host_counts(ends)
    if behavioural or role:
        table = table.join(port_stats(G.port_counts(df)), G.NODE, "left")
    if structural:
        table = G.structural_columns(table, pairs, ends, iters, damping, grouped)
    if role:
        table = role_columns(table)
    if behavioural:
        table = table.join(H.peer_novelty(ends), G.NODE)
        table = table.withColumns(
            {
                "log_flows": F.log1p(F.col("flows_in") + F.col("flows_out")), "log_bytes": F.log1p("bytes"),
                "log_ports": F.log1p(F.coalesce("n_ports", F.lit(0))), "log_peers": F.log1p("peers"),
            }
        )
        between = tuple(pairs.agg(F.min("window_id"), F.max("window_id")).first())
        table = H.first_seen_flag(H.host_age(H.ewma_zscore(H.ewma_history(table, alpha=alpha, between=between)), age_mode, age_cap))
    if time:
        table = table.join(time_context(df), "window_id")
    names = context_names(structural, behavioural, role, time)
    if not names:
        return table.select(*G.NODE, F.lit(1.0).alias("constant"))
    return table.select(*G.NODE, *names)
