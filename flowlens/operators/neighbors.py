"""Neighbourhood aggregation on window graphs, as joins and group-bys.

Parallel flows collapse to pairs before the join, so a node row meets one row per neighbour and not one
per flow; flow columns travel as their sum and maximum per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.context import BEHAVIOURAL, ROLE, STRUCTURAL
from flowlens.tables import cut

KEY = ["window_id", "receiver"]


def both_directions(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Every flow as a message to its destination (``received``) and one to its source (``sent``)."""
    way = lambda to, frm, received: F.struct(
        F.col(to).alias("receiver"), F.col(frm).alias("sender"), F.lit(received).alias("received")
    )
    both = F.explode(F.array(way("dst_ip", "src_ip", 1), way("src_ip", "dst_ip", 0)))
    return df.select("window_id", *columns, both.alias("m")).select("window_id", "m.*", *columns)


def messages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Messages collapsed to (window, receiver, sender, direction) with count, sums and maxima."""
    parts = [F.count("*").alias("w")]
    for c in columns:
        parts += [F.sum(c).alias(f"sum__{c}"), F.max(c).alias(f"max__{c}")]
    pairs = df.groupBy("window_id", "src_ip", "dst_ip").agg(*parts)
    return both_directions(pairs, [c for c in pairs.columns if c not in ("window_id", "src_ip", "dst_ip")])


def _with_senders(nodes: DataFrame, msgs: DataFrame, node_columns: Sequence[str]) -> DataFrame:
    side = nodes.select("window_id", F.col("host").alias("sender"), *[F.col(c).alias(f"node__{c}") for c in node_columns])
    return msgs.join(side, ["window_id", "sender"])


def _reduce(msgs: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str], how: str, only: Column | None, prefix: str) -> list[Column]:
    pick = lambda c: c if only is None else F.when(only, c)
    if how == "mean":
        n = F.greatest(F.coalesce(F.sum(pick(F.col("w"))), F.lit(0)), F.lit(1))
        node = [(F.coalesce(F.sum(pick(F.col("w") * F.col(f"node__{c}"))), F.lit(0.0)) / n).alias(f"{prefix}{c}") for c in node_columns]
        edge = [(F.coalesce(F.sum(pick(F.col(f"sum__{c}"))), F.lit(0.0)) / n).alias(f"{prefix}{c}") for c in edge_columns]
        return node + edge
    if how == "max":
        node = [F.coalesce(F.max(pick(F.col(f"node__{c}"))), F.lit(0.0)).alias(f"{prefix}{c}") for c in node_columns]
        edge = [F.coalesce(F.max(pick(F.col(f"max__{c}"))), F.lit(0.0)).alias(f"{prefix}{c}") for c in edge_columns]
        return node + edge
    raise ValueError(f"unknown aggregate {how}")


def neighbor_agg(
    nodes: DataFrame, df: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str] = (), how: str = "mean",
    direction_aware: bool = False,
) -> DataFrame:
    """Mean or maximum over all messages to a host of [sender columns, flow columns]; 0 without messages.

    With ``direction_aware`` received and sent flows are reduced apart.
    """
    joined = _with_senders(nodes, messages(df, edge_columns), node_columns)
    if direction_aware:
        parts = _reduce(joined, node_columns, edge_columns, how, F.col("received") == 1, "in__") + _reduce(
            joined, node_columns, edge_columns, how, F.col("received") == 0, "out__"
        )
    else:
        parts = _reduce(joined, node_columns, edge_columns, how, None, "agg__")
    reduced = joined.groupBy(*KEY).agg(*parts).withColumnRenamed("receiver", "host")
    names = [c for c in reduced.columns if c not in ("window_id", "host")]
    out = nodes.join(reduced, ["window_id", "host"], "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def neighbor_mean(nodes: DataFrame, df: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str] = ()) -> DataFrame:
    return neighbor_agg(nodes, df, node_columns, edge_columns, "mean")


def neighbor_max(nodes: DataFrame, df: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str] = ()) -> DataFrame:
    return neighbor_agg(nodes, df, node_columns, edge_columns, "max")


#: A receiver with more than one of so many messages has them dealt over several salts; no more receivers than that can have so many.
SHARES = 64


class _Spread:
    """Messages with a salt ``_salt``: 0 for most receivers, several for those with many messages.

    The list of receivers with many messages has ``shares`` rows at most and is written, so that its size is known.
    """

    def __init__(self, msgs: DataFrame, shares: int):
        counts = cut(msgs.groupBy(*KEY).agg(F.count("*").alias("_n")), "receivers")
        total = counts.agg(F.sum("_n")).first()[0] or 0
        per = max(1, total // shares)
        self.large = cut(counts.where(F.col("_n") > per).select(*KEY, F.ceil(F.col("_n") / per).cast("int").alias("_salts")), "large")
        # Any salt of its receiver will do for a message, so a task that runs again may draw another one.
        salt = F.floor(F.rand() * F.coalesce("_salts", F.lit(1))).cast("int")
        self.msgs = msgs.join(self.large, KEY, "left").withColumn("_salt", salt).drop("_salts")

    def every_salt(self, table: DataFrame) -> DataFrame:
        """A table with one row per receiver, copied for every salt of it."""
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        return table.join(self.large, KEY, "left").withColumn("_salt", salts).drop("_salts")


def softmax_states(msgs: DataFrame, score: str, values: Sequence[str] = ()) -> DataFrame:
    """(window, receiver, salt) with the peak of the scores, ``_total`` = sum of exp(score - peak), and that sum weighted by every value.

    Two such states of one receiver merge: both are lowered to the higher peak and added.
    """
    salted = [*KEY, "_salt"]
    raised = msgs.withColumn("_peak", F.max(score).over(Window.partitionBy(*salted))).withColumn("_e", F.exp(F.col(score) - F.col("_peak")))
    sums = [F.sum("_e").alias("_total"), *[F.sum(F.col("_e") * F.col(v)).alias(f"_sum_{v}") for v in values]]
    return raised.groupBy(*salted).agg(F.max("_peak").alias("_peak"), *sums)


def merged_states(states: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """One state per receiver, from at most as many as it has salts."""
    sums = ["_total", *[f"_sum_{v}" for v in values]]
    held = states.groupBy(*KEY).agg(F.max("_peak").alias("_peak"), F.collect_list(F.struct("_peak", *sums)).alias("_parts"))

    def lowered(name: str) -> Column:
        return F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + F.coalesce(p[name] * F.exp(p["_peak"] - F.col("_peak")), F.lit(0.0)))

    return held.select(*KEY, "_peak", *[lowered(n).alias(n) for n in sums])


def segment_softmax(msgs: DataFrame, score: str, out: str = "alpha", shares: int = SHARES) -> DataFrame:
    """Softmax of a score over the messages of each receiver.

    Messages of a receiver with more than one of ``shares`` of them are dealt over salts; every salt has a state (peak, total), the states of a
    receiver are merged, and the merged one goes back to all its salts. So no task holds a receiver with very many messages.
    """
    spread = _Spread(msgs, shares)
    back = spread.every_salt(merged_states(softmax_states(spread.msgs, score)))
    joined = spread.msgs.join(back, [*KEY, "_salt"])
    return joined.withColumn(out, F.exp(F.col(score) - F.col("_peak")) / F.greatest("_total", F.lit(1e-16))).drop("_peak", "_total", "_salt")


def softmax_mean(msgs: DataFrame, score: str, values: Sequence[str], shares: int = SHARES) -> DataFrame:
    """Softmax-weighted sum of values per receiver: the merged states have it, nothing goes back to the messages."""
    merged = merged_states(softmax_states(_Spread(msgs, shares).msgs, score, values), values)
    return merged.select(*KEY, *[(F.col(f"_sum_{v}") / F.greatest("_total", F.lit(1e-16))).alias(v) for v in values])


def khop(nodes: DataFrame, df: DataFrame, columns: Sequence[str], k: int = 2, how: str = "mean") -> DataFrame:
    """Repeated neighbourhood aggregation: ``hop1__c`` ... ``hopk__c`` beside the node columns."""
    out, current = nodes.select("window_id", "host", *columns), list(columns)
    msgs = cut(messages(df, []))
    for hop in range(1, k + 1):
        joined = _with_senders(out, msgs, current)
        reduced = joined.groupBy(*KEY).agg(*_reduce(joined, current, [], how, None, "agg__")).withColumnRenamed("receiver", "host")
        named = reduced.select("window_id", "host", *[F.col(f"agg__{c}").alias(f"hop{hop}__{columns[i]}") for i, c in enumerate(current)])
        current = [f"hop{hop}__{c}" for c in columns]
        out = out.join(named, ["window_id", "host"], "left").na.fill(0.0, current)
        if hop < k:
            out = cut(out)
    return out


def edge_classifier_frame(df: DataFrame, nodes: DataFrame, node_columns: Sequence[str], flow_columns: Sequence[str], keep: Sequence[str] = ("flow_id",)) -> DataFrame:
    """[source node columns, destination node columns, flow columns] per flow."""
    out = df.select("window_id", "src_ip", "dst_ip", *keep, *flow_columns)
    for side, key in (("src", "src_ip"), ("dst", "dst_ip")):
        named = nodes.select("window_id", F.col("host").alias(key), *[F.col(c).alias(f"{side}__{c}") for c in node_columns])
        out = out.join(named, ["window_id", key])
    return out


def node_init(nodes: DataFrame, variant: str) -> tuple[DataFrame, list[str]]:
    """Node columns a model variant starts from: none, constant ones, structural columns or the whole context."""
    if variant == "none":
        return nodes.select("window_id", "host"), []
    if variant == "constant":
        return nodes.select("window_id", "host", F.lit(1.0).alias("constant")), ["constant"]
    groups = {"structural": STRUCTURAL, "context": STRUCTURAL + BEHAVIOURAL + ROLE}
    if variant not in groups:
        raise ValueError(f"unknown variant {variant}")
    missing = [c for c in groups[variant] if c not in nodes.columns]
    if missing:
        raise ValueError(f"the node table lacks {missing}")
    return nodes.select("window_id", "host", *groups[variant]), groups[variant]
