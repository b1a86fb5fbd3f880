"""Queries: window graphs and neighbourhood aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import context as X
from flowlens.operators import graph as G
from flowlens.operators import neighbors as N
from flowlens.plans.base import kept
from flowlens.plans.oracle import big, r6
from flowlens.plans.registry import query
from flowlens.sources import views as V
from flowlens.tables import cut


def _r(df, *columns):
    return [S.r6(F.col(c)).alias(c) for c in columns]


@query("edges", "SELECT window_id, flow_id, src_ip AS src, dst_ip AS dst FROM kept")
def _(spark, sf):
    return G.edges(kept(spark, sf))


@query("nodes", "SELECT window_id, host FROM hosts")
def _(spark, sf):
    return G.nodes(kept(spark, sf))


@query("local_node_ids", f"SELECT window_id, host, {big('row_number() OVER (PARTITION BY window_id ORDER BY host) - 1')} AS node FROM hosts")
def _(spark, sf):
    return G.local_node_ids(G.nodes(kept(spark, sf)))


def _hosts(spark, sf):
    return G.host_counts(G.endpoints(G.pair_table(kept(spark, sf))))


@query("degrees", f"SELECT window_id, host, {big('flows_in')} AS in_degree, {big('flows_out')} AS out_degree FROM hosts")
def _(spark, sf):
    return _hosts(spark, sf).select("window_id", "host", F.col("flows_in").alias("in_degree"), F.col("flows_out").alias("out_degree"))


@query("unique_peers", "SELECT window_id, host, peers FROM hosts")
def _(spark, sf):
    return _hosts(spark, sf).select("window_id", "host", "peers")


@query("bytes_per_host", f"SELECT window_id, host, {r6('bytes')} AS bytes FROM hosts")
def _(spark, sf):
    return _hosts(spark, sf).select("window_id", "host", S.r6(F.col("bytes")).alias("bytes"))


@query("dst_ports", f"SELECT window_id, host, ports AS n_ports, {big('coalesce(sent, 0)')} AS sent FROM hosts LEFT JOIN portstat USING (window_id, host)")
def _(spark, sf):
    df = kept(spark, sf)
    sent = G.port_counts(df).groupBy("window_id", "host").agg(F.count("*").alias("n_ports"), F.sum("n").alias("sent"))
    return G.nodes(df).join(sent, G.NODE, "left").na.fill(0, ["n_ports", "sent"])


@query("pagerank", f"SELECT window_id, host, {r6('rank * n')} AS pagerank FROM pr30")
def _(spark, sf):
    return G.pagerank(cut(G.pair_table(kept(spark, sf)))).select("window_id", "host", *_r(None, "pagerank"))


@query("pagerank_joins", f"SELECT window_id, host, {r6('rank * n')} AS pagerank FROM pr30")
def _(spark, sf):
    return G.pagerank(cut(G.pair_table(kept(spark, sf))), grouped=False).select("window_id", "host", *_r(None, "pagerank"))


@query("pagerank_grouped", f"SELECT window_id, host, {r6('rank * n')} AS pagerank FROM pr30")
def _(spark, sf):
    return G.pagerank(cut(G.pair_table(kept(spark, sf))), grouped=True).select("window_id", "host", *_r(None, "pagerank"))


# All order lines as flows from customers to parts in one window; a customer and a part of one number are one host.
_LARGE = {"kept": """SELECT 0::BIGINT AS window_id, 'h' || o_custkey AS src_ip, 'h' || l_partkey AS dst_ip, 0 AS dst_port, l_extendedprice AS in_bytes, l_quantity AS out_bytes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""}


@query("structure_large_window", f"SELECT host, {r6('rank * n')} AS pagerank, {big('k')} AS k, {big('triangles')} AS triangles FROM pr30 JOIN clust USING (window_id, host)", _LARGE)
def _(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("h"), "o_custkey").alias("src_ip"))
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("h"), "l_partkey").alias("dst_ip"), "l_extendedprice", "l_quantity")
    flows = lines.join(orders, "l_orderkey").select(F.lit(0).cast("bigint").alias("window_id"), "src_ip", "dst_ip", F.col("l_extendedprice").alias("in_bytes"), F.col("l_quantity").alias("out_bytes"))
    out = G.structure(cut(G.pair_table(flows)), numbered=True)
    return out.select("host", *_r(None, "pagerank"), "k", "triangles")


@query("clustering", f"SELECT window_id, host, {big('k')} AS k, {big('triangles')} AS triangles, {r6('clustering')} AS clustering FROM clust WHERE k > 0")
def _(spark, sf):
    ends = cut(G.endpoints(G.pair_table(kept(spark, sf))))
    return G.clustering(ends).select("window_id", "host", "k", "triangles", *_r(None, "clustering"))


_STRUCTURAL = ["in_degree", "out_degree", "unique_peers", "pagerank", "clustering"]


@query("structural_context", f"SELECT window_id, host, {', '.join(f'{r6(c)} AS {c}' for c in _STRUCTURAL)} FROM ctx")
def _(spark, sf):
    return G.structural_context(kept(spark, sf)).select("window_id", "host", *_r(None, *_STRUCTURAL))


_SIZES = {"sizes": "SELECT window_id, host, ln(1 + flows_in) AS in_degree, ln(1 + flows_out) AS out_degree, ln(1 + peers) AS unique_peers FROM hosts"}


def _sizes(df):
    hosts = G.host_counts(G.endpoints(G.pair_table(df)))
    return hosts.select(
        "window_id", "host", F.log1p("flows_in").alias("in_degree"), F.log1p("flows_out").alias("out_degree"), F.log1p("peers").alias("unique_peers")
    )


@query("endpoint_context", f"""
  SELECT flow_id, {', '.join(f'{r6(s + "." + c)} AS {s}__{c}' for s in ('src', 'dst') for c in ('in_degree', 'unique_peers'))}
  FROM kept JOIN sizes src ON src.window_id = kept.window_id AND src.host = src_ip JOIN sizes dst ON dst.window_id = kept.window_id AND dst.host = dst_ip""", _SIZES)
def _(spark, sf):
    df = kept(spark, sf)
    out = G.endpoint_context(df.select("flow_id", "window_id", "src_ip", "dst_ip"), _sizes(df), ["in_degree", "unique_peers"])
    return out.select("flow_id", *_r(None, "src__in_degree", "src__unique_peers", "dst__in_degree", "dst__unique_peers"))


@query("host_degree", f"SELECT window_id, host, {r6('flows_in + flows_out')} AS degree FROM hosts")
def _(spark, sf):
    return G.host_degree(_sizes(kept(spark, sf))).select("window_id", "host", *_r(None, "degree"))


@query("pair_table", f"SELECT window_id, src, dst, w FROM pairs")
def _(spark, sf):
    return G.pair_table(kept(spark, sf)).select("window_id", "src", "dst", "w")


_MSG = {
    **_SIZES,
    "msg": """SELECT window_id, flow_id, dst_ip AS receiver, src_ip AS sender, 1 AS received, l_discount, l_quantity FROM kept
      UNION ALL SELECT window_id, flow_id, src_ip, dst_ip, 0, l_discount, l_quantity FROM kept""",
    "msgn": "SELECT msg.*, in_degree, out_degree, unique_peers FROM msg JOIN sizes ON sizes.window_id = msg.window_id AND sizes.host = msg.sender",
}


@query("both_directions", "SELECT window_id, flow_id, receiver, sender, CAST(received AS INTEGER) AS received FROM msg", _MSG)
def _(spark, sf):
    return N.both_directions(kept(spark, sf), ["flow_id"])


_AGG = ["in_degree", "unique_peers", "l_discount", "l_quantity"]


def _agg_sql(fn: str) -> str:
    return f"SELECT window_id, receiver AS host, {', '.join(f'{r6(f'{fn}({c})')} AS agg__{c}' for c in _AGG)} FROM msgn GROUP BY ALL"


@query("neighbor_mean", _agg_sql("avg"), _MSG)
def _(spark, sf):
    df = kept(spark, sf)
    out = N.neighbor_mean(_sizes(df), df, _AGG[:2], _AGG[2:])
    return out.select("window_id", "host", *_r(None, *[f"agg__{c}" for c in _AGG]))


@query("neighbor_max", _agg_sql("max"), _MSG)
def _(spark, sf):
    df = kept(spark, sf)
    out = N.neighbor_max(_sizes(df), df, _AGG[:2], _AGG[2:])
    return out.select("window_id", "host", *_r(None, *[f"agg__{c}" for c in _AGG]))


@query("neighbor_agg_directed", f"""
  SELECT window_id, receiver AS host, {', '.join(f"{r6(f'coalesce(avg({c}) FILTER (received = {b}), 0)')} AS {p}__{c}" for p, b in (('in', 1), ('out', 0)) for c in ('in_degree', 'l_discount'))}
  FROM msgn GROUP BY ALL""", _MSG)
def _(spark, sf):
    df = kept(spark, sf)
    out = N.neighbor_agg(_sizes(df), df, ["in_degree"], ["l_discount"], "mean", direction_aware=True)
    return out.select("window_id", "host", *_r(None, "in__in_degree", "in__l_discount", "out__in_degree", "out__l_discount"))


@query("segment_softmax", f"""
  SELECT window_id, flow_id, received, {r6('e / sum(e) OVER (PARTITION BY window_id, receiver)')} AS alpha FROM
  (SELECT *, exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY window_id, receiver)) AS e FROM msg)""", _MSG)
def _(spark, sf):
    msgs = N.both_directions(kept(spark, sf), ["flow_id", "l_quantity"]).withColumn("score", F.col("l_quantity") / 10)
    return N.segment_softmax(msgs, "score").select("window_id", "flow_id", "received", *_r(None, "alpha"))


@query("softmax_mean", f"""
  SELECT window_id, receiver AS host, {r6('sum(e * l_discount) / sum(e)')} AS l_discount FROM
  (SELECT *, exp(l_quantity / 10 - max(l_quantity / 10) OVER (PARTITION BY window_id, receiver)) AS e FROM msg) GROUP BY ALL""", _MSG)
def _(spark, sf):
    msgs = N.both_directions(kept(spark, sf), ["l_discount", "l_quantity"]).withColumn("score", F.col("l_quantity") / 10)
    return N.softmax_mean(msgs, "score", ["l_discount"]).select("window_id", F.col("receiver").alias("host"), *_r(None, "l_discount"))


@query("khop", f"""
  SELECT h.window_id, h.host, {r6('any_value(h.h1)')} AS hop1__in_degree, {r6('avg(s.h1)')} AS hop2__in_degree FROM hop1 h JOIN msg ON msg.window_id = h.window_id AND msg.receiver = h.host
  JOIN hop1 s ON s.window_id = msg.window_id AND s.host = msg.sender GROUP BY h.window_id, h.host""",
       {**_MSG, "hop1": "SELECT window_id, receiver AS host, avg(in_degree) AS h1 FROM msgn GROUP BY ALL"})
def _(spark, sf):
    df = kept(spark, sf)
    out = N.khop(_sizes(df), df, ["in_degree"], 2)
    return out.select("window_id", "host", *_r(None, "hop1__in_degree", "hop2__in_degree"))


@query("edge_classifier_frame", f"""
  SELECT flow_id, {r6('src.in_degree')} AS src__in_degree, {r6('dst.out_degree')} AS dst__out_degree, {r6('l_tax')} AS l_tax
  FROM kept JOIN sizes src ON src.window_id = kept.window_id AND src.host = src_ip JOIN sizes dst ON dst.window_id = kept.window_id AND dst.host = dst_ip""", _SIZES)
def _(spark, sf):
    df = kept(spark, sf)
    out = N.edge_classifier_frame(df, _sizes(df), ["in_degree", "out_degree"], ["l_tax"])
    return out.select("flow_id", *_r(None, "src__in_degree", "dst__out_degree", "l_tax"))


_GROUPS = {"structural": X.STRUCTURAL, "context": X.STRUCTURAL + X.BEHAVIOURAL + X.ROLE}


@query("node_init_variants", f"""
  SELECT variant, count(*) AS nodes, {big('sum(n_cols)')} AS cells, (round(sum(total), 3) + 0.0) AS total FROM (
    SELECT 'none' AS variant, 0 AS n_cols, 0.0::DOUBLE AS total FROM hosts UNION ALL SELECT 'constant', 1, 1.0::DOUBLE FROM hosts
    {' '.join(f"UNION ALL SELECT '{v}', {len(names)}, {' + '.join(names)} FROM ctx" for v, names in _GROUPS.items())}) GROUP BY variant""")
def _(spark, sf):
    nodes = cut(X.host_context(kept(spark, sf)))
    out = None
    for variant in ("none", "constant", *_GROUPS):
        table, names = N.node_init(nodes, variant)
        total = sum((F.col(c) for c in names), F.lit(0.0))
        row = table.agg(F.count("*").alias("nodes"), F.sum(F.lit(len(names))).cast("bigint").alias("cells"), (F.round(F.sum(total), 3) + 0.0).alias("total"))
        row = row.select(F.lit(variant).alias("variant"), "nodes", "cells", "total")
        out = row if out is None else out.unionByName(row)
    return out
