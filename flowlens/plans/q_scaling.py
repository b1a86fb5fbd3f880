"""Queries: standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import scaling as Z
from flowlens.plans.base import labelled
from flowlens.plans.oracle import r6
from flowlens.plans.registry import query
from flowlens.sources.views import FEATURES


@query("standardise_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'avg({c})')} AS mean, {r6(f'CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END')} AS std FROM lab WHERE split = 0" for c in FEATURES))
def _(spark, sf):
    fit = Z.standardise_fit(labelled(spark, sf), FEATURES, F.col("split") == 0)
    return Z.standardise_table(fit, FEATURES).select("feature", S.r6(F.col("mean")).alias("mean"), S.r6(F.col("std")).alias("std"))


@query("standardise_apply", f"""
  SELECT flow_id, {', '.join(f"{r6(f'({c} - (SELECT avg({c}) FROM lab WHERE split = 0)) / (SELECT stddev_pop({c}) FROM lab WHERE split = 0)')} AS {c}" for c in FEATURES)} FROM lab""")
def _(spark, sf):
    df = labelled(spark, sf).select("flow_id", "split", *FEATURES)
    out = Z.standardise_apply(df, Z.standardise_fit(df, FEATURES, F.col("split") == 0), FEATURES)
    return out.select("flow_id", *[S.r6(F.col(c)).alias(c) for c in FEATURES])


@query("training_node_statistics", f"""
  SELECT {r6('avg(ln(1 + flows_in))')} AS mean, {r6('stddev_pop(ln(1 + flows_in))')} AS std, count(*) AS nodes FROM hosts WHERE window_id IN (SELECT window_id FROM lab WHERE split = 0)""")
def _(spark, sf):
    from flowlens.operators import graph as G

    df = labelled(spark, sf)
    nodes = G.host_counts(G.endpoints(G.pair_table(df))).select("window_id", "host", F.log1p("flows_in").alias("x"))
    train = Z.training_nodes(nodes, df)
    fit = Z.standardise_fit(train, ["x"])
    return fit.select(S.r6(F.col("mean__x")).alias("mean"), S.r6(F.col("std__x")).alias("std")).withColumn("nodes", train.agg(F.count("*").alias("n")).scalar())
