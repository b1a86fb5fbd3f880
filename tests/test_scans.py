"""Recurrences over many chunks against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.scans import affine_prefix
from flowlens.operators import history as H


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_prefix_of_maps(spark, fan):
    rng = random.Random(1)
    rows, want = [], {}
    for key in ("a", "b", None):
        s = [0.0, 0.0]
        for pos in sorted(rng.sample(range(10, 75), 40 if key else 1)):
            a, b = [rng.choice([0.0, 0.5, 1.0]), rng.random()], [rng.random(), -rng.random()]
            want[key, pos] = list(s)
            s = [x * y + z for x, y, z in zip(s, a, b)]
            rows.append((key, pos, a, b))
    rows = [r for r in rows if r[0]]
    rng.shuffle(rows)
    maps = spark.createDataFrame(rows, "k string, pos bigint, a array<double>, b array<double>")
    got = {(r.k, r.pos): r.before for r in affine_prefix(maps, ["k"], 10, 74, fan).collect()}
    assert got.keys() == {k for k in want if k[0]}
    assert all(got[k] == pytest.approx(want[k], abs=1e-14) for k in got)


def plain(values, alpha):
    mean, var, out = values[0], 1.0, [(values[0], 1.0, None, None)]
    for x in values[1:]:
        gap = x - mean
        out.append((mean + alpha * gap, (1 - alpha) * (var + alpha * gap * gap), mean, var))
        mean, var = out[-1][:2]
    return out


@pytest.mark.parametrize("alpha", [0.0, 1e-6, 0.05, 0.3, 0.97, 1 - 1e-9, 1.0])
def test_history_over_chunks_and_blocks(spark, alpha):
    rng = random.Random(2)
    hosts = {h: {w: rng.random() * 9 if rng.random() < 0.8 else 4.0 for w in rng.sample(range(-300, 900), n)} for h, n in (("a", 900), ("b", 1), ("c", 40))}
    rows = [(h, w, x) for h, xs in hosts.items() for w, x in xs.items()]
    obs = spark.createDataFrame(rows, "host string, window_id bigint, x double")
    for chunk in (64, H.CHUNK):
        got = {}
        for r in H.ewma_history(obs, ["x"], alpha, chunk=chunk).collect():
            got[r.host, r.window_id] = (r.earlier_windows, r.mean_x, r.var_x, r.prior_mean_x, r.prior_var_x)
        assert len(got) == len(rows)
        for h, xs in hosts.items():
            for i, (w, values) in enumerate(zip(sorted(xs), plain([xs[w] for w in sorted(xs)], alpha))):
                assert got[h, w][0] == i
                for a, b in zip(got[h, w][1:], values):
                    assert a == b if b is None else a == pytest.approx(b, rel=1e-12, abs=1e-12)


def test_a_long_host_is_spread(spark):
    n = 1_000_000
    value = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0
    obs = spark.range(n).select(F.lit("h").alias("host"), F.col("id").alias("window_id"), value.alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = H.ewma_history(obs, ["x"], 0.01).select("window_id", "x", "mean_x", "var_x", F.spark_partition_id().alias("part")).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.groupby("part").size().max() < 0.5 * n  # of four tasks
    out = out.sort_values("window_id")
    x, mean, var = out.x.to_numpy(), out.x.iloc[0], 1.0
    for i in range(1, n):
        gap = x[i] - mean
        mean, var = mean + 0.01 * gap, 0.99 * (var + 0.01 * gap * gap)
    assert out.mean_x.iloc[-1] == pytest.approx(mean, rel=1e-12) and out.var_x.iloc[-1] == pytest.approx(var, rel=1e-12)
    assert np.isfinite(out.mean_x).all() and len(out) == n


def test_empty_history(spark):
    obs = spark.createDataFrame([], "host string, window_id bigint, x double")
    assert H.ewma_history(obs, ["x"]).count() == 0
