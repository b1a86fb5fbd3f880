"""Distributed order helpers against plain sorting, with hot groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import ordering as O
from flowlens.functions import scalars as S


def test_positions_across_chunks(spark):
    ids = sorted(random.Random(1).sample(range(100_000), 3000))
    got = {r["window_id"]: (r["pos"], r["n_total"]) for r in O.positions(spark.createDataFrame([(i,) for i in ids], "window_id bigint")).collect()}
    assert got == {w: (i, 3000) for i, w in enumerate(ids)}


def test_running_and_quantiles(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else "cold", float(rng.randrange(50)) if rng.random() < 0.3 else rng.random()) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    tallies = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for down in (False, True):
        got = {(r["g"], r["v"]): r["cum_n"] for r in O.running(tallies, ["g"], "v", ["n"], descending=down).collect()}
        for g in ("hot", "cold"):
            values = np.array([v for k, v in rows if k == g])
            for v in set(values):
                assert got[(g, v)] == ((values >= v) if down else (values <= v)).sum()
    q = {r["g"]: r for r in O.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.99}).collect()}
    for g in ("hot", "cold"):
        values = [v for k, v in rows if k == g]
        assert np.allclose([q[g]["a"], q[g]["b"], q[g]["c"]], np.percentile(values, [5, 50, 99]))
    whole = O.quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert np.isclose(whole, np.median([v for _, v in rows]))


def test_places_and_ranks(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.7 else 1, f"h{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "w int, host string")
    got = {(r["w"], r["host"]): r["p"] for r in O.places(df, ["w"], ["host"], "p").collect()}
    for w in (0, 1):
        for i, h in enumerate(sorted(h for k, h in rows if k == w)):
            assert got[(w, h)] == i
    values = [rng.randrange(20) / 4 for _ in range(300)]
    tallies = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    ranks = {r["v"]: r["r"] for r in O.average_ranks(tallies, [], "v", "r").collect()}
    for v in set(values):
        below, same = sum(x < v for x in values), sum(x == v for x in values)
        assert ranks[v] == below + (same + 1) / 2


@pytest.mark.parametrize("digits,bucket", [(3, 250_000), (1, 20), (1, 1), (2, 7)])
def test_cut_keys_are_exact(spark, digits, bucket):
    rows = [("hot" if i % 10 else "cold", str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id string").withColumn("h", S.hash_order(5, F.col("id")))
    wanted = spark.createDataFrame([("hot", "a", 700), ("hot", "b", 1800), ("cold", "a", 0), ("cold", "b", 37)], "g string, cut string, k bigint")
    keys = {(r["g"], r["cut"]): r["upto_key"] for r in O.cut_keys(df, ["g"], "h", wanted, digits, bucket).collect()}
    for (g, c), k in {("hot", "a"): 700, ("hot", "b"): 1800, ("cold", "a"): 0, ("cold", "b"): 37}.items():
        assert df.where((F.col("g") == g) & (F.col("h") <= keys[(g, c)])).count() == k


@pytest.mark.parametrize("digits,bucket", [(3, 250_000), (1, 40), (1, 1)])
def test_hash_positions(spark, digits, bucket):
    df = spark.range(500).withColumn("id", F.col("id").cast("string"))
    got = O.hash_positions(df, S.hash_order(1, F.col("id")), "p", digits, bucket).withColumn("h", S.hash_order(1, F.col("id"))).orderBy("h").collect()
    assert [r["p"] for r in got] == list(range(1, 501))


def test_positions_of_equal_keys(spark):
    """Keys that are equal to the last digit cannot be divided and are still ranked."""
    df = spark.createDataFrame([(k,) for k in ["aa"] * 5 + ["ab", "b0", "00"]], "k string")
    got = O.hash_positions(df, F.col("k"), "p", 1, 1, 2).orderBy("p").collect()
    assert [r.p for r in got] == list(range(1, 9)) and [r.k for r in got] == sorted(["aa"] * 5 + ["ab", "b0", "00"])
