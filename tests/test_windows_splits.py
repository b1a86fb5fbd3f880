"""Windows, sessions and splits on hand-made rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import splits as T
from flowlens.operators import windows as W


def windows(spark, n):
    return spark.range(n).select(F.col("id").alias("window_id"), F.col("id").alias("pos"), F.lit(n).cast("bigint").alias("n_windows"))


def codes(df):
    return [r["split"] for r in df.orderBy("window_id").collect()]


def test_windows_start_at_the_first_flow(spark):
    df = spark.createDataFrame([(1000.0,), (60_999.0,), (61_000.0,), (200_000.0,)], "start_ms double")
    assert [r["window_id"] for r in W.assign_windows(df, 60).orderBy("start_ms").collect()] == [0, 0, 1, 3]
    assert W.window_table(W.assign_windows(df, 60)).collect()[0]["window_id"] == 0


def test_min_flows_and_max_windows(spark):
    df = spark.createDataFrame([(w,) for w in (0, 0, 1, 2, 2, 3, 3, 3)], "window_id bigint")
    assert sorted(r[0] for r in W.min_flows_filter(df).distinct().collect()) == [0, 2, 3]
    assert sorted(r[0] for r in W.max_windows(df, 2).distinct().collect()) == [0, 2]


def test_session_gap_is_exclusive(spark):
    hour = 3_600_000.0
    df = spark.createDataFrame([(0.0, 0), (hour, 1), (2 * hour + 1, 0), (2 * hour + 2, 1)], "start_ms double, label int")
    got = [(r["start_ms"], r["end_ms"], r["flows"], r["attack_flows"]) for r in W.sessionize(df).orderBy("session_id").collect()]
    assert got == [(0.0, hour, 2, 1), (2 * hour + 1, 2 * hour + 2, 2, 1)]


def test_sessions_match_a_plain_scan(spark):
    rng = random.Random(7)
    times, t = [], 0.0
    for _ in range(600):
        t += rng.choice([1.0, 50.0, 400.0, 999.0, 1000.0, 1001.0, 3500.0])
        times.append(t)
    plain, last = [], None
    for t in times:
        if last is None or t - last > 1000.0:
            plain.append([t, t, 0])
        plain[-1][1], plain[-1][2], last = t, plain[-1][2] + 1, t
    df = spark.createDataFrame([(t, 0) for t in times], "start_ms double, label int").repartition(4)
    got = [[r["start_ms"], r["end_ms"], r["flows"]] for r in W.sessionize(df, 1000.0).orderBy("session_id").collect()]
    assert got == plain


def test_chronological_counts(spark):
    assert codes(T.split_chronological(windows(spark, 10))) == [0] * 7 + [1] + [2] * 2


@pytest.mark.parametrize("n", [2, 5, 9, 10, 37, 100, 101])
def test_blocked_split_by_hand(spark, n):
    expected = []
    blocks = 1 if n < 3 else max(1, min(10, n // 3))
    per = max(1, n // blocks)
    for b in range(blocks):
        size = n - b * per if b == blocks - 1 else per
        if size < 3:
            expected += [0] * size
            continue
        val, test = max(1, math.floor(size * 0.1)), max(1, math.floor(size * 0.2))
        train = max(1, size - val - test)
        val = min(val, size - train)
        expected += [0] * train + [1] * val + [2] * (size - train - val)
    assert codes(T.split_blocked(windows(spark, n))) == expected


def test_random_flow_split_rounds_half_to_even(spark):
    df = spark.createDataFrame([(str(i), 0) for i in range(5)] + [(f"b{i}", 1) for i in range(100)], "flow_id string, target int")
    got = T.split_random_flows(df, 42).groupBy("target", "split").count().collect()
    assert {(r["target"], r["split"]): r["count"] for r in got} == {(0, 0): 4, (0, 2): 1, (1, 0): 70, (1, 1): 10, (1, 2): 20}


def test_sample_keeps_attacks_and_marks_the_rest(spark):
    df = spark.createDataFrame([(str(i), int(i % 9 == 0), 0) for i in range(900)], "flow_id string, target int, split int")
    taken = T.sample_keep_attacks(df, 300, 1)
    assert taken.count() == 300 and taken.where("target > 0").count() == 100
    marked = T.mark_unused(df, 300, 1)
    kept = {r[0] for r in marked.where("split = 0").select("flow_id").collect()}
    assert kept == {r[0] for r in taken.select("flow_id").collect()}


def test_class_quotas(spark):
    def most(sizes, budget):
        table = spark.createDataFrame([(c + 1, n) for c, n in enumerate(sizes)], "target int, n bigint")
        return max(r["k"] for r in T.class_quotas(table, budget).collect())

    assert most([10, 20, 1000], 300) == 270
    assert most([100, 120, 30], 300) == 120
    assert most([500, 500, 500], 300) == 100


def test_capped_sample_keeps_rare_classes(spark):
    sizes = {0: 400, 1: 300, 2: 5}
    df = spark.createDataFrame([(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)], "flow_id string, target int")
    got = {r["target"]: r["count"] for r in T.sample_class_capped(df, 205, 3).groupBy("target").count().collect()}
    assert got == {0: 100, 1: 100, 2: 5}


def test_split_codes_partition_the_flows(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(500)], "flow_id string, target int")
    out = T.split_random_flows(df, 9)
    assert out.count() == 500 and out.select("flow_id").distinct().count() == 500


def test_late_flows(spark):
    rows = [(0.0, 10.0, 0), (900.0, 200.0, 1), (1500.0, 100.0, 0), (1900.0, 5100.0, 1)]
    df = W.assign_windows(spark.createDataFrame(rows, "start_ms double, duration_ms double, label int"), 1)
    got = W.late_flows(df, 1).first()
    assert got["late_flows"] == 2 and got["late_share"] == 0.5 and got["late_share_attack"] == 1.0
    assert abs(got["excess_max_s"] - 5.0) < 1e-9 and abs(got["excess_median_s"] - 2.55) < 1e-9
