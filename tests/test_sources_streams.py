"""Readers, writers, and the stream against the batch history."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import graph as G
from flowlens.operators import history as H
from flowlens.sources import flows as IO
from flowlens.streaming import history as ST


def test_csv_trims_headers_and_keeps_text(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(" a , b\n1,x\nbad,\n")
    df = IO.read_flows(spark, str(path))
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "string" and df.count() == 2
    assert IO.read_flows(spark, str(path), ["b"], nrows=1).columns == ["b"]


def test_flow_table_is_partitioned_by_day(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0), ("b", 86_400_000.0), ("c", 86_400_001.0)], "flow_id string, start_ms double")
    IO.write_flows(df, str(tmp_path / "flows"))
    assert {p.name for p in (tmp_path / "flows").glob("flow_day=*")} == {"flow_day=1970-01-01", "flow_day=1970-01-02"}
    back = IO.load_flows(spark, str(tmp_path / "flows"))
    assert sorted(r["flow_id"] for r in back.collect()) == ["a", "b", "c"] and "flow_day" not in back.columns


def test_predictions_prune_by_model_and_seed(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, "f"), ("m", 2, "f"), ("n", 1, "f")], "model string, seed int, flow_id string")
    IO.write_predictions(df, str(tmp_path / "p"))
    assert IO.load_predictions(spark, str(tmp_path / "p"), "m", [2]).count() == 1


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    seconds, start = 600, 1_600_000_123.5
    rows, t = [], start
    for i in range(600):
        t += rng.random() * 60
        rows.append((str(i), f"h{rng.randrange(6)}", f"h{rng.randrange(6)}", rng.randrange(5), round(t * 1000, 3), float(rng.randrange(1, 90)), 1.0))
    schema = "flow_id string, src_ip string, dst_ip string, dst_port int, start_ms double, in_bytes double, out_bytes double"
    df = spark.createDataFrame(rows, schema)
    for i in range(4):
        part = spark.createDataFrame(rows[150 * i:150 * (i + 1)], schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    origin = rows[0][4]
    got = ST.run_available(ST.host_history_stream(stream, seconds, origin, "1 minute"), str(tmp_path / "out"))
    from flowlens.operators import windows as W
    from flowlens.operators import context as X

    batch = W.assign_windows(df, seconds)
    ends = G.endpoints(G.pair_table(batch))
    obs = H.observations(G.host_counts(ends), X.port_stats(G.port_counts(batch)))
    full = H.host_age(H.ewma_zscore(H.ewma_history(obs))).join(H.peer_novelty(ends), G.NODE)
    names = ["z_flows", "z_bytes", "z_ports", "z_peers", "peer_novelty", "log_age_windows"]
    key = lambda d: {(r["host"], r["window_id"]): [r[c] for c in names] for r in d.collect()}
    closed = (rows[-1][4] - 60_000 - origin) // (seconds * 1000)
    expected = {k: v for k, v in key(full).items() if k[1] < closed}
    found = key(got)
    assert len(found) > 50 and set(found) == set(expected)
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, abs=1e-9)


def test_event_time_does_not_hang_on_the_session_zone(spark):
    from flowlens.functions import scalars as S

    df = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12, 0, 0),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = df.select(S.epoch_ms_of_ntz("ts").alias("ms")).withColumn("day", S.to_day(F.col("ms"))).first()
            assert row["ms"] == 1_719_835_200_000.0 and row["day"] == "2024-07-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_day_is_one_folder(spark, tmp_path):
    """A time range reads the folders of its days only, and a busy hour is dealt over several files."""
    day = 86_400_000
    rows = [(f"f{i}", float(i % 4 * day + (i % 7) * 1000)) for i in range(400)] + [("none", None)]
    df = spark.createDataFrame(rows, "flow_id string, start_ms double")
    path = str(tmp_path / "flows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be put together again
    try:
        IO.write_flows(df, path, file_rows=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = IO.load_flows(spark, path, between=(day + 2000, 2 * day))
    want = {f for f, ms in rows if ms is not None and day + 2000 <= ms < 2 * day}
    assert {r.flow_id for r in back.collect()} == want and back.columns == ["flow_id", "start_ms"]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flow_day" in plan and "1970-01-02" in plan
    folders = {r.f.rsplit("/", 2)[1] for r in back.select(F.input_file_name().alias("f")).collect()}
    assert folders == {"flow_day=1970-01-02"}
    files = list((tmp_path / "flows" / "flow_day=1970-01-02").glob("*.parquet"))
    assert len(files) > 1
    assert IO.load_flows(spark, path).count() == len(rows)
    hours = spark.read.parquet(IO.hours_path(path))
    assert hours.agg(F.sum("flows")).first()[0] == len(rows) and hours.count() == 5
