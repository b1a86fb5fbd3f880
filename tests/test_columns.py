"""Parsing, labels, addresses, time units."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import addresses as A
from flowlens.functions import scalars as S
from flowlens.operators import columns as C


def test_roles_ignore_case_and_signs_and_prefer_order():
    found = C.resolve_columns(["ipv4-src-addr", "DST_IP", "L4_DST_PORT", "Flow_Start_Milliseconds", "LABEL", "label", "srcip"])
    assert found["src_ip"] == "ipv4-src-addr"
    assert found["dst_ip"] == "DST_IP"
    assert found["label"] == "LABEL"
    assert "attack" not in found
    with pytest.raises(ValueError):
        C.require_roles(["a", "b"])


def test_time_units_agree(spark):
    second = 1_424_242_193
    for text in (str(second), str(second * 1000), str(second * 10**6), str(second * 10**9), "2015-02-18T06:49:53Z"):
        df = spark.createDataFrame([(text,), (text,), (None,)] if text.endswith("Z") else [(text,)], "t string")
        got = [r["start_ms"] for r in C.epoch_ms(df, "t").collect() if r["start_ms"] is not None]
        assert set(got) == {second * 1000.0}, text


def test_unparsable_text_times_are_null(spark):
    df = spark.createDataFrame([("2015-02-18T06:49:53Z",), ("garbage",)], "t string")
    assert [r["start_ms"] is None for r in C.epoch_ms(df, "t").orderBy("t").collect()] == [False, True]


def test_labels_and_classes(spark):
    rows = ["1", "true", " Attack ", "benign", "-", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = [r["label"] for r in C.binary_label(df, "t").orderBy("i").collect()]
    assert got == [1, 1, 1, 0, 0, 0, 0]
    cls = df.select("i", S.attack_class(F.col("t"), F.lit(1)).alias("a"), S.attack_class(F.col("t"), F.lit(0)).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in cls] == ["1", "true", "Attack", "benign", "Benign", "Benign", "Benign"]
    assert {r["b"] for r in cls} == {"Benign"}


def test_safe_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("inf",), ("-inf",), ("nan",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.safe_numeric(F.col("t"))).collect()] == [1.5, 0, 0, 0, 0, 0]


def test_log_columns():
    assert [c for c in ["IN_BYTES", "proto_is_tcp", "TCP_WIN_MAX_IN", "TCP_FLAGS", "src_iat_min", "MIN_IP_PKT_LEN"] if C.heavy_tailed(c)] == [
        "IN_BYTES", "TCP_WIN_MAX_IN", "src_iat_min", "MIN_IP_PKT_LEN"]


def test_private_addresses_match_the_registry(spark):
    fixed = ["10.1.2.3", "172.15.0.1", "172.16.0.1", "100.64.0.1", "192.0.0.9", "192.0.0.8", "192.0.0.171", "203.0.113.5", "8.8.8.8", "fe80::1",
             "garbage", "::1", "::", "2001:db8::7", "2001:4860:4860::8888", "fd12::1", "1.2.3", "256.1.1.1", "01.2.3.4", "1.2.3.4.", "2001:20::5",
             "2001:1::1", "100::1", "64:ff9b:1::9", "64:ff9b::9", "2002::1", "FE80::ABCD", ":::", "1::2::3", "240.0.0.1", "255.255.255.255"]
    rng = random.Random(4)
    fixed += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    fixed += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    fixed += [str(ipaddress.IPv6Address((int(ipaddress.IPv6Address(p)) & ~((1 << 90) - 1)) | rng.getrandbits(64))) for p in ("fc00::", "2001::", "2001:db8::", "fe80::") for _ in range(10)]

    def expected(t):
        try:
            return float(ipaddress.ip_address(t).is_private)
        except ValueError:
            return 0.0

    df = spark.createDataFrame([(t,) for t in fixed], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", A.is_private(F.col("t")).alias("p")).collect()}
    assert got == {t: expected(t) for t in fixed}


def test_feature_rule_and_clean_table(spark):
    rows = [("1.1.1.1", "2.2.2.2", "1600000000", "1", "DoS", "5", "x", "9"), ("1.1.1.1", "2.2.2.2", "1600000001", "0", "DoS", "bad", "y", "1"),
            ("1.1.1.2", "2.2.2.2", None, "0", "-", "7", "3", "1")]
    raw = spark.createDataFrame(rows, "IPV4_SRC_ADDR string, IPV4_DST_ADDR string, FLOW_START_MILLISECONDS string, Label string, Attack string, IN_BYTES string, WORDS string, MIN_TTL string")
    assert C.select_feature_columns(raw) == ["IN_BYTES"]
    # One of three start times is missing, so the column counts as text and only timestamps would parse.
    clean = C.clean_flows(raw.where("FLOW_START_MILLISECONDS IS NOT NULL"))
    got = clean.orderBy("start_ms").collect()
    assert [r["start_ms"] for r in got] == [1.6e12, 1.600000001e12]
    assert [r["attack"] for r in got] == ["DoS", "Benign"]
    assert [r["feature__IN_BYTES"] for r in got] == [5.0, 0.0]
    assert "probe__MIN_TTL" in clean.columns and "feature__MIN_TTL" not in clean.columns


def test_drop_features_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        C.drop_features(spark.range(1), ["nope"])


def test_text_times_are_utc_in_every_session_zone(spark):
    rows = [("2024-07-01 12:00:00",), ("2024-07-01T12:00:00Z",), ("2024-07-01 14:00:00+02:00",), ("2024-07-01",), ("2024-03-31 02:30:00.5",), ("soon",)]
    df, zone = spark.createDataFrame(rows, "t string"), spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [r[0] for r in df.select(C.in_epoch_ms(F.col("t"), F.lit("text"))).collect()]
            assert got == [1719835200000.0, 1719835200000.0, 1719835200000.0, 1719792000000.0, 1711852200500.0, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_mapped_and_scoped_addresses(spark):
    import ipaddress

    texts = ["::ffff:10.0.0.1", "::ffff:808:808", "::ffff:8.8.8.8", "::ffff:c0a8:1", "fe80::1%eth0", "2001:db8::1%1", "8.8.8.8%x", "::1%", "::ffff:300.1.1.1",
             "3fff::1", "64:ff9b:1::10.0.0.1", "2a00:1450::10.0.0.1", "::10.0.0.1", "1:2:3:4:5:6:7.8.9.1"]

    def want(text):
        try:
            return float(ipaddress.ip_address(text).is_private)
        except ValueError:
            return 0.0

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.is_private(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == {t: want(t) for t in texts}
