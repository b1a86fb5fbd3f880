"""The five-host window, host histories, causality, and both ways of working a window."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import context as X
from flowlens.operators import graph as G
from flowlens.operators import history as H
from flowlens.operators import neighbors as N
from flowlens.tables import cut

SCHEMA = "window_id bigint, flow_id string, src_ip string, dst_ip string, dst_port int, in_bytes double, out_bytes double, start_ms double"


def flows(spark, edges, window=0):
    rows = [(window, f"{window}-{i}", s, d, p, 10.0, 1.0, 1000.0 * window) for i, (s, d, p) in enumerate(edges)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def star(spark):
    edges = [("A", "B", 80), ("A", "B", 81), ("A", "B", 80), ("B", "C", 22), ("C", "A", 9999), ("A", "A", 5), ("D", "A", 53), ("D", "E", 53)]
    return flows(spark, edges)


def table(df, *columns):
    return {r["host"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_counts_with_self_loop_and_parallel_flows(star):
    hosts = G.host_counts(G.endpoints(G.pair_table(star)))
    assert table(hosts, "flows_in", "flows_out", "peers", "bytes") == {
        "A": (3, 4, 4, 77.0), "B": (3, 1, 2, 44.0), "C": (1, 1, 2, 22.0), "D": (0, 2, 2, 22.0), "E": (1, 0, 1, 11.0)}


def test_clustering_and_pagerank(star):
    pairs = cut(G.pair_table(star))
    ends = cut(G.endpoints(pairs))
    assert table(G.clustering(ends), "k", "triangles", "clustering") == {
        "A": (3, 1, 1 / 3), "B": (2, 1, 1.0), "C": (2, 1, 1.0), "D": (2, 0, 0.0), "E": (1, 0, 0.0)}
    names = "ABCDE"
    weight = np.zeros((5, 5))
    for r in pairs.collect():
        weight[names.index(r["src"]), names.index(r["dst"])] = r["w"]
    sent = weight.sum(1)
    rank = np.full(5, 0.2)
    for _ in range(30):
        moved = sum(rank[i] * weight[i] / sent[i] for i in range(5) if sent[i])
        rank = 0.15 / 5 + 0.85 * (moved + rank[sent == 0].sum() / 5)
        rank /= rank.sum()
    got = table(G.pagerank(pairs), "pagerank")
    assert all(abs(got[n][0] - rank[i] * 5) < 1e-9 for i, n in enumerate(names))
    assert abs(sum(v[0] for v in got.values()) / 5 - 1) < 1e-12


def random_windows(spark, seed=1, hosts=40, windows=4, n=900):
    rng = random.Random(seed)
    rows = [(rng.randrange(windows), f"f{i}", f"h{int(hosts * rng.random() ** 2)}", f"h{rng.randrange(hosts)}", rng.randrange(100), rng.random() * 50, 1.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_large_windows_give_the_same_structure(spark):
    df = random_windows(spark)
    pairs = cut(G.pair_table(df))
    ends = cut(G.endpoints(pairs))
    key = lambda d: {(r["window_id"], r["host"]): (round(r["pagerank"], 9), r["k"], r["triangles"]) for r in d.collect()}
    assert key(G.structure(pairs, ends)) == key(G.structure(pairs, ends, grouped=True))
    with pytest.raises(ValueError):
        G.structure_grouped(pairs, group=10)
    assert G.structure_grouped(pairs, group=400).count() == len(key(G.structure(pairs, ends)))


def plain_ranks(edges, iters, damping=0.85):
    """Power iteration of one window, {host: rank times hosts}, and the ranks' change in the last step."""
    names = sorted({h for e in edges for h in e[:2]})
    n, weight = len(names), np.zeros((len(names), len(names)))
    for s, d, w in edges:
        weight[names.index(s), names.index(d)] += w
    sent = weight.sum(1)
    rank = np.full(n, 1 / n)
    for _ in range(iters):
        rank = (1 - damping) / n + damping * ((rank / np.where(sent, sent, 1)) @ weight + rank[sent == 0].sum() / n)
        rank /= rank.sum()
    return dict(zip(names, rank * n))


@pytest.mark.parametrize("iters,steps", [(1, 6), (2, 1), (30, 6), (31, 7), (30, 30)])
def test_ranks_by_joins(spark, iters, steps):
    """Windows that run dry, settle at once, settle late, swing without end, and have hosts that send nothing."""
    rng = random.Random(4)
    windows = {
        0: [("a", "b", 2), ("b", "c", 1)], 1: [("a", "b", 1), ("b", "a", 3)], 2: [(f"h{i}", f"h{(i + 1) % 7}", 1) for i in range(7)], 3: [("x", "x", 5)], 4: [("x", "y", 1)],
        5: [(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}", rng.randint(1, 9)) for _ in range(60)], 6: [(f"h{i}", f"h{j}", 1 + (i * j) % 3) for i in range(30) for j in range(30)],
        7: [("a", "b", 1), ("b", "a", 1), ("c", "a", 1), ("c", "d", 2), ("e", "e", 1)],
    }
    merged = {w: {} for w in windows}
    for w, edges in windows.items():
        for s, d, x in edges:
            merged[w][s, d] = merged[w].get((s, d), 0) + x
    rows = [(w, s, d, x) for w, edges in merged.items() for (s, d), x in edges.items()]
    pairs = cut(spark.createDataFrame(rows, "window_id bigint, src string, dst string, w bigint"))
    got = {(r.window_id, r.host): r.pagerank for r in G.pagerank_iterative(pairs, iters, steps=steps).collect()}
    want = {(w, h): v for w in windows for h, v in plain_ranks([(s, d, x) for (s, d), x in merged[w].items()], iters).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-10) for k in got)


def test_ranks_of_no_window(spark):
    pairs = cut(spark.createDataFrame([], "window_id bigint, src string, dst string, w bigint"))
    assert G.pagerank(pairs).count() == 0 == G.pagerank(pairs, grouped=True).count()


def test_triangles_match_the_matrix():
    rng = np.random.default_rng(0)
    for n, m in ((60, 500), (5, 3), (40, 0), (30, 4000)):
        src, dst = rng.integers(0, n, m), rng.integers(0, n, m)
        linked = np.zeros((n, n))
        linked[src, dst] = linked[dst, src] = 1
        np.fill_diagonal(linked, 0)
        for step in (1, 50, 1 << 20):
            k, found = G._simple_triangles(src, dst, n, step)
            assert np.allclose(k, linked.sum(1)) and np.allclose(found, ((linked @ linked) * linked).sum(1) / 2)


def test_history_without_and_with_full_decay(spark):
    from flowlens.operators.history import ewma_history

    values = [1.0, 4.0, 2.0, 8.0]
    obs = spark.createDataFrame([(i, "h", v) for i, v in enumerate(values)], "window_id bigint, host string, x double")
    for alpha in (0.0, 1.0, 0.5):
        mean, var, want = values[0], 1.0, [(values[0], 1.0, None, None)]
        for v in values[1:]:
            gap = v - mean
            want.append((mean + alpha * gap, (1 - alpha) * (var + alpha * gap * gap), mean, var))
            mean, var = want[-1][:2]
        rows = ewma_history(obs, ["x"], alpha).orderBy("window_id").collect()
        for r, w in zip(rows, want):
            assert [r["mean_x"], r["var_x"], r["prior_mean_x"], r["prior_var_x"]] == [v if v is None else pytest.approx(v) for v in w]


def test_role_columns(star):
    got = table(X.role_context(star), "inbound_ratio", "server_port_share", "dst_port_entropy")
    # A sends to ports 80, 81, 80, 5.
    assert got["A"] == pytest.approx((3 / 7, 0.5, 1.5))
    assert got["D"] == pytest.approx((0.0, 1.0, 0.0)) and got["E"] == (1.0, 0.0, 0.0)


def plain_ewma(values, alpha=0.3):
    mean = var = None
    out = []
    for x in values:
        if mean is None:
            mean, var, z = x, 1.0, 0.0
        else:
            z = max(-10.0, min(10.0, (x - mean) / math.sqrt(max(var, 1e-6))))
            gap = x - mean
            mean, var = mean + alpha * gap, (1 - alpha) * (var + alpha * gap * gap)
        out.append((mean, var, z))
    return out


@pytest.mark.parametrize("alpha", [0.3, 0.05, 0.9])
def test_ewma_over_many_chunks(spark, alpha):
    rng = random.Random(3)
    series = {h: [rng.random() * 8 if rng.random() < 0.7 else 3.0 for _ in range(n)] for h, n in (("a", 2500), ("b", 1), ("c", 131))}
    series["c"][40:120] = [2.0] * 80
    rows = [(h, 3 * i, x) for h, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "host string, window_id bigint, log_x double")
    got = H.ewma_zscore(H.ewma_history(df, ["log_x"], alpha), ["log_x"]).orderBy("host", "window_id").collect()
    expected = [v for h in sorted(series) for v in plain_ewma(series[h], alpha)]
    for r, (mean, var, z) in zip(got, expected):
        assert r["mean_log_x"] == pytest.approx(mean, abs=1e-9) and r["var_log_x"] == pytest.approx(var, abs=1e-9) and r["z_x"] == pytest.approx(z, abs=1e-7)


def test_age_and_novelty(spark):
    parts = [flows(spark, [("a", p, 1) for p in peers], w) for w, peers in ((0, ["x", "y"]), (1, ["x", "y"]), (3, ["x", "z"]), (9, ["z", "q", "r", "x"]))]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    ends = G.endpoints(G.pair_table(df))
    novel = {r["window_id"]: r["peer_novelty"] for r in H.peer_novelty(ends).where("host = 'a'").collect()}
    assert novel == {0: 1.0, 1: 0.0, 3: 0.5, 9: 0.5}
    nodes = G.nodes(df).where("host = 'a'")
    age = lambda *a: [round(math.expm1(r["log_age_windows"])) for r in H.host_age(nodes, *a).orderBy("window_id").collect()]
    assert age() == [0, 1, 3, 9] and age("active") == [0, 1, 2, 3] and age("active", 2) == [0, 1, 2, 2]


def test_context_of_the_past_ignores_the_future(spark):
    df = random_windows(spark, 5, windows=6, n=700)
    names = X.context_names()
    key = lambda d: {(r["window_id"], r["host"]): [round(r[c], 9) for c in names] for r in d.collect()}
    whole, early = key(X.host_context(df)), key(X.host_context(df.where("window_id <= 3")))
    assert early == {k: v for k, v in whole.items() if k[0] <= 3}


def test_context_groups_choose_columns(spark):
    df = random_windows(spark, 6, n=200)
    assert X.host_context(df, structural=False, behavioural=False, time=True).columns == ["window_id", "host", *X.ROLE, *X.TIME]
    assert X.host_context(df, structural=False, behavioural=False, role=False).columns == ["window_id", "host", "constant"]


def test_neighbour_aggregates_by_hand(star):
    nodes = G.nodes(star).withColumn("v", F.ascii("host") - 64.0)
    mean = table(N.neighbor_mean(nodes, star, ["v"], ["dst_port"]), "agg__v", "agg__dst_port")
    # E hears D once; D hears A and E.
    assert mean["E"] == (4.0, 53.0) and mean["D"] == (3.0, 53.0)
    # A: B three times, C, itself twice (both ends of the self-loop), D.
    assert mean["A"][0] == pytest.approx((2 * 3 + 3 + 1 * 2 + 4) / 7)
    best = table(N.neighbor_max(nodes, star, ["v"]), "agg__v")
    assert best["A"] == (4.0,) and best["B"] == (3.0,)
    apart = table(N.neighbor_agg(nodes, star, ["v"], direction_aware=True), "in__v", "out__v")
    assert apart["E"] == (4.0, 0.0)


def test_softmax_sums_to_one(star):
    msgs = N.both_directions(star, ["dst_port"]).withColumn("score", F.col("dst_port") / 10.0)
    sums = N.segment_softmax(msgs, "score").groupBy("receiver").agg(F.sum("alpha").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_softmax_of_a_hot_receiver(spark):
    """One receiver with nine tenths of all messages, far-apart scores: merged states equal a plain softmax, and no task holds a tenth."""
    rng = random.Random(7)
    rows = [(0, "hot" if i % 10 else f"h{i % 70}", rng.choice([-900.0, 0.0, 3.0, 900.0]) + rng.random(), rng.random(), i) for i in range(20_000)]
    msgs = spark.createDataFrame(rows, "window_id bigint, receiver string, score double, v double, id int")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = N.segment_softmax(msgs, "score", shares=100).withColumn("part", F.spark_partition_id()).toPandas()
        means = {r.receiver: r.v for r in N.softmax_mean(msgs, "score", ["v"], shares=100).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got.groupby("part").size().max() < 2000 and len(got) == len(rows)
    by = {}
    for _, host, s, v, i in rows:
        by.setdefault(host, []).append((s, v, i))
    alpha = dict(zip(got.id, got.alpha))
    for host, own in by.items():
        e = np.exp(np.array([s for s, _, _ in own]) - max(s for s, _, _ in own))
        want = e / e.sum()
        assert np.allclose([alpha[i] for _, _, i in own], want, rtol=1e-12, atol=1e-300)
        assert means[host] == pytest.approx(float(want @ np.array([v for _, v, _ in own])), rel=1e-12)


def test_node_init_wants_its_columns(star):
    hosts = X.host_context(star)
    assert N.node_init(hosts, "context")[1] == X.STRUCTURAL + X.BEHAVIOURAL + X.ROLE
    with pytest.raises(ValueError):
        N.node_init(hosts.drop("pagerank"), "structural")


def test_iterations_are_worked_out_once_and_hubs_are_several_rows(spark, monkeypatch):
    """The sums that are kept and those that go on share their exchanges; a host with many steps is not one row."""
    pairs = cut(G.pair_table(random_windows(spark, seed=5)))
    want = {(r.window_id, r.host): r.pagerank for r in G.structure_grouped(pairs, 4, with_triangles=False).collect()}
    seen, widths = [], []

    def noted(df, name="table"):
        if name == "ranks":
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            seen.append(sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in plan))
        out = cut(df, name)
        if name == "steps":
            widths.append(out.agg(F.max(F.size("near"))).first()[0])
        return out

    monkeypatch.setattr(G, "cut", noted)
    monkeypatch.setattr(G, "PIECE", 4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {(r.window_id, r.host): r.pagerank for r in G.pagerank_iterative(pairs, 4, steps=4).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert seen == [6] and widths[0] < 16


def test_numbered_hosts_give_the_same_structure(spark, monkeypatch):
    """With numbers in place of names in all steps: the same ranks, neighbours and triangles, self-loops, silent and nameless hosts included."""
    pairs = cut(G.pair_table(random_windows(spark, seed=7)))
    loops = spark.createDataFrame([(90, "x", "x", 2), (90, "x", "y", 1), (90, "y", "z", 1), (90, "x", "z", 3)], "window_id bigint, src string, dst string, w bigint")
    named = cut(pairs.select("window_id", "src", "dst", "w").unionByName(loops).withColumn("bytes", F.lit(1.0)))
    nameless = cut(named.unionByName(spark.createDataFrame([(90, "x", None, 1, 1.0)], named.schema)))
    seen = {}

    def noted(df, name="table"):
        seen.setdefault(name, dict(df.dtypes))
        return cut(df, name)

    rows = lambda df: {(r.window_id, r.host): (r.k, r.triangles, round(r.pagerank, 9)) for r in df.collect()}
    for table in (named, nameless):
        want = rows(G.structure(table, iters=5))
        with monkeypatch.context() as m:
            m.setattr(G, "cut", noted)
            assert rows(G.structure(table, iters=5, numbered=True)) == want
        if table is named:
            assert want[90, "x"][:2] == (2, 1)
            assert seen["steps"]["host"] == seen["links"]["peer"] == seen["ranks"]["host"] == "bigint" and set(seen["links"]) == {"window_id", "host", "peer"}
