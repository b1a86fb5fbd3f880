"""Trees from counts against a tree grown by trying every split on the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import models as M
from flowlens.operators import trees as R

SCHEMA = "flow_id string, split int, target int, a double, b double, c double, same double"


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = float(rng.randrange(12)), rng.choice([None, float("nan"), float("inf"), 0.25, 1.5, 7.0]), rng.random()
        y = (1 if a > 7 else 0) + (2 if b in (1.5, 7.0) else 0) if rng.random() < 0.8 else rng.randrange(4)
        out.append((f"f{i}", rng.choice([0, 0, 2]), y, a, b, round(c, 2), 3.0))
    return out


def clean(v):
    return 0.0 if v is None or v != v else max(-1e30, min(1e30, v))


def plain_bins(values, bins):
    """The bin of each distinct value, and the bound between bins."""
    total, seen, found = len(values), 0, {}
    for v in sorted(set(values)):
        found[v] = seen * bins // total
        seen += values.count(v)
    return found


def plain_tree(rows, features, weights, depth, bins):
    """Nested (feature, bound, below, above) or a class, by trying every bin edge of every feature on the rows."""
    binned = [plain_bins([x[f] for x, _ in rows], bins) for f in range(features)]

    def quality(some):
        by = {}
        for _, y in some:
            by[y] = by.get(y, 0.0) + weights[y]
        whole = sum(by.values())
        return sum(w * w for w in by.values()) / whole if whole else 0.0

    def grow(some, level):
        best = None
        for f in range(features):
            for b in sorted({binned[f][x[f]] for x, _ in some})[:-1]:
                sides = [r for r in some if binned[f][r[0][f]] <= b], [r for r in some if binned[f][r[0][f]] > b]
                gain = round(quality(sides[0]) + quality(sides[1]) - quality(some), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, b, sides
        if level == 0 or best is None:
            by = {}
            for _, y in some:
                by[y] = by.get(y, 0.0) + weights[y]
            return max(sorted(by), key=lambda k: (round(by[k], 12), -k))
        return best[1], best[2], grow(best[3][0], level - 1), grow(best[3][1], level - 1)

    return grow(rows, depth), binned


def answer(tree, x, binned, rows):
    """The class of a row whose values all occur in training."""
    while not isinstance(tree, int):
        f, b, below, above = tree
        tree = below if binned[f][x[f]] <= b else above
    return tree


@pytest.mark.parametrize("bins,depth", [(256, 6), (5, 2), (256, 1)])
def test_trees_equal_trying_every_split(spark, bins, depth, monkeypatch):
    rows = rows_of(1, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    train = df.where("split = 0")
    counts = R.value_counts(train, ["a", "b", "c", "same"])
    weights = R.class_weights(counts)
    leaves = R.single_feature_trees(R.histogram(counts, R.value_bins(counts, bins), 4), weights, depth)
    outcomes = {(r.model, r.y_true, r.y_pred): r.n for r in R.single_feature_outcomes(train, ["a", "b", "c", "same"], leaves).collect()}
    learned = [r for r in rows if r[1] == 0]
    want = {}
    for name, at in (("a", 3), ("b", 4), ("c", 5), ("same", 6)):
        some = [((clean(r[at]),), r[2]) for r in learned]
        tree, binned = plain_tree(some, 1, weights, depth, bins)
        for x, y in some:
            key = name, y, answer(tree, x, binned, some)
            want[key] = want.get(key, 0) + 1
    assert outcomes == want
    joint = R.joint_tree(train, ["a", "b", "c"], 4, depth, bins)
    some = [(tuple(clean(v) for v in r[3:6]), r[2]) for r in learned]
    tree, binned = plain_tree(some, 3, weights, depth, bins)
    got = {r.flow_id: r.y for r in train.select("flow_id", joint.predict().alias("y")).collect()}
    assert got == {r[0]: answer(tree, x, binned, some) for r, (x, _) in zip(learned, some)}


def test_many_classes_equal_trying_every_split(spark):
    rows = [(*r[:3], *r[3:]) for r in rows_of(3, 300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.concat(F.lit("h"), "target")).repartition(3)
    tree = R.many_class_tree(df, ["a", "b", "c"], "host", 5)
    some = [(tuple(clean(v) for v in r[3:6]), r[2]) for r in rows]
    plain, binned = plain_tree(some, 3, {k: 1 / len(rows) for k in range(4)}, 5, R.BINS)
    got = {r.flow_id: r.y for r in df.select("flow_id", tree.predict().alias("y")).collect()}
    assert got == {r[0]: f"h{answer(plain, x, binned, some)}" for r, (x, _) in zip(rows, some)}


def test_unseen_hosts_are_classes_of_their_own(spark):
    """Two hosts that only the test flows have: each has a recall of zero."""
    rows = [(f"f{i}", 0, 0, float(i % 2), 0.0, 0.0, 0.0, f"h{i % 2}") for i in range(20)] + [("g", 0, 0, 1.0, 0.0, 0.0, 0.0, "h1")]
    rows += [("t0", 2, 0, 0.0, 0.0, 0.0, 0.0, "h0"), ("t1", 2, 0, 1.0, 0.0, 0.0, 0.0, "h1"), ("t2", 2, 0, 1.0, 0.0, 0.0, 0.0, "new"), ("t3", 2, 0, 0.0, 0.0, 0.0, 0.0, "newer")]
    df = spark.createDataFrame(rows, SCHEMA + ", src_ip string")
    got = {r.model: (r.accuracy, r.balanced_accuracy) for r in M.host_fingerprint_probe(df, ["a"]).collect()}
    assert got == {"fingerprint": (0.5, 0.5), "majority": (0.25, 0.25)}


def test_probes(spark):
    df = spark.createDataFrame(rows_of(2, 900), SCHEMA).repartition(3)
    single = {(r.model, r.metric): r.value for r in M.single_feature_probe(df, ["a", "b", "same"], 4, 10_000).collect()}
    joint = {r.metric: r.value for r in M.joint_feature_probe(df, ["a", "b"], 4, 10_000).collect()}
    assert joint["macro_f1"] > 0.7 > max(single["a", "macro_f1"], single["b", "macro_f1"]) > single["same", "macro_f1"]
    assert R.joint_tree(df.where(F.lit(False)), ["a"], 4) is None


@pytest.mark.parametrize("name", ["joint_feature_probe", "single_feature_probe"])
def test_registered_probes_learn_from_all_training_rows(spark, monkeypatch, name):
    """However small the sample of other queries is: the checking SQL knows no sample."""
    import duckdb

    from flowlens.plans import q_models, registry

    registry.load()
    monkeypatch.setattr(q_models, "LIMIT", 100)
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT model, seed, metric, value FROM ({registry.ORACLES[name]})").fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, folder).select("model", "seed", "metric", "value").collect())
    assert got == want


def test_many_class_trees_look_bins_and_nodes_up(spark):
    """No expression grows with the bins or the splits of a tree: bins are found by halving, nodes and answers by look-up."""
    df = spark.range(4000).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 7919 % 4001).cast("double").alias("b"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"),
        F.concat(F.lit("h"), F.floor(F.col("id") / 97).cast("string")).alias("host"),
    )
    held = R._Binned(df, ["a", "b", "zero"], "host", R.BINS)
    plan = held._binned(df, "host")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert {r.b2 for r in held.rows.select("b2").distinct().collect()} == {0}
    tree = R.many_class_tree(df, ["a", "b", "zero"], "host", 7)
    assert len(tree.splits) > 40
    assert tree.predict()._jc.toString().count("CASE WHEN") < 20

    def plain(row, node=1):
        if node not in tree.splits:
            return tree.labels[node]
        name, bound = tree.splits[node]
        return plain(row, 2 * node + (row[name] > bound))

    rows = df.withColumn("got", tree.predict()).collect()
    assert [r.got for r in rows] == [plain(r) for r in rows]
