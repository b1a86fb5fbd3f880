"""The steps that all queries on flows share: the join, the flow table, the scores of the runs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.sources import views as V

SF = "/root/testdata/sf0.001"


def test_lines_move_for_one_join_besides_suppliers(spark):
    """Orders meet their customers before the lines do: two joins lie above the lines, not three."""
    plan = V.flows_lineitem(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z]", x).start() for x in plan]
    at = next(i for i, x in enumerate(plan) if "Relation" in x and "l_orderkey" in x)
    above, limit = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < limit:
            above.append(plan[i])
            limit = depth[i]
    assert sum("Join Inner" in x for x in above) == 2


def test_rounded_equals_round(spark):
    values = [0.0, -0.0, 0.00005, 0.12345, 0.123449999, 0.1234500001, -0.12345, -0.00001, 2.5, 0.5, 1.5, -0.5, 1e12 + 0.5, 1e300, float("inf"), float("-inf"), float("nan"), None]
    values += [i / 20000 for i in range(500)] + [i * 0.37 / 7 for i in range(500)] + [i / 2 for i in range(20)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 4):
        same = S.rounded(F.col("x"), digits).eqNullSafe(F.round("x", digits))
        assert rows.where(~same).collect() == []


def test_scores_equal_the_formula_and_compile(spark):
    flows = spark.range(300).select(F.col("id").cast("string").alias("flow_id"), (F.col("id") % 8).cast("int").alias("target"))
    for n in (2, 7, 8):
        out = V.scored(flows, n)
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        digest = F.md5(F.concat_ws(":", "model", F.col("seed").cast("string"), "flow_id"))
        lean = F.create_map(*[F.lit(x) for m in V.MODELS.items() for x in m])[F.col("model")]
        raw = F.array(*[S.hash_int(digest, 1 + 4 * c, 4) / 65536.0 + F.when(F.col("target") == c, lean).otherwise(0.0) for c in range(n)])
        want = F.transform(F.array(raw), lambda r: F.transform(r, lambda x: F.round(x / F.aggregate(r, F.lit(0.0), lambda t, y: t + y), 4)))[0]
        both = out.withColumn("want", want)
        assert both.count() == 2700 and both.where((F.col("scores") != F.col("want")) | (F.col("y_pred") != S.first_argmax(F.col("want")))).count() == 0


def test_flows_are_counted_once_for_the_windows(spark, monkeypatch):
    """Positions read the windows several times: what they read is the written count, not the flows."""
    from flowlens.plans import base

    seen, real = [], base.W.window_ordinal
    monkeypatch.setattr(base.W, "window_ordinal", lambda df: seen.append(df) or real(df))
    flows = spark.range(100).select(F.floor(F.col("id") / 7).alias("window_id"))
    out = base.window_splits(flows)
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.window_id, r.pos, r.n_windows) for r in out.orderBy("pos").collect()] == [(i, i, 15) for i in range(15)]


def test_one_versus_rest_answers_as_sparks_and_side_by_side(spark):
    """The same trees and answers as ``OneVsRest``; nothing is cached, and the answers are columns, not a chain of arrays."""
    from pyspark.ml.classification import OneVsRest

    from flowlens.operators import models as M

    n = F.col("id")
    rows = spark.range(0, 600, 1, 3).select((n % 4).cast("int").alias("target"), *[((n * p) % 97 + (n % 4) * 20).cast("double").alias(c) for p, c in ((7, "a"), (31, "b"))])
    df = M.assemble(rows.where("target != 1").withColumns({"y": F.col("target").cast("double"), "class_weight": F.lit(0.5)}), ["a", "b"])
    mine = M.boosted_trees(1, 3, 4)
    theirs = OneVsRest(classifier=mine.classifier, featuresCol="features", labelCol="y", weightCol="class_weight").fit(df)
    model = mine.fit(df)
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert [trees(m) for m in model.models] == [trees(m) for m in theirs.models] and len(model.models) == 4
    out = model.transform(df)
    assert out.columns == [*df.columns, "prediction"]
    assert [r.prediction for r in out.collect()] == [r.prediction for r in theirs.transform(df).collect()]
    plan = out.select("prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_insert" not in plan and "InMemoryRelation" not in plan


def test_boosted_trees_keep_the_rows_of_one_classifier(spark, monkeypatch):
    """No copy of all rows is kept while the classifiers learn, and one learns after the other."""
    from pyspark.ml.classification import GBTClassifier

    from flowlens.operators import models as M

    df = M.assemble(spark.range(0, 60, 1, 2).select((F.col("id") % 3).cast("double").alias("y"), F.col("id").cast("double").alias("a"), F.lit(1.0).alias("class_weight")), ["a"])
    at_once, seen, fit = [], [], GBTClassifier._fit

    def watched(self, rows):
        at_once.append(1)
        seen.append((len(at_once), "InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString()))
        try:
            return fit(self, rows)
        finally:
            at_once.pop()

    monkeypatch.setattr(GBTClassifier, "_fit", watched)
    M.boosted_trees(1, 2, 2).fit(df)
    assert seen == [(1, False)] * 3


def test_flows_are_counted_once_for_the_history(spark):
    """The observations are written: the history reads them for its span and for its rows, and neither counts flows again."""
    from flowlens.plans import q_context

    n = F.col("id")
    host = lambda c: F.concat(F.lit("h"), (c % 5).cast("string"))
    flows = spark.range(500).select(
        F.floor(n / 50).alias("window_id"), host(n).alias("src_ip"), host(F.floor(n / 3)).alias("dst_ip"), (n % 7).cast("int").alias("dst_port"), n.cast("double").alias("in_bytes")
    )
    observed = q_context._observed(flows)
    assert observed.count() == 50
    plan = observed.agg(F.min("window_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def _learned(spark, rows, monkeypatch, **more):
    """The training rows that reach the classifier of ``run_baseline``, by class."""
    from flowlens.operators import models as M

    class Noted:
        def fit(self, train):
            self.counts = {int(r.y): r["count"] for r in train.groupBy("y").count().collect()}
            return self

    noted = Noted()
    monkeypatch.setattr(M, "predict", lambda model, df, n_classes, keep: df)
    df = spark.createDataFrame(rows, "flow_id string, target int, split int, a double")
    M.run_baseline(df, noted, "m", 1, ["a"], 3, **more)
    return noted.counts


def test_a_classifier_learns_from_all_training_flows(spark, monkeypatch):
    """Without a limit nothing is left out; with one, benign flows go as soon as the attacks reach it."""
    rows = [(str(i), i % 3, 0 if i < 90 else 2, float(i)) for i in range(120)]
    assert _learned(spark, rows, monkeypatch) == {0: 30, 1: 30, 2: 30} == _learned(spark, rows, monkeypatch, weighted=False)
    assert _learned(spark, rows, monkeypatch, limit=60) == {1: 30, 2: 30}


def _limits(spark, monkeypatch, name):
    """The limits with which a query calls ``run_baseline``."""
    from flowlens.operators import models as M
    from flowlens.plans import q_models, registry

    registry.load()
    seen = []

    def noted(df, estimator, name, seed, columns, n_classes, limit=None, **more):
        seen.append(limit)
        return df, None

    monkeypatch.setattr(M, "run_baseline", noted)
    monkeypatch.setattr(q_models, "_table", lambda pred: pred)
    registry.QUERIES[name](spark, SF)
    return seen


def test_boosted_trees_learn_from_all_flows(spark, monkeypatch):
    assert _limits(spark, monkeypatch, "boosted_trees") == [None]


def test_the_perceptron_learns_from_all_flows(spark, monkeypatch):
    assert _limits(spark, monkeypatch, "perceptron") == [None]


def _watched_shuffled_probe(spark, monkeypatch):
    """The calls of ``context_probe`` by the query, the columns that it writes, and what its rows must be: the context of another flow, permuted as columns."""
    from flowlens.operators import audit as A
    from flowlens.operators import context as X
    from flowlens.operators import graph as G
    from flowlens.operators import models as M
    from flowlens.plans import q_models, registry
    from flowlens.plans.base import labelled

    registry.load()
    flows, names = labelled(spark, SF), X.context_names()
    context = G.nodes(flows).select("window_id", "host", *[F.xxhash64("window_id", "host", F.lit(c)).cast("double").alias(c) for c in names])
    calls, written, real = [], {}, q_models.cut

    def noted(df, sets, n_classes, limit=None, **more):
        calls.append((df, sets, limit))
        return spark.createDataFrame([("m", 1, "macro_f1", 0.5)], "model string, seed int, metric string, value double"), None

    def writes(df, name="table"):
        written[name] = df.columns
        return real(df, name)

    monkeypatch.setattr(q_models, "_context", lambda spark, sf: context)
    monkeypatch.setattr(q_models, "cut", writes)
    monkeypatch.setattr(M, "context_probe", noted)
    registry.QUERIES["shuffled_context_probe"](spark, SF)
    both = [f"{s}__{c}" for s in ("src", "dst") for c in names]
    joined = G.endpoint_context(flows.select("flow_id", "window_id", "src_ip", "dst_ip", "target", "split", *V.FEATURES), context, names)
    want = A.permuted_rows(joined, "flow_id", both, 9).where("split != 1")
    return calls, written, want, both


def test_the_shuffled_probe_uses_all_columns_and_flows(spark, monkeypatch):
    """All context columns of both ends, all seven of behaviour, no sample."""
    calls, _, _, both = _watched_shuffled_probe(spark, monkeypatch)
    sets = {name: columns for _, s, _ in calls for name, columns in s.items()}
    assert {n: len(c) for n, c in sets.items()} == {"shuffled": 4 + 34, "without_behaviour": 4 + 20, "behaviour_only": 4 + 14}
    assert sets["shuffled"] == V.FEATURES + both and all(limit is None for _, _, limit in calls)


def test_the_shuffled_probe_moves_numbers_of_nodes(spark, monkeypatch):
    """What is written are numbers of nodes, and the rows are those of a permutation of the context columns."""
    calls, written, want, both = _watched_shuffled_probe(spark, monkeypatch)
    assert set(written["mixed"]) == {"target", "split", *V.FEATURES, "src__node", "dst__node"}
    columns = ["target", "split", *V.FEATURES, *both]
    got, want = calls[0][0].select(columns), want.select(columns)
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want).count() == 0
