"""Metrics, bootstrap, seed statistics and score correction against plain Python."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import audit as A
from flowlens.operators import compare as C
from flowlens.operators import correct as K
from flowlens.operators import metrics as E

PRED = "model string, seed int, flow_id string, window_id bigint, y_true int, y_pred int, scores array<double>"


def predictions(spark, seed=0, n=400, classes=3, windows=23, models=("a", "b"), seeds=(1, 2, 3)):
    rng = random.Random(seed)
    truth = [(f"f{i}", rng.randrange(windows) * 2, rng.choice([0] * 6 + list(range(classes)))) for i in range(n)]
    rows = []
    for m, s in itertools.product(models, seeds):
        for fid, w, y in truth:
            raw = [round(rng.random() + (0.4 if c == y else 0), 2) for c in range(classes)]
            rows.append((m, s, fid, w, y, raw.index(max(raw)), raw))
    return spark.createDataFrame(rows, PRED)


def test_macro_counts_only_true_classes(spark):
    rows = [("m", 1, str(i), 0, y, p, [0.0]) for i, (y, p) in enumerate([(0, 0), (0, 2), (1, 1), (1, 0)])]
    prf = E.per_class_prf(E.class_counts(spark.createDataFrame(rows, PRED)), 4)
    got = E.summary_metrics(prf).first()
    assert got["macro_f1"] == pytest.approx((0.5 + 2 / 3) / 2) and got["accuracy"] == 0.5
    assert prf.where("class = 2").first()["f1"] == 0.0 and prf.count() == 4


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(8)
    rows = [("m", 1, str(i), 0, int(rng.random() < 0.3), 0, [0.0]) for i in range(300)]
    df = spark.createDataFrame(rows, PRED).withColumn("score", F.round(F.col("y_true") * 0.2 + (F.crc32("flow_id") % 10) / 20.0, 2))
    data = [(r["y_true"], r["score"]) for r in df.collect()]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    ap, seen = 0.0, 0
    for t in sorted({s for _, s in data}, reverse=True):
        hits, called = sum(y for y, s in data if s >= t), sum(s >= t for _, s in data)
        ap, seen = ap + (hits - seen) / len(pos) * hits / called, hits
    assert E.average_precision(df).first()["pr_auc"] == pytest.approx(ap)
    single = df.where("y_true = 0")
    assert E.roc_auc(single).first()["roc_auc"] is None and E.average_precision(single).first()["pr_auc"] is None


def plain_macro(rows):
    classes = {y for y, _, _ in rows}
    f = []
    for c in classes:
        tp = sum(w for y, p, w in rows if y == c and p == c)
        den = sum(w for y, p, w in rows if y == c) + sum(w for y, p, w in rows if p == c)
        f.append(2 * tp / den if den else 0.0)
    return sum(f) / len(f)


def test_replicates_match_resampled_flows(spark):
    pred = predictions(spark)
    counts, n = C.positioned_counts(pred)
    assert n == 23
    samples = C.sampled_windows(C.block_samples(spark, n, 4)).collect()
    assert all(sum(r["multiplicity"] for r in samples if r["replicate"] == b) == n for b in range(4))
    places = {w: i for i, w in enumerate(sorted({r["window_id"] for r in pred.select("window_id").distinct().collect()}))}
    rows = pred.collect()
    got = {(r["replicate"], r["model"], r["seed"]): r["f"] for r in C.replicate_macros(counts, n, 4).where("metric = 'all'").collect()}
    for b in range(4):
        times = {r["pos"]: r["multiplicity"] for r in samples if r["replicate"] == b}
        for m, s in (("a", 1), ("b", 3)):
            weighted = [(r["y_true"], r["y_pred"], times[places[r["window_id"]]]) for r in rows if (r["model"], r["seed"]) == (m, s) and places[r["window_id"]] in times]
            assert got[(b, m, s)] == pytest.approx(plain_macro(weighted))


def test_a_model_against_itself_is_zero(spark):
    pred = predictions(spark, models=("a",))
    twin = pred.unionByName(pred.withColumn("model", F.lit("b")))
    got = C.paired_bootstrap(twin, {"same": [("a", 1), ("b", -1)]}, 30).collect()
    assert got and all(abs(r[c]) < 1e-12 for r in got for c in ("delta", "window_lo", "window_hi"))


def test_fewer_windows_than_a_block(spark):
    pred = predictions(spark, n=60, windows=4)
    out = C.contrast(pred, {"d": [("a", 1), ("b", -1)]}, 10).collect()
    # One block covers everything, so windows add no spread.
    assert all(r["window_lo"] == pytest.approx(r["delta"]) and r["window_hi"] == pytest.approx(r["delta"]) for r in out)


def test_same_rows_guard(spark):
    pred = predictions(spark, n=50)
    C.require_same_rows(pred)
    with pytest.raises(ValueError):
        C.require_same_rows(pred.where("NOT (model = 'a' AND seed = 2 AND flow_id = 'f7')"))
    # As many rows as runs for each flow, but no flow that both runs scored.
    rows = [("a", 1, "f1")] * 2 + [("b", 1, "f2")] * 2
    apart = C.same_rows(spark.createDataFrame(rows, "model string, seed int, flow_id string")).first()
    assert (apart["flows"], apart["runs"], apart["mismatched"]) == (2, 2, 2)


def test_shift_statistics_by_all_pairs(spark):
    rng = random.Random(11)
    a = [round(rng.random(), 2) for _ in range(20)]
    b = [round(rng.random() * 0.8, 2) for _ in range(17)]
    rows = [("c", "a", i, v) for i, v in enumerate(a)] + [("c", "b", i, v) for i, v in enumerate(b)]
    got = C.hodges_lehmann(spark.createDataFrame(rows, "comparison string, side string, seed int, value double")).first()
    d = sorted(x - y for x in a for y in b)
    k = int(np.floor(len(d) / 2 - 1.959963984540054 * np.sqrt(len(d) * (20 + 17 + 1) / 12)))
    assert got["shift"] == pytest.approx(np.median(d)) and got["lo"] == pytest.approx(d[k]) and got["hi"] == pytest.approx(d[len(d) - 1 - k])
    assert got["p_superior"] == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b) / len(d))


def test_holm(spark):
    df = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.04), ("f", "z", 0.03)], "family string, comparison string, p double")
    got = {r["comparison"]: r["p_holm"] for r in C.holm(df).collect()}
    assert got == pytest.approx({"x": 0.03, "z": 0.06, "y": 0.06})


def brute_offsets(rows, classes):
    bias = [0.0] * classes
    answer = lambda sc, b: max(range(classes), key=lambda c: (sc[c] + b[c], -c))
    macro = lambda b: plain_macro([(y, answer(sc, b), w) for y, sc, w in rows])
    best = macro(bias)
    for _ in range(2):
        for c in range(1, classes):
            keep = bias[c]
            for g in K.GRID:
                score = macro([g if i == c else v for i, v in enumerate(bias)])
                if score > best + 1e-9:
                    best, keep = score, g
            bias[c] = keep
    return bias


def test_offset_search_against_brute_force(spark):
    pred = predictions(spark, 4, n=150, classes=4, models=("a",), seeds=(1, 2)).withColumn("scores", F.transform("scores", lambda x: x * 3))
    weighted = pred.withColumn("w", 1 + F.crc32("flow_id") % 3)
    for weight in (None, "w"):
        got = {(r["model"], r["seed"]): r["offsets"] for r in K.fit_offsets(weighted, 4, weight=weight).collect()}
        for s in (1, 2):
            rows = [(r["y_true"], r["scores"], r["w"] if weight else 1) for r in weighted.where(F.col("seed") == s).collect()]
            assert got[("a", s)] == brute_offsets(rows, 4)


def test_bootstrap_offsets_equal_brute_force(spark):
    """Every replicate against a search by trying all offsets on rows weighted by the drawn windows."""
    val, test = predictions(spark, 5, n=120), predictions(spark, 6, n=120)
    got = {(r["replicate"], r["model"], r["seed"]): r["macro_f1"] for r in K.val_bootstrap_offsets(val, test, 3, n_boot=4).collect()}
    assert len(got) == 4 * 2 * 3
    windows = sorted(r[0] for r in val.select("window_id").distinct().collect())
    drawn = {}
    for r in C.sampled_windows(C.block_samples(spark, len(windows), 4)).collect():
        drawn[r["replicate"], windows[r["pos"]]] = r["multiplicity"]
    answer = lambda sc, b: max(range(3), key=lambda c: (sc[c] + b[c], -c))
    learned, scored = val.collect(), test.collect()
    for (rep, model, seed), value in got.items():
        rows = [(r["y_true"], r["scores"], drawn.get((rep, r["window_id"]), 0)) for r in learned if (r["model"], r["seed"]) == (model, seed)]
        bias = brute_offsets([r for r in rows if r[2]], 3)
        want = plain_macro([(r["y_true"], answer(r["scores"], bias), 1) for r in scored if (r["model"], r["seed"]) == (model, seed)])
        assert value == pytest.approx(want, abs=1e-9)


def test_identity_probe_breaks_ties_to_the_smaller_class(spark):
    rows = [("x", 2, 0), ("x", 1, 0), ("y", 0, 0), ("y", 3, 0), ("y", 3, 0), ("x", 1, 2), ("z", 3, 2)]
    df = spark.createDataFrame(rows, "src_ip string, target int, split int")
    got = {(r["seen"], r["y_true"], r["y_pred"]) for r in A.identity_outcomes(df, ["src_ip"]).collect()}
    assert got == {(1, 1, 1), (0, 3, 0)}


def test_keys_for_share_counts_inside_a_level(spark):
    rows = [(k,) for k, n in (("a", 50), ("b", 20), ("c", 20), ("d", 5), ("e", 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string")
    for share, want in ((0.5, 1), (0.6, 2), (0.9, 3), (0.91, 4), (1.0, 5)):
        assert A.keys_for_share(df, "k", share).first()["n_keys"] == want


def test_permutation_moves_whole_rows(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("flow_id"), "id", (F.col("id") * 2).alias("twice"))
    got = A.permuted_rows(df, "flow_id", ["id", "twice"], 3).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and all(r["twice"] == 2 * r["id"] for r in got)
    assert sum(int(r["flow_id"]) == r["id"] for r in got) < 20


def test_comparisons_refuse_runs_on_different_flows(spark):
    pred = predictions(spark, 7, n=60)
    lacking = pred.where(~((F.col("model") == "a") & (F.col("seed") == 1) & F.col("flow_id").isin(pred.select("flow_id").first()[0])))
    parts = {"a-b": [("a", 1.0), ("b", -1.0)]}
    for compare in (C.paired_bootstrap, C.contrast):
        with pytest.raises(ValueError, match="exactly once"):
            compare(lacking, parts, 5)


def test_grid_losses_and_best_class_as_by_trying_all():
    """Losses along the grid and the best other class equal trying every grid value and class, also where sums are equal or round."""
    rng = np.random.default_rng(5)
    score = np.log(np.concatenate([rng.integers(0, 3, (200, 4)) / 2, rng.random((200, 4))]) + 1e-6)
    score[:50] = rng.integers(-4, 5, (50, 4)) * 0.5
    offsets, kind = K._kinds(rng.choice(K.GRID, (6, 4))[[0, 1, 2, 3, 4, 5, 0, 1]])
    assert len(offsets) == 6 and kind[0] == kind[6] and kind[1] == kind[7]
    for c in (1, 3):
        shifted = score[:, None] + offsets[None]
        shifted[..., c] = -np.inf
        rival, top = K._best(score, offsets, c)
        assert (rival == shifted.argmax(2)).all() and (top == shifted.max(2)).all()
        own = score[:, c, None, None] + np.array(K.GRID)
        wins = (own > top[..., None]) | ((own == top[..., None]) & (c < rival)[..., None])
        assert (K._losses(score[:, c, None], top, c < rival) == (~wins).sum(2)).all()


def test_offsets_go_to_the_rows(spark, tmp_path):
    """Offsets that are made from the predictions are written first: the rows of a run are not moved to one task."""
    spark.range(2000).selectExpr("CAST(id % 3 AS STRING) AS model", "0 AS seed", "array(0.1D, 0.2D) AS scores", "id AS flow_id").write.parquet(str(tmp_path / "p"))
    pred = spark.read.parquet(str(tmp_path / "p"))
    # The size of an exploded and grouped table is not known to the planner.
    table = pred.select("model", "seed", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).groupBy("model", "seed").agg(F.sort_array(F.collect_set(F.col("i") * 0.0)).alias("o"))
    out = K.apply_offsets(pred, table.select("model", "seed", F.array(F.get("o", F.lit(0)) + 1, F.get("o", F.lit(0))).alias("offsets")))
    assert {r.y_pred for r in out.collect()} == {0} and out.count() == 2000
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_weights_go_to_the_rows(spark, tmp_path):
    """Class weights counted from the flows are written first: the rows of a class are not moved to one task."""
    spark.range(2000).selectExpr("'m' AS model", "0 AS seed", "array(0.25D, 0.75D) AS scores", "CAST(id % 2 AS INT) AS y_true", "CAST(id % 2 AS INT) AS target").write.parquet(str(tmp_path / "p"))
    pred = spark.read.parquet(str(tmp_path / "p"))
    out = E.log_loss(pred.drop("target"), E.class_weights(pred))
    assert out.first()["loss"] == pytest.approx(-(np.log(0.25) + np.log(0.75)) / 2)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_prior_correction_equals_plain_loop(spark):
    """Every strength, ties and all, against a loop over the rows; a row is not multiplied by the strengths."""
    val, test = K.log_scores(predictions(spark, 3)), K.log_scores(predictions(spark, 4))
    weights = spark.createDataFrame([(0, 0.4), (1, 2.0), (2, 3.0)], "target int, weight double")
    w = np.log([0.4, 2.0, 3.0])

    def macro(rows, strength):
        y, p = np.array([r.y_true for r in rows]), (np.array([r.scores for r in rows]) - strength * w).argmax(1)
        return np.mean([2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in range(3) if (y == c).any()])

    split = lambda df: {k: list(g) for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: (r.model, r.seed)), key=lambda r: (r.model, r.seed))}
    val_rows, test_rows = split(val), split(test)
    curve = K.lambda_curve(val, weights)
    assert "Generate explode(transform" not in curve._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.model, r.seed, r["lambda"]): r.value for r in curve.collect()}
    assert got == pytest.approx({(*run, x): macro(rows, x) for run, rows in val_rows.items() for x in K.LAMBDAS})
    for r in K.prior_correction(val, test, weights).collect():
        mine = test_rows[r.model, r.seed]
        assert (r.test_plain, r.test_full, r.test_tuned) == pytest.approx(tuple(macro(mine, x) for x in (0.0, 1.0, r["lambda"])))


def test_replicates_read_chunks_and_count_by_window(spark, monkeypatch):
    """Validation rows are packed, not grouped and not moved; chunks of any size, and either way to count, give the same."""
    val, test = predictions(spark, 5, n=120), predictions(spark, 6, n=120)
    written, real = {}, K.cut

    def noted(df, name="table"):
        written[name] = (df.columns, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(K, "cut", noted)
    answers = []
    for rows in (32768, 7):
        monkeypatch.setattr(K, "ROWS", rows)
        answers.append({tuple(r)[:3]: r.macro_f1 for r in K.val_bootstrap_offsets(val, test, 3, n_boot=3).collect()})
    assert answers[0] == pytest.approx(answers[1])
    columns, plan = written["weighted"]
    assert columns == ["model", "seed", "scores", "truth", "place", "weights"] and "Aggregate" not in plan


def test_weights_of_windows_meet_their_counts(spark):
    """The vectors of a cell, counted densely by window and, with many windows, by what occurs."""
    rng = np.random.default_rng(2)
    weights, window = rng.integers(0, 4, (6, 5)).astype(np.int32), rng.integers(0, 6, 300)
    truth = rng.integers(0, 3, 300)
    rows = [("m", 1, int(t), [0.0], int(w), bytearray(weights[w].tobytes())) for t, w in zip(truth, window)]
    df = spark.createDataFrame(rows, "model string, seed int, y_true int, scores array<double>, window_id bigint, w binary").coalesce(1)
    want = {t: weights[window[truth == t]].sum(0) for t in range(3)}
    for cells in (3, 1000):
        code = lambda run, score, truth: [(truth, np.array([0, 2])), (truth, np.array([1, 3, 4]))]
        got = {r.cell: r.n for r in K._vector_counts(K._pack(df, 5), 5, cells, code).collect()}
        assert got.keys() == want.keys() and all(list(got[t]) == list(want[t]) for t in want)
