"""Whitening and clustering against plain numpy and exact loops."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from flowlens.llm import ptolemaic as P
from flowlens.llm import whitening as W
from flowlens.llm.q_kmeans import SQL, op12_ptolemaic
from flowlens.llm.q_whitening import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id int, whitened string, cached int"
MORE = (1, 2, 3, "w", 4)
ODD = [None, [], [None] * 6, [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1.0] * 5]


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    return [v.tolist() for v in (rng.normal(size=(n, dim)) * np.linspace(1, 3, dim)).astype(np.float32)]


def expected(x, weights, k):
    """Exact mean and deviations, covariance in double precision around it."""
    count = Counter(map(tuple, x))
    w = {v: (c if weights == "count" else 1) for v, c in count.items()}
    n, dim = sum(w.values()), len(x[0])
    sums = [sum(v[i] * c for v, c in w.items()) for i in range(dim)]
    centred = {v: np.array([float(Fraction(v[i]) - Fraction(sums[i], n)) for i in range(dim)]) for v in w}
    cov = sum(np.outer(c, c) * w[v] for v, c in centred.items()) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = {v: sum((n * v[i] - sums[i]) ** 2 for i in range(dim)) for v in w}
    return n, deviation, {v: c @ axes / np.sqrt(values) for v, c in centred.items()}, values / np.trace(cov)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_numpy(spark, weights):
    base = vectors(1, 90, 6)
    rows = base + [base[0]] * 60 + [base[1]] * 5  # a vector with two fifths of all rows
    ids = [*range(len(rows) - 2), None, 3]
    table = spark.createDataFrame([(i, v, *MORE) for i, v in zip(ids, rows)] + [(900 + i, v, *MORE) for i, v in enumerate(ODD)], SCHEMA).repartition(5)
    got = W.whiten(table, components=3, scale=256, weights=weights, shares=8).collect()
    x = [tuple(math.floor(256 * c) for c in v) for v in rows]
    n, deviation, white, explained = expected(x, weights, 3)
    assert len(got) == 3 * len(rows) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3}
    assert Counter(r.id for r in got) == Counter(i for i in ids for _ in range(3))
    by = {r.id: r for r in got if r.component == 1}
    signs = [np.sign(r.whitened) * np.sign(white[x[5]][r.component - 1]) for r in sorted((r for r in got if r.id == 5), key=lambda r: r.component)]
    for i in set(ids) - {3, None}:
        assert int(by[i].deviation) == deviation[x[ids.index(i)]]
    for r in got:
        assert r.explained == pytest.approx(explained[r.component - 1]) and r.identity_error < 1e-9
        if r.id not in (3, None):
            assert r.whitened == pytest.approx(signs[r.component - 1] * white[x[ids.index(r.id)]][r.component - 1], abs=1e-8)


def test_whitening_odd(spark):
    table = lambda rows: spark.createDataFrame([(i, v, *MORE) for i, v in enumerate(rows)], SCHEMA)
    assert W.whiten(table([])).count() == W.whiten(table(ODD[:-1])).count() == 0
    same = W.whiten(table([[1.0, 2.0]] * 4)).collect()
    assert len(same) == 8 and {(r.whitened, r.explained, int(r.deviation), r.identity_error, r.n) for r in same} == {(None, None, 0, 0.0, 1)}
    flat = W.whiten(table([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {None} and max(r.identity_error for r in flat) < 1e-12
    far = W.whiten(table([[1e15, 1.0], [1e15 + 2**27, 3.0], [1e15, 5.0], [1e15, 5.0]])).collect()  # far from zero: the mean is subtracted before anything is rounded
    assert max(r.identity_error for r in far) < 1e-9 and all(r.deviation > 2**63 for r in far)
    assert W.whiten(table([[1e30, 0.0], [0.0, -1e30], [1.0, 1.0]])).count() == 6
    with pytest.raises(ValueError):
        W.whiten(table([]), weights="half")


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op11_whitening(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    n, deviation, white, explained = expected(list(x.values()), "one", 4)
    found = got.toPandas().pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([white[x[i]] for i in found.index])
    assert np.abs(np.abs(found.values) - np.abs(want)).max() < 1e-8 and len(found) == len(rows)
    signs = np.sign(found.values * want)
    assert (np.abs(signs.sum(0)) == len(rows)).all()
    assert {r.vec_id: r.deviation for r in got.where("component = 1").collect()} == {i: deviation[v] for i, v in x.items()}


def plain_clusters(rows, k, rounds, dim, scale):
    """(id, vector) rows to (id, cluster, distance) and centroids, by exact loops."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted([(str(i), *nearest(v)[::-1]) for i, v in kept]), centroids


@pytest.mark.parametrize("pivots", [1, 5])
def test_clusters_equal_loops(spark, pivots, monkeypatch):
    monkeypatch.setattr(P, "_PIECE", 7)
    rng = random.Random(3)
    base = vectors(2, 120, 6)
    rows = [(i, v) for i, v in enumerate(base)] + [(500 + i, base[7]) for i in range(80)] + [(3, base[9]), (None, base[1]), (None, base[1])]
    rows += [(700 + i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(6)]) for i in range(60)]  # many ties
    rows += [(900 + i, v) for i, v in enumerate(ODD)]
    table = spark.createDataFrame([(i, v, *MORE) for i, v in rows], SCHEMA).repartition(4)
    got = P.cluster(table, k=9, rounds=3, dim=6, scale=64, pivots=pivots).collect()
    want, centroids = plain_clusters(rows, 9, 3, 6, 64)
    assert sorted((str(r.id), r.cluster, r.distance) for r in got) == want
    per = Counter()
    for _, j, d in want:
        per[j] += d
    for r in got:
        assert r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_odd(spark):
    table = lambda rows: spark.createDataFrame([(i, v, *MORE) for i, v in enumerate(rows)], SCHEMA)
    assert P.cluster(table([]), dim=6).count() == P.cluster(table(ODD), dim=6).count() == 0
    one = P.cluster(table([[1.0, 2.0]] * 5), dim=2, k=3).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in one} == {(0, 0, 0)}
    big = [[4e7, 0.0], [-4e7, 1.0], [0.0, 0.0], [1.0, 3.0], [1e30, 0.0]]  # squares beyond 64 bits
    got = sorted((r.id, r.cluster) for r in P.cluster(table(big[:4]), dim=2, k=2).collect())
    assert got == [(int(i), c) for i, c, _ in plain_clusters(list(enumerate(big[:4])), 2, 3, 2, 64)[0]]
    assert P.cluster(table(big), dim=2, k=2).count() == 5


def test_bounds_lie_below_distances_and_rule_out():
    rng = np.random.default_rng(5)
    x = np.rint(rng.normal(size=(3000, 8)) * 40 + 200 * rng.integers(0, 6, (3000, 1))).astype(np.int64)
    c = x[rng.choice(3000, 16, replace=False)]
    pivots = P.choose_pivots(c)
    nearest, cached = P.Nearest(c, pivots), P.between(x, pivots)
    true = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (nearest.bounds(cached) ** 2 <= true).all()
    own, distance = nearest.find(x, cached)
    assert (own == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert nearest.compared < 0.5 * true.size
    assert len(P.choose_pivots(np.zeros((4, 3), np.int64))) == 1


def test_cluster_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want, got = con.execute(SQL).fetchdf(), op12_ptolemaic(spark, sf).toPandas()
    columns = sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).values.tolist()))
    assert columns == sorted(got.columns) and rows(got) == rows(want)
