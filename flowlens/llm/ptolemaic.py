"""k-means over integer vectors, with candidates ruled out by Ptolemy's inequality.

For four points, d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|. With p and s a pair of fixed pivots, the distances of every
vector to the pivots are computed once and kept with it; a round adds those of the centroids, and each pair of pivots then gives a
lower bound of d(x, c) without looking at the vectors. Bounds are lowered by more than rounding can have raised them, so what they rule
out cannot be nearest; the rest is compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.whitening import decimals, finite_doubles, integers, largest, scaled, wide
from flowlens.tables import cut

#: Pivots at most, and the share by which bounds are lowered: far above the rounding of a few operations on doubles.
PIVOTS, SAFE = 5, 1e-9
_PIECE = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` and ``b``, matched one by one."""
    bound = (largest(a) + largest(b)) ** 2 * a.shape[1]
    apart = wide(a, bound) - wide(b, bound)
    return (apart * apart).sum(1)


def between(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of every row of ``x`` to every row of ``c``, from exact squares."""
    return np.sqrt(np.stack([squared(x, np.broadcast_to(p, x.shape)).astype(np.float64) for p in c], 1)) if len(c) else np.zeros((len(x), 0))


def choose_pivots(points: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` distinct points that lie far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    far = between(points, points[:1])[:, 0]
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, between(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Nearest:
    """The nearest of a few centroids, by lower bounds over pairs of pivots and exact comparison of what is left."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.c, self.to = centroids, between(centroids, pivots)
        self.apart = between(pivots, pivots)
        self.pairs = list(combinations(range(len(pivots)), 2))
        self.compared = 0

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of rows to centroids; ``cached``: the rows' distances to the pivots."""
        low = np.abs(cached[:, :1] - self.to[None, :, 0]) if cached.shape[1] else np.zeros((len(cached), len(self.c)))
        low = low - SAFE * (cached[:, :1] + self.to[None, :, 0]) if cached.shape[1] else low
        for p, s in self.pairs:
            one, two = cached[:, p, None] * self.to[None, :, s], cached[:, s, None] * self.to[None, :, p]
            np.maximum(low, (np.abs(one - two) - SAFE * (one + two)) / self.apart[p, s], out=low)
        return np.maximum(low * (1 - SAFE), 0.0)

    def find(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid of every row; ties: the smaller number."""
        low = self.bounds(cached)
        best = low.argmin(1)
        distance = squared(x, self.c[best])
        self.compared += len(x)
        left = low * low * (1 - SAFE) <= distance.astype(np.float64)[:, None] * (1 + SAFE)
        left[np.arange(len(x)), best] = False
        for j in range(len(self.c)):
            row = np.flatnonzero(left[:, j])
            if not len(row):
                continue
            self.compared += len(row)
            own = squared(x[row], np.broadcast_to(self.c[j], (len(row), x.shape[1])))
            if own.dtype == object and distance.dtype != object:
                distance = distance.astype(object)
            closer = (own < distance[row]) | ((own == distance[row]) & (j < best[row]))
            best[row[closer]], distance[row[closer]] = j, own[closer]
        return best, distance


def start_hash(id_col: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), id_col.cast("string")), 256)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, pivots: int = PIVOTS,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): every vector with its nearest centroid after ``rounds`` of k-means.

    Vectors with exactly ``dim`` finite entries take part, as integers floor(scale * entry); all others are left out. The first centroids are
    the ``k`` rows of smallest sha256 of "1:<id>" in the order of the hash; rows of one id follow the order of their vectors, and rows without
    an id come last. A round moves every centroid that has vectors to floor(sum / count) of them, exactly; others stay. Distances are
    squared, exact, ties go to the smaller number; a distance or inertia beyond a long is null.

    Repeated rows count and are answered each. Fewer than ``k`` rows give as many centroids. An empty table gives an empty result. Other columns are not looked at.

    Vectors and their distances to the pivots are written once. A round is one pass over them: tasks send sums and counts per centroid, k * dim
    numbers, whatever a cluster holds; only those reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite_doubles(F.col("v")) & (F.size("v") == dim))
    rows = rows.select("id", scaled(F.col("v"), scale).alias("x"))
    id_type = rows.schema["id"].dataType.simpleString()
    out_schema = f"id {id_type}, cluster int, distance decimal(38,0)"
    first = rows.select(F.coalesce(start_hash(F.col("id")), F.lit("~")).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), dim)
    fixed = choose_pivots(centroids, pivots)

    def cache(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            near = between(integers(b.column("x"), dim), fixed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, len(fixed)), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), lists], names=["id", "x", "cached"])

    table = cut(rows.mapInArrow(cache, f"id {id_type}, x array<bigint>, cached array<double>"), "pivots")

    def pieces(batches: Iterator[pa.RecordBatch]):
        """Batches in slices that bound the tables of bounds."""
        for b in batches:
            for at in range(0, b.num_rows, _PIECE):
                part = b.slice(at, _PIECE)
                cached = part.column("cached").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(fixed))
                yield part, integers(part.column("x"), dim), cached

    def sums_of(centroids: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]):
            nearest = Nearest(centroids, fixed)
            count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), object)
            for _, x, cached in pieces(batches):
                own, _ = nearest.find(x, cached)
                for j in np.unique(own):
                    mine = x[own == j]
                    count[j] += len(mine)
                    sums[j] += wide(mine, largest(mine) * len(mine)).sum(0)
            some = np.flatnonzero(count)
            values = [v for j in some for v in (count[j], *sums[j])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dim + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dim), len(some)), pa.int32()), decimals(values)], names=["j", "i", "v"]
            )

        return table.select("x", "cached").mapInArrow(work, "j int, i int, v decimal(38,0)").groupBy("j", "i").agg(F.sum("v").alias("v")).collect()

    for _ in range(rounds):
        found = {(r.j, r.i): int(r.v) for r in sums_of(centroids)}
        moved = [[found[j, i] // found[j, -1] for i in range(dim)] if (j, -1) in found else c.tolist() for j, c in enumerate(centroids)]
        centroids = np.array(moved, np.int64).reshape(len(moved), dim)

    def assign(batches: Iterator[pa.RecordBatch]):
        nearest = Nearest(centroids, fixed)
        for part, x, cached in pieces(batches):
            own, distance = nearest.find(x, cached)
            distance = decimals(distance) if distance.dtype == object else pa.array(distance).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own, pa.int32()), distance], names=["id", "cluster", "distance"])

    final = cut(table.mapInArrow(assign, out_schema), "assigned")
    inertia = {r.cluster: r.s for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    exact = lambda v: F.expr(f"try_cast({'NULL' if v is None else int(v)}BD AS bigint)") if v is not None else F.lit(None).cast("bigint")
    per = F.array(*[exact(inertia.get(j, 0)) for j in range(len(centroids))])
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids])
    every = None if any(v is None for v in inertia.values()) else sum(map(int, inertia.values()))
    at = F.col("cluster") + 1
    return final.select(
        "id", "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"), F.element_at(per, at).alias("cluster_inertia"), exact(every).alias("inertia"),
        F.element_at(names, at).alias("centroid_sha256"),
    )
