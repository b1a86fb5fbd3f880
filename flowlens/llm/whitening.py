"""Whitening of embeddings through the table of distinct vectors and their multiplicities.

Equal integer vectors are grouped, so a vector with a third of all rows is one row of the fit: sums, covariance and projection cost what
the distinct vectors cost. The covariance is a sum of matrix products over batches of distinct vectors, each centred first; only
a matrix of the size of the dimension reaches the driver. Every distinct vector is whitened once, and the rows join their vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.tables import cut

#: A vector with more than one of so many rows is split when rows join their vector; so there are no more than that many of these.
SHARES = 256
LARGE = 10**38


def finite_doubles(vector: Column) -> Column:
    """Is the vector there, with at least one component and no null or non-finite one?"""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * c) of every component, as long; what lies beyond a long is the largest or least long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def wide(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is if results up to ``bound`` fit 64 bits, else as Python integers, which have no bound."""
    return x if bound < 1 << 62 else x.astype(object)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) if abs(int(v)) < LARGE else None for v in values], pa.decimal128(38, 0))


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The total weight and the weighted sum of every dimension, exactly. ``fit`` has x and the weight w."""

    def work(batches: Iterator[pa.RecordBatch]):
        total, sums = 0, [0] * dim
        for b in batches:
            x, w = integers(b.column("x"), dim), b.column("w").to_numpy(zero_copy_only=False).astype(np.int64)
            n = int(w.sum())
            total += n
            part = wide(x, largest(x) * n).T @ wide(w, largest(x) * n)
            sums = [a + int(c) for a, c in zip(sums, part)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), decimals([total, *sums])], names=["i", "v"])

    rows = fit.select("x", "w").mapInArrow(work, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def covariance(fit: DataFrame, dim: int, centred, column: str = "x") -> np.ndarray:
    """The weighted sum of products of centred vectors, from one matrix product per batch.

    ``centred`` turns a list column into rows of doubles around the mean. Every task sends the sum over its batches, row by row of
    the matrix, and the rows meet by their number.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((dim, dim))
        for b in batches:
            x, w = centred(b.column(column)), b.column("w").to_numpy(zero_copy_only=False).astype(np.float64)
            total += (x * w[:, None]).T @ x
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = fit.select(column, "w").mapInArrow(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dim, dim))
    for r in rows:
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def principal(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues and their unit eigenvectors as columns; the largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:most]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: float = 256.0, weights: str = "one", shares: int = SHARES,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every row on the first principal components, each of variance one.

    Components of a vector become the integers floor(scale * c). The fit runs over the distinct integer vectors: with ``weights`` "one" each
    counts once, with "count" as often as rows have it. ``n`` is the total weight and ``deviation`` (decimal) the sum over the dimensions
    of (n * x - S)^2, exact, null beyond 38 digits. ``explained`` is the share of the variance. ``identity_error`` is measured
    from the whitened fit list: how far its covariance lies from the identity at most.

    Left out: null and empty vectors, vectors with a null or non-finite entry, and vectors that have not the most frequent number of
    entries (ties: the larger number). A component without variance has a null ``whitened`` and no part in ``identity_error``; ``explained`` is
    null if nothing varies. Repeated rows and rows without an id are answered each; rows are told apart by nothing but their vector.
    An empty table gives an empty result. Other columns are not looked at.

    A row joins its vector by the vector itself. A vector with more than one of ``shares`` rows has copies in as many shares as it needs, and its rows
    are dealt over them; the list of these vectors is bounded by ``shares``. What the driver gets: the sums, the matrix, and that list.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"unknown weights {weights}")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite_doubles(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    id_type = rows.schema["id"].dataType.simpleString()
    if not sizes:
        return vectors.sparkSession.createDataFrame(
            [], f"id {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    dim, total = sizes[0].d, sizes[0].n
    # Where a row of a split vector goes is drawn at the scan, where a task that runs again draws the same.
    rows = rows.where(F.size("v") == dim).select("id", scaled(F.col("v"), scale).alias("x"), F.rand(7).alias("draw"))
    distinct = cut(rows.groupBy("x").agg(F.count("*").alias("count")), "distinct")
    fit = distinct.select("x", (F.col("count") if weights == "count" else F.lit(1).cast("bigint")).alias("w"))
    n, sums = exact_sums(fit, dim)
    # The mean as a whole part, which is subtracted exactly, and a rest below one.
    whole = np.array([s // n for s in sums], dtype=object)
    rest = np.array([float(Decimal(s - w * n) / n) for s, w in zip(sums, whole)])
    span = largest(np.array([int(w) for w in whole], dtype=object))

    def centred(column: pa.Array) -> np.ndarray:
        x = integers(column, dim)
        return (wide(x, largest(x) + span) - whole).astype(np.float64) - rest

    cov = covariance(fit, dim, centred) / n
    trace = float(np.trace(cov))
    values, axes = principal(cov, min(components, dim))
    k = len(values)
    varies = values > values[0] * dim * np.finfo(float).eps
    turned = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    nsums = np.array(sums, dtype=object)
    top = max(map(abs, sums))

    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = integers(b.column("x"), dim)
            bound = largest(x) * n + top
            apart = wide(x, bound * bound * dim) * n - (nsums if bound * bound * dim >= 1 << 62 else nsums.astype(np.int64))
            flat = (centred(b.column("x")) @ turned).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("count"), decimals((apart * apart).sum(1)), lists], names=["x", "count", "deviation", "whitened"])

    white = cut(distinct.mapInArrow(work, "x array<bigint>, count bigint, deviation decimal(38,0), whitened array<double>"), "whitened")
    flat = white.select("whitened", (F.col("count") if weights == "count" else F.lit(1).cast("bigint")).alias("w"))

    # The whitened vectors have a mean of their own, zero but for rounding, and are centred by it like any other vectors.
    means = flat.agg(*[(F.sum(F.col("whitened")[i] * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(k)]).first()
    middle = np.array([0.0 if m is None else m for m in means])

    def around(column: pa.Array) -> np.ndarray:
        return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), k)) - middle

    off = covariance(flat, k, around, "whitened") / n - np.diag(varies.astype(float))
    error = float(np.abs(off).max())
    per = max(1, total // shares)
    hot = cut(distinct.where(F.col("count") > per).select("x", F.ceil(F.col("count") / per).cast("int").alias("parts")), "hot")
    dealt = rows.join(hot, "x", "left").select("id", "x", F.floor(F.col("draw") * F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    copies = white.join(hot, "x", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    joined = dealt.join(copies.select("x", "part", "deviation", "whitened"), ["x", "part"])
    shares_of = F.array(*[F.lit(float(v / trace)) if trace > 0 else F.lit(None).cast("double") for v in values])
    return joined.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares_of, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
