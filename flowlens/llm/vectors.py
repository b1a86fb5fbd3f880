"""What the vector operators share: valid vectors, k-means, and a join of visitors with blocks of members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Is the vector there, with finite components that are not all zero?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """Rows with a valid vector of the most frequent dimension, that dimension, and their number."""
    rows = rows.where(valid(F.col(vector)))
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.limit(0), 1, 0
    return rows.where(F.size(vector) == sizes[0].d), sizes[0].d, sizes[0].n


def sample(rows: DataFrame, key: str, total: int, bound: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, or all if they are fewer, chosen by a hash of the key."""
    steps = 1 << 30
    share = steps if total <= bound else int(steps * bound / total)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(steps)) < share)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a float64 matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres; an emptied centre moves to the row that lies farthest from its own."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centre = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        d = distances(x, centre)
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=col, minlength=k) for col in x.T], 1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centre[empty] = x[np.argsort(d.min(1))[::-1][: len(empty)]]
    return centre


def block_join(
    dealt: DataFrame, keys: list[str], schema: str, start: Callable[[pa.RecordBatch], object], visit: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]],
    finish: Callable[[object], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Let the visitors of every block meet its members.

    ``dealt`` has the columns ``keys`` (bigint, naming the block) and ``role``: 1 for members, of which a block holds a bounded number, 0 for visitors, of
    which it may see any number. A task gets its blocks one after another, members first; it holds the members of one
    block (``start``) and passes the visitors by in batches (``visit``).
    """
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("role").desc())

    def work(batches):
        current, members, block = None, [], None

        def opened():
            nonlocal block, members
            if block is None:
                block = start(pa.Table.from_batches(members).combine_chunks().to_batches()[0]) if members else None
                members = []
            return block

        for b in batches:
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys] + [b.column("role").to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                name, role = tuple(key[lo, :-1]), key[lo, -1]
                if name != current:
                    if (members or block is not None) and opened() is not None and finish:
                        yield from finish(block)
                    current, members, block = name, [], None
                if role:
                    members.append(b.slice(lo, hi - lo))
                elif opened() is not None:
                    yield from visit(block, b.slice(lo, hi - lo))
        if (members or block is not None) and opened() is not None and finish:
            yield from finish(block)

    return ordered.mapInArrow(work, schema)
