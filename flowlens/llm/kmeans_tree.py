"""Nearest neighbours by inner product with a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.vectors import block_join, distances, kmeans, matrix, sample, usable
from flowlens.tables import cut

#: Vectors that the tree is fitted on, children of a node, vectors aimed at in a leaf, most leaves.
FIT, BRANCH, LEAF, LEAVES = 20_000, 8, 256, 4096
#: Vectors of a block of leaves; a leaf with more is split.
BLOCK = 16_384
#: Queries on which the number of leaf visits is calibrated, and the recall that they have to reach.
CALIBRATION, RECALL = 128, 0.97


class Tree:
    """Centres of all nodes; children of a node follow each other; leaves are numbered from left to right.

    Inner product becomes distance by one more component that brings every vector to the same length; queries have zero there.
    """

    def __init__(self, x: np.ndarray, longest: float, leaves: int):
        self.longest = longest
        self.centre, self.first, self.n, self.leaf = [np.zeros(x.shape[1] + 1)], [0], [0], [-1]
        self.leaves = 0
        self._split(0, self.extend(x), max(1, leaves))
        self.centre = np.array(self.centre)

    def extend(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))[:, None]), 1)

    def _split(self, node: int, x: np.ndarray, leaves: int) -> None:
        """Divide the sample below a node; each child gets its share of the leaves."""
        centre = kmeans(x, min(BRANCH, leaves)) if leaves > 1 else x[:0]
        if len(centre) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return
        own = distances(x, centre).argmin(1)
        self.first[node], self.n[node] = len(self.centre), len(centre)
        start = len(self.centre)
        self.centre.extend(centre)
        for part in (self.first, self.n):
            part.extend([0] * len(centre))
        self.leaf.extend([-1] * len(centre))
        for c in range(len(centre)):
            mine = x[own == c]
            self._split(start + c, mine, round(leaves * len(mine) / len(x)))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector, by the nearest child at every node."""
        x = self.extend(x)
        at, out = np.zeros(len(x), np.int64), np.full(len(x), -1)
        first, n, leaf = (np.array(v) for v in (self.first, self.n, self.leaf))
        while (out < 0).any():
            for node in np.unique(at[out < 0]).tolist():
                mine = np.flatnonzero((at == node) & (out < 0))
                if n[node] == 0:
                    out[mine] = leaf[node]
                else:
                    at[mine] = first[node] + distances(x[mine], self.centre[first[node] : first[node] + n[node]]).argmin(1)
        return out

    def visits(self, queries: np.ndarray):
        """For every query its leaves, best bin first: the open node nearest to the query comes off the queue and opens its children."""
        d = distances(np.concatenate((queries, np.zeros((len(queries), 1))), 1), self.centre)
        for row in d:
            yield self._walk(row.tolist())

    def _walk(self, row: list[float]):
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.n[node] == 0:
                yield self.leaf[node]
            else:
                for c in range(self.first[node], self.first[node] + self.n[node]):
                    heapq.heappush(queue, (row[c], c))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids; minus infinity is no candidate."""
    some = np.flatnonzero(scores > -np.inf)
    if len(some) > k:
        some = some[scores[some] >= np.partition(scores[some], len(some) - k)[len(some) - k]]
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _hits(query: list, found: list, score: list) -> pa.RecordBatch:
    cat = lambda v, t: np.concatenate([np.zeros(0, t), *v])
    return pa.RecordBatch.from_arrays([pa.array(cat(query, np.int64)), pa.array(cat(found, np.int64)), pa.array(cat(score, np.float64))], names=["query_id", "vec_id", "score"])


def _ids(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def brute_force(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the ``k`` best of all rows (id, vector) for a bounded set of queries held by every task."""
    dim = queries.shape[1]

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                own, score = _ids(part, "id"), queries @ matrix(part.column("vector"), dim).T
                score[ids[:, None] == own[None]] = -np.inf
                top = [best(s, own, k) for s in score]
                yield _hits([np.full(len(t), q) for q, t in zip(ids, top)], [own[t] for t in top], [s[t] for s, t in zip(score, top)])

    return _ranked(rows.select("id", "vector").mapInArrow(work, "query_id bigint, vec_id bigint, score double"), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", fit_on: int = FIT, leaf: int = LEAF,
    block: int = BLOCK, recall: float = RECALL, calibration: int = CALIBRATION,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for every row where ``is_query`` (over column ``id``) holds.

    The tree is fitted on a sample of about ``fit_on`` vectors; every vector is put into a leaf. How many leaves a query visits is
    calibrated: for ``calibration`` queries the true neighbours among all rows are found by brute force, and the visits are widened until
    their mean recall is at least ``recall``. A query also goes on until its leaves hold more than ``k`` candidates. Neighbouring leaves form blocks of bounded
    size, and a leaf larger than that several blocks; a query goes to each of its blocks once, with the list of its leaves there.

    Of equal vectors only the ``k + 1`` smallest ids can be among the best, so the others are left out before anything is shuffled to
    a leaf: a vector that a third of the rows share makes no large leaf. Scores are in double precision on the original vectors; ties go to the smaller id.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components, and rows without an id take no part.
    Repeated rows are separate candidates, but none with the query's own id. An id is one query however many rows it has: repeated rows ask once, and
    of different vectors under one id the least in the order of arrays is asked. With ``k`` candidates or fewer all are returned. An empty
    table gives an empty result.
    """
    every = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    taking, dim, total = usable(every.where(F.col("id").isNotNull()), "vector")
    copies = Window.partitionBy("vector").orderBy("id")
    kept = cut(taking.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vector"), "vectors")
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = kept.agg(F.count("*"), F.max(F.sqrt(length))).first()
    asked = taking.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    if not n:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    fitted = np.array([r.vector for r in sample(kept, "id", n, fit_on).select("vector").collect()], np.float64).reshape(-1, dim)
    tree = Tree(fitted, longest, min(LEAVES, n // leaf) if len(fitted) else 1)
    kind = kept.schema["vector"].dataType.simpleString()

    def settle(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(tree.assign(matrix(part.column("vector"), dim)))], names=["id", "vector", "leaf"])

    settled = cut(kept.mapInArrow(settle, f"id bigint, vector {kind}, leaf bigint"), "leaves")
    size = np.zeros(tree.leaves, np.int64)
    for r in settled.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf
        size[r.leaf] = r.n
    first, blocks, at, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
    for i, s in enumerate(size.tolist()):
        if held and held + s > block:
            at, held = at + 1, 0
        first[i], blocks[i] = at, -(-s // block) if s > block else 1
        at, held = (at + int(blocks[i]), 0) if s > block else (at, held + s)

    wide = _calibrated(asked, kept, settled, tree, n, k, recall, calibration, dim)

    def deal(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                where, target, leaves = [], [], []
                for i, walk in enumerate(tree.visits(matrix(part.column("vector"), dim))):
                    mine: dict[int, list[int]] = {}
                    seen, candidates = 0, 0
                    for leaf_no in walk:
                        for t in range(int(first[leaf_no]), int(first[leaf_no] + blocks[leaf_no])):
                            mine.setdefault(t, []).append(leaf_no)
                        seen, candidates = seen + 1, candidates + int(size[leaf_no])
                        if seen >= wide and candidates > k:
                            break
                    where += [i] * len(mine)
                    target += mine
                    leaves += mine.values()
                got = part.take(pa.array(where, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), got.column("id"), got.column("vector"), pa.array(leaves, pa.list_(pa.int64()))], names=["block", "id", "vector", "leaves"])

    visitors = asked.select("id", "vector").mapInArrow(deal, f"block bigint, id bigint, vector {kind}, leaves array<bigint>")
    starts = F.array(*[F.lit(int(v)).cast("bigint") for v in first]) if len(first) <= 64 else F.from_json(F.lit(str(first.tolist())), "array<bigint>")
    parts = F.array(*[F.lit(int(v)).cast("bigint") for v in blocks]) if len(first) <= 64 else F.from_json(F.lit(str(blocks.tolist())), "array<bigint>")
    place = F.element_at(starts, (F.col("leaf") + 1).cast("int")) + F.pmod(F.xxhash64(F.lit("block"), "id"), F.element_at(parts, (F.col("leaf") + 1).cast("int")))
    members = settled.select(place.alias("block"), "id", "vector", F.array("leaf").alias("leaves"), F.lit(1).alias("role"))
    dealt = members.unionByName(visitors.withColumn("role", F.lit(0)))

    def start(b: pa.RecordBatch):
        order = np.argsort(_ids(b, "id"), kind="stable")
        return _ids(b, "id")[order], matrix(b.column("vector"), dim)[order], b.column("leaves").flatten().to_numpy(zero_copy_only=False)[order]

    def visit(held, b: pa.RecordBatch):
        own, x, leaf_of = held
        for lo in range(0, b.num_rows, 128):
            part = b.slice(lo, 128)
            ids, score = _ids(part, "id"), matrix(part.column("vector"), dim) @ x.T
            score[ids[:, None] == own[None]] = -np.inf
            open_ = np.zeros((len(ids), len(size)), bool)
            lists = part.column("leaves")
            open_[np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)] = True
            score[~open_[:, leaf_of]] = -np.inf
            top = [best(s, own, k) for s in score]
            yield _hits([np.full(len(t), q) for q, t in zip(ids, top)], [own[t] for t in top], [s[t] for s, t in zip(score, top)])

    return _ranked(block_join(dealt, ["block"], "query_id bigint, vec_id bigint, score double", start, visit), k)


def _calibrated(asked, kept, settled, tree: Tree, n: int, k: int, recall: float, calibration: int, dim: int) -> int:
    """The fewest leaf visits with which the calibration queries find the wanted share of their true neighbours."""
    if tree.leaves == 1:
        return 1
    chosen = asked.orderBy(F.xxhash64(F.lit("calibrate"), "id"), "id").limit(calibration).collect()
    if not chosen:
        return 1
    ids, queries = np.array([r.id for r in chosen], np.int64), np.array([r.vector for r in chosen], np.float64).reshape(-1, dim)
    truth = brute_force(kept, ids, queries, k).join(settled.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()
    order = {}
    for q, walk in zip(ids.tolist(), tree.visits(queries)):
        order[q] = {leaf: i for i, leaf in enumerate(walk)}
    needed = np.sort([order[r.query_id][r.leaf] + 1 for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1
