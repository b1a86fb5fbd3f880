"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table distances, exact rerank."""

from __future__ import annotations

from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import connected
from flowlens.llm.simhash import _joined
from flowlens.llm.vectors import block_join, distances, kmeans, matrix, sample, usable
from flowlens.tables import cut

#: Vectors that the quantisers are fitted on, vectors aimed at in a list, most lists, subspaces, codes of a subspace.
FIT, LIST, LISTS, PARTS, CODES = 10_000, 4096, 2048, 8, 64
#: Members of a block; a list with more is split.
BLOCK = 4096

Quantiser = namedtuple("Quantiser", "coarse books edges")


def fit(x: np.ndarray, lists: int) -> Quantiser:
    """Coarse centres of unit vectors and a codebook per subspace of their residuals."""
    coarse = kmeans(x, lists)
    residual = x - coarse[distances(x, coarse).argmin(1)]
    edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
    return Quantiser(coarse, [kmeans(residual[:, a:b], CODES) for a, b in zip(edges, edges[1:])], edges)


def encode(q: Quantiser, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual codes and the exact distance of every vector to what its code stands for."""
    residual = x - q.coarse[cell]
    codes = np.empty((len(x), len(q.books)), np.uint8)
    back = np.empty_like(residual)
    for s, (book, a, b) in enumerate(zip(q.books, q.edges, q.edges[1:])):
        codes[:, s] = distances(residual[:, a:b], book).argmin(1)
        back[:, a:b] = book[codes[:, s]]
    return codes, np.sqrt(((residual - back) ** 2).sum(1))


def probes(q: Quantiser, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The list of every vector, and which lists can hold a vector within ``reach`` of it.

    A vector of another list lies beyond the plane halfway between the two centres, so a list is out of
    reach when that plane is. This makes the probes sufficient: no list that is left out can hold a link.
    """
    d = distances(x, q.coarse)
    own = d.argmin(1)
    apart = np.sqrt(distances(q.coarse, q.coarse))[own]
    plane = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart, 1e-12)
    return own, plane <= reach + 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


class Block:
    """Members of one block of a list, compared with themselves and with visitors."""

    def __init__(self, q: Quantiser, b: pa.RecordBatch, dim: int, least: float):
        self.q, self.dim, self.least = q, dim, least
        self.reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
        self.node = b.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = b.column("copies").to_numpy(zero_copy_only=False).astype(np.int64)
        self.x = unit(matrix(b.column("vector"), dim))
        self.cell = int(b.column("list")[0].as_py())
        self.codes, self.error = encode(q, self.x, np.full(len(self.x), self.cell))
        self.links = np.zeros(len(self.x), np.int64)
        self.label = np.arange(len(self.x))

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, member) pairs with a cosine of at least ``least``.

        The table distance to a code differs from the distance to its vector by the code's own error at most, so the
        first test passes every link; the cosine itself decides.
        """
        total = np.zeros((len(x), len(self.x)))
        r = x - self.q.coarse[self.cell]
        for s, (book, a, b) in enumerate(zip(self.q.books, self.q.edges, self.q.edges[1:])):
            total += distances(r[:, a:b], book)[:, self.codes[:, s]]
        i, j = np.nonzero(total <= (self.reach + self.error + 1e-6)[None] ** 2)
        keep = np.concatenate([np.einsum("nd,nd->n", x[i[k : k + 65_536]], self.x[j[k : k + 65_536]]) >= self.least for k in range(0, len(i), 65_536)] or [np.zeros(0, bool)])
        return i[keep], j[keep]

    def visit(self, b: pa.RecordBatch):
        node = b.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
        weight = b.column("copies").to_numpy(zero_copy_only=False).astype(np.int64)
        x = unit(matrix(b.column("vector"), self.dim))
        for lo in range(0, len(x), 512):
            mine = slice(lo, lo + 512)
            i, j = self.near(x[mine])
            if not len(i):
                continue
            n = len(node[mine])
            links = np.bincount(i, weights=self.weight[j], minlength=n).astype(np.int64)
            self.links += np.bincount(j, weights=weight[mine][i], minlength=len(self.links)).astype(np.int64)
            both = _joined(np.concatenate((self.label, len(self.label) + np.arange(n))), len(self.label) + i, j)
            self.label = both[: len(self.label)]
            some = np.flatnonzero(links)
            yield self.rows(node[mine][some], links[some], self.node[both[len(self.label) :][some]])

    def finish(self):
        for lo in range(0, len(self.x), 512):
            i, j = self.near(self.x[lo : lo + 512])
            i = i + lo
            i, j = i[i != j], j[i != j]
            self.links += np.bincount(i, weights=self.weight[j], minlength=len(self.links)).astype(np.int64)
            self.label = _joined(self.label, i, j)
        some = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        yield self.rows(self.node[some], self.links[some], self.node[self.label[some]])

    @staticmethod
    def rows(node, links, root) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98,
    fit_on: int = FIT, list_size: int = LIST, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row: links between rows of one label with a cosine of at least ``least``.

    Equal vectors of a label are reduced to one with a count. Quantisers are fitted on a sample of about ``fit_on`` vectors; every
    vector is coded, put into its list and shown to the lists that can hold a link (of two lists, the one with the smaller
    number visits). A list of more than ``block`` vectors becomes several blocks. A task counts links and returns one row per linked vector,
    so a group of near copies costs its comparisons, not rows. Nothing is lost: probes and table distances leave out only what cannot link.

    Vectors that are null, zero, of another dimension than most, or hold null or non-finite components, and rows without a label or
    an id, have no links and are a component of their own (null for rows without an id). Rows that share id, label and vector are
    copies that link with each other; different vectors under one id count as one node. An empty table gives an empty result.
    """
    every = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    taking, dim, total = usable(every.where(F.col("id").isNotNull() & F.col("label").isNotNull()), "vector")
    alone = every.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    if not total:
        return alone
    per = taking.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    per = cut(per.withColumn("tag", F.xxhash64("label")), "vectors")
    n = per.count()
    fitted = sample(per.select("node", "vector"), "node", n, fit_on).select("vector").collect()
    quantiser = fit(unit(np.array([r.vector for r in fitted], np.float64)) if fitted else np.eye(1, dim), max(1, min(LISTS, n // list_size)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    kind = per.schema["vector"].dataType.simpleString()

    def deal(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                own, may = probes(quantiser, unit(matrix(part.column("vector"), dim)), reach)
                may &= np.arange(len(quantiser.coarse))[None] >= own[:, None]
                may[np.arange(len(own)), own] = True
                i, cell = np.nonzero(may)
                for k in range(0, len(i), 16_384):
                    at, c = i[k : k + 16_384], cell[k : k + 16_384]
                    taken = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(taken.column(x) for x in ("tag", "node", "copies", "vector")), pa.array(c.astype(np.int64)), pa.array((own[at] == c).astype(np.int32))], names=["tag", "node", "copies", "vector", "list", "own"])

    dealt = cut(per.select("tag", "node", "copies", "vector").mapInArrow(deal, f"tag bigint, node bigint, copies bigint, vector {kind}, list bigint, own int"), "probes")
    sizes = cut(dealt.groupBy("tag", "list").agg(F.sum("own").alias("size")).where(F.col("size") > 0).withColumn("blocks", F.ceil(F.col("size") / block).cast("bigint")), "lists")
    dealt = dealt.join(sizes.select("tag", "list", "blocks"), ["tag", "list"])
    mine = F.pmod(F.xxhash64(F.lit("block"), F.col("node")), F.col("blocks"))
    dealt = dealt.withColumn("mine", F.when(F.col("own") == 1, mine).otherwise(F.lit(-1)).cast("bigint"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.greatest("mine", F.lit(0).cast("bigint")), F.col("blocks") - 1)))
    dealt = dealt.select("tag", "list", "block", (F.col("block") == F.col("mine")).cast("int").alias("role"), "node", "copies", "vector")
    met = block_join(
        dealt, ["tag", "list", "block"], "node bigint, links bigint, root bigint",
        lambda b: Block(quantiser, b, dim, least), lambda s, b: s.visit(b), lambda s: s.finish(),
    )
    met = cut(met, "links")
    roots = connected(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    known = per.select("label", "vector", "node", "copies").join(links, "node", "left").join(roots, "node", "left")
    known = known.select(F.col("label").alias("_l"), F.col("vector").alias("_v"), "node", "copies", "links", "root")
    joined = every.join(known, (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("root", "node", "id")
    return joined.select(
        "id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
