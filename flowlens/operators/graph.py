"""Window graphs as tables: edges, nodes, degrees, PageRank, clustering.

The working table is the pair table: one row per (window, source, destination) with its number of flows
and bytes. It is built by one map-side combined aggregation of the flows; everything structural reads it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.ordering import places
from flowlens.tables import cut

NODE = ["window_id", "host"]


def edges(df: DataFrame) -> DataFrame:
    """One edge per flow; parallel edges and self-loops stay."""
    return df.select("window_id", "flow_id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))


def nodes(df: DataFrame) -> DataFrame:
    """Hosts active in each window, from one scan."""
    return df.select("window_id", F.explode(F.array("src_ip", "dst_ip")).alias("host")).distinct()


def local_node_ids(node_table: DataFrame) -> DataFrame:
    """0-based position of each host in name order inside its window."""
    return places(node_table, ["window_id"], ["host"], "node")


def flow_bytes(df: DataFrame):
    if "total_bytes" in df.columns:
        return F.col("total_bytes")
    side = lambda c: F.col(c) if c in df.columns else None
    return S.total_bytes(side("in_bytes"), side("out_bytes"))


def pair_table(df: DataFrame) -> DataFrame:
    """(window, src, dst) with the number of flows ``w`` and their bytes: the collapsed multigraph."""
    return df.groupBy("window_id", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).agg(
        F.count("*").alias("w"), F.sum(flow_bytes(df)).alias("bytes")
    )


def endpoints(pairs: DataFrame) -> DataFrame:
    """One row per (window, host, peer). A self-loop counts as received and as sent, and as its own peer."""
    side = lambda host, peer, got, sent: F.struct(
        F.col(host).alias("host"), F.col(peer).alias("peer"), got.alias("flows_in"), sent.alias("flows_out"), F.col("bytes")
    )
    both = F.array(side("src", "dst", F.lit(0).cast("bigint"), F.col("w")), side("dst", "src", F.col("w"), F.lit(0).cast("bigint")))
    rows = pairs.select("window_id", F.explode(both).alias("e")).select("window_id", "e.*")
    return rows.groupBy("window_id", "host", "peer").agg(
        F.sum("flows_in").alias("flows_in"), F.sum("flows_out").alias("flows_out"), F.sum("bytes").alias("bytes")
    )


def host_counts(ends: DataFrame) -> DataFrame:
    """Flows received and sent, distinct peers and bytes of every host in every window."""
    return ends.groupBy(*NODE).agg(
        F.sum("flows_in").alias("flows_in"), F.sum("flows_out").alias("flows_out"), F.count("*").alias("peers"), F.sum("bytes").alias("bytes")
    )


def port_counts(df: DataFrame) -> DataFrame:
    """Flows sent per (window, host, destination port)."""
    return df.groupBy("window_id", F.col("src_ip").alias("host"), "dst_port").agg(F.count("*").alias("n"))


def _rank(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, where: np.ndarray, iters: int, damping: float) -> np.ndarray:
    """Power iteration over all windows of a batch at once; ``where`` is the window of each node."""
    n = len(where)
    size = np.bincount(where)[where].astype(float)
    sent = np.bincount(src, weights=weight, minlength=n)
    step, stuck = weight / sent[src], sent == 0
    rank = 1.0 / size
    for _ in range(iters):
        lost = np.bincount(where, weights=np.where(stuck, rank, 0.0))[where]
        moved = np.bincount(dst, weights=rank[src] * step, minlength=n)
        rank = (1.0 - damping) / size + damping * (moved + lost / size)
        rank = rank / np.bincount(where, weights=rank)[where]
    return rank * size


def _simple_triangles(src: np.ndarray, dst: np.ndarray, n: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours and triangles of every node of an undirected simple graph, which may hold many windows side by side.

    Every edge leads from its end of fewer neighbours to the other one, so a node has few onward edges; two onward edges of one node are
    sides of a triangle if their ends are linked. Pairs of onward edges are looked up in bounded slices.
    """
    apart = src != dst
    edges = np.unique(np.minimum(src, dst)[apart].astype(np.int64) * n + np.maximum(src, dst)[apart])
    low, high = edges // n, edges % n
    k = np.bincount(low, minlength=n) + np.bincount(high, minlength=n)
    back = (k[low] > k[high]) | ((k[low] == k[high]) & (low > high))
    low, high = np.where(back, high, low), np.where(back, low, high)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    key = low * n + high
    onward = np.searchsorted(low, low, "right") - np.arange(len(low)) - 1  # later onward edges of the same node
    upto, count, at = np.cumsum(onward), np.zeros(n), 0
    while at < len(low):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
        one = np.repeat(np.arange(at, end), onward[at:end])
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(onward[at:end]) - onward[at:end], onward[at:end])
        a, b = high[one], high[two]
        first = np.searchsorted(key, a * n + b)
        second = np.searchsorted(key, b * n + a)
        linked = (key[np.minimum(first, len(key) - 1)] == a * n + b) | (key[np.minimum(second, len(key) - 1)] == b * n + a)
        for node in (low[one], a, b):
            count += np.bincount(node[linked], minlength=n)
        at = end
    return k.astype(float), count


def _structure_of(iters: int, damping: float, with_triangles: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = len(pdf)
        host, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        window, windows = pd.factorize(pdf["window_id"])
        node, flat = np.unique(np.concatenate([window, window]) * len(names) + host, return_inverse=True)
        src, dst, where = flat[:m], flat[m:], node // len(names)
        out = {
            "window_id": np.asarray(windows)[where], "host": np.asarray(names)[node % len(names)],
            "pagerank": _rank(src, dst, pdf["w"].to_numpy(float), where, iters, damping),
        }
        if with_triangles:
            k, tri = _simple_triangles(src, dst, len(node))  # no edge leaves its window
            out |= {"k": k.astype("int64"), "triangles": tri.astype("int64")}
        return pd.DataFrame(out)

    return run


#: Pairs of windows that a task of the grouped form holds at once; a larger window is refused there.
GROUP = 200_000


def structure_grouped(pairs: DataFrame, iters: int = 30, damping: float = 0.85, with_triangles: bool = True, group: int = GROUP) -> DataFrame:
    """PageRank times hosts, neighbours and triangles, each window whole in one task; many windows share a vectorised call.

    For windows that a time span keeps small: none may have more than ``group`` pairs, which is checked. Windows are dealt over as many
    hash buckets as keep the mean bucket at half of that.
    """
    sizes = pairs.groupBy("window_id").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total, largest = sizes[0] or 0, sizes[1] or 0
    if largest > group:
        raise ValueError(f"a window has {largest} pairs, more than the {group} that a task may hold; use the form by joins")
    buckets = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // group))
    spread = pairs.select("window_id", "src", "dst", "w").withColumn("_bucket", F.pmod(F.xxhash64("window_id"), F.lit(buckets)))
    schema = f"window_id {dict(pairs.dtypes)['window_id']}, host string, pagerank double" + (", k bigint, triangles bigint" if with_triangles else "")
    work = _structure_of(iters, damping, with_triangles)
    return spread.groupBy("_bucket").applyInPandas(lambda pdf: work(pdf), schema)


#: Steps of a host that one row holds, about.
PIECE = 1024
#: Iterations that one written table holds, and how far the growth of a window's hosts may differ for it to be settled.
STEPS, SETTLED = 10, 1e-13


def _coefficients(iters: int, damping: float):
    """From the sums T[0..iters] of a window (column ``_t``), the weights with which y[0..iters] add up to the ranks after ``iters`` steps.

    What hosts without sent flows hold in y[j] is what does not move on: T[j] - T[j+1] / d. With c[k] = (1 - d) + d * (rank held by those after k
    steps), the ranks are y[k] + sum of c[k-1-j] * y[j].
    """
    held = F.transform(F.sequence(F.lit(0), F.lit(iters - 1)), lambda j: F.col("_t")[j] - F.col("_t")[j + 1] / damping)

    def step(c, k):  # c holds c[k-1], ..., c[0], 1
        lost = F.aggregate(F.zip_with(c, F.slice(held, F.lit(1), F.size(c)), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
        return F.concat(F.array(F.lit(1.0 - damping) + damping * lost), c)

    return F.aggregate(F.sequence(F.lit(0), F.lit(iters - 1)), F.array(F.lit(1.0)), step)


def pagerank_iterative(pairs: DataFrame, iters: int = 30, damping: float = 0.85, steps: int = STEPS, settled: float = SETTLED) -> DataFrame:
    """The same values by joins, for windows of any size.

    What is iterated is y[j+1] = d * P' * y[j] from the even start, without the rank that hosts which send nothing give back: that rank is spread evenly, so
    it only scales the start, and the ranks are a weighted sum of all y[j], with weights that follow from a window's sums. So
    an iteration is one join and one sum, and moves nothing but messages: steps and state are dealt alike on (window, host), and ``steps``
    iterations are one job, in which the table of steps is dealt once, and one written table. A window ends early if its messages run
    dry or if all its hosts shrink alike, since the rest is then a geometric series.
    """
    if iters < 1:
        raise ValueError("at least one iteration")
    names = pairs.select("window_id", F.explode(F.array("src", "dst")).alias("host")).distinct()
    first = cut(names, "names")
    sizes = cut(first.groupBy("window_id").agg(F.count("*").cast("double").alias("size")), "sizes")
    first = cut(first.join(sizes, "window_id").select(*NODE, (1.0 / F.col("size")).alias("y")), "first")
    # The steps of a host lie in rows of about PIECE steps each, so that what is joined are hosts, and a hub is several rows.
    piece = F.pmod(F.xxhash64("dst"), F.greatest(F.lit(1), F.ceil(F.col("peers") / PIECE)))
    sent = pairs.groupBy("window_id", F.col("src").alias("host")).agg(F.sum("w").alias("sent"), F.count("*").alias("peers"))
    step = pairs.select("window_id", F.col("src").alias("host"), "dst", "w").join(sent, NODE)
    near = F.collect_list(F.struct("dst", (damping * F.col("w") / F.col("sent")).alias("step"))).alias("near")
    edges = cut(step.groupBy(*NODE, piece.alias("piece")).agg(near).select(*NODE, "near"), "steps")
    # A join asks for hosts that are not null. Where all are, this is asked of the sums that are kept as well as of those that go on: then they are one
    # plan and worked out once.
    known = pairs.where(F.col("dst").isNull()).isEmpty()
    tables, ended = [first.withColumn("j", F.lit(0))], None
    y, done = first, 0
    while done < iters:
        block = min(steps, iters - done)
        rows = []
        for j in range(done + 1, done + block + 1):
            moved = edges.join(y.hint("shuffle_hash"), NODE)
            moved = moved.select("window_id", F.explode("near").alias("_n"), "y").select("window_id", F.col("_n.dst").alias("host"), (F.col("_n.step") * F.col("y")).alias("y"))
            if known:
                moved = moved.where(F.col("host").isNotNull())
            y = moved.groupBy(*NODE).agg(F.sum("y").alias("y"))
            rows.append(y.withColumn("j", F.lit(j)))
        together = rows[0]
        for r in rows[1:]:
            together = together.unionByName(r)
        tables.append(cut(together, "ranks"))
        done += block
        y = tables[-1].where(F.col("j") == done).drop("j")
        if done < iters and block > 1:
            last = tables[-1].where(F.col("j") >= done - 1).groupBy(*NODE).agg(
                F.max(F.when(F.col("j") == done - 1, F.col("y"))).alias("a"), F.max(F.when(F.col("j") == done, F.col("y"))).alias("b")
            )
            pace = F.col("b") / F.col("a")
            same = last.groupBy("window_id").agg(F.min(pace).alias("slow"), F.max(pace).alias("fast"), F.count("*").alias("n"), F.count("a").alias("na"), F.count("b").alias("nb"))
            same = same.where((F.col("n") == F.col("na")) & (F.col("n") == F.col("nb")) & (F.col("fast") - F.col("slow") <= settled * F.col("fast")))
            same = cut(same.select("window_id", F.lit(done).alias("at"), ((F.col("slow") + F.col("fast")) / 2).alias("pace")), "settled")
            ended = same if ended is None else ended.unionByName(same)
            y = y.join(same.select("window_id"), "window_id", "left_anti")
            if y.isEmpty():
                break
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    sums = every.groupBy("window_id", "j").agg(F.sum("y").alias("t")).groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("j", "t"))).alias("_m"))
    if ended is None:
        sums = sums.withColumns({"at": F.lit(None).cast("int"), "pace": F.lit(None).cast("double")})
    else:
        sums = sums.join(ended, "window_id", "left")
    whole = F.transform(
        F.sequence(F.lit(0), F.lit(iters)),
        lambda j: F.when(j > F.col("at"), F.try_element_at("_m", F.col("at")) * F.pow("pace", j - F.col("at"))).otherwise(F.coalesce(F.try_element_at("_m", j), F.lit(0.0))),
    )
    weights = sums.select("window_id", "at", "pace", whole.alias("_t")).withColumn("_c", _coefficients(iters, damping))
    # A settled window adds all that is to come to its last row.
    rest = F.aggregate(
        F.sequence(F.lit(0), F.lit(iters) - F.col("at")), F.lit(0.0), lambda acc, i: acc + F.element_at("_c", F.col("at") + i + 1) * F.pow("pace", i)
    )
    weights = cut(weights.select("window_id", "_c", "at", F.when(F.col("at").isNotNull(), rest).alias("rest")).join(sizes, "window_id"), "weights")
    scale = F.when(F.col("j") == F.col("at"), F.col("rest")).otherwise(F.element_at("_c", F.col("j") + 1))
    return every.join(weights, "window_id").groupBy(*NODE).agg(F.sum(F.col("y") * scale * F.col("size")).alias("pagerank"))


def links(pairs: DataFrame) -> DataFrame:
    """The linked (window, host, peer) of ``endpoints``, each in both directions, without their flows and bytes; no host is its own peer."""
    sides = F.array(F.struct(F.col("src").alias("host"), F.col("dst").alias("peer")), F.struct(F.col("dst").alias("host"), F.col("src").alias("peer")))
    apart = pairs.where(F.col("src") != F.col("dst"))
    return apart.select("window_id", F.explode(sides).alias("e")).select("window_id", "e.*").distinct()


def number_hosts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with numbers in place of the names of hosts, and the written table (window, host, node) of these numbers."""
    names = pairs.select("window_id", F.explode(F.array("src", "dst")).alias("host")).distinct()
    nodes = cut(names.withColumn("node", F.monotonically_increasing_id()), "nodes")
    of = lambda side: nodes.select("window_id", F.col("host").alias(side), F.col("node").alias(f"_{side}"))
    numbered = pairs.select("window_id", "src", "dst", "w").join(of("src"), ["window_id", "src"]).join(of("dst"), ["window_id", "dst"])
    return cut(numbered.select("window_id", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "w"), "numbered"), nodes


def structure(
    pairs: DataFrame, ends: DataFrame | None = None, iters: int = 30, damping: float = 0.85, with_triangles: bool = True, grouped: bool = False, numbered: bool = False,
) -> DataFrame:
    """PageRank times the number of hosts of the window, with neighbours ``k`` and ``triangles`` if asked.

    Ranks follow the weighted multigraph; the rank of hosts without sent flows is spread evenly. Joins do the work, for windows of any
    size. With ``grouped``, the caller's choice for windows that are known to be small, a window is worked whole inside a task, and one
    that is too large is refused. With ``numbered``, the choice for large windows, hosts are numbers in all steps and get their names at the end. All give the
    same values. ``pairs`` (and ``ends``) should be written tables, since they are read more than once.
    """
    if grouped:
        return structure_grouped(pairs, iters, damping, with_triangles)
    # A host without a name meets nothing in a join; a number would.
    if numbered and pairs.where(F.col("window_id").isNull() | F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
        pairs, nodes = number_hosts(pairs)
        found = structure(pairs, cut(links(pairs), "links") if with_triangles else None, iters, damping, with_triangles)
        return found.withColumnRenamed("host", "node").join(nodes, ["window_id", "node"]).select(*NODE, *[c for c in found.columns if c not in NODE])
    ranks = pagerank_iterative(pairs, iters, damping)
    if with_triangles:
        found = clustering(cut(endpoints(pairs), "endpoints") if ends is None else ends).select(*NODE, "k", "triangles")
        ranks = ranks.join(found, NODE, "left").na.fill(0, ["k", "triangles"])
    return ranks


def pagerank(pairs: DataFrame, iters: int = 30, damping: float = 0.85, grouped: bool = False) -> DataFrame:
    return structure(pairs, None, iters, damping, with_triangles=False, grouped=grouped)


def clustering_of(k, found):
    """Linked share of the k * (k - 1) / 2 neighbour pairs; 0 with fewer than two neighbours."""
    return F.when(k >= 2, found / (k * (k - 1) / 2.0)).otherwise(F.lit(0.0))


def triangles(ends: DataFrame) -> DataFrame:
    """Triangles through every host of every window's undirected simple graph.

    Each edge points from its end of lower degree to the higher one, so no host has more than
    sqrt(2 * edges) outgoing neighbours: that bounds the arrays, and an edge finds its triangles by
    intersecting two of them instead of pairing neighbours.
    """
    links = ends.where(F.col("host") != F.col("peer")).select(*NODE, "peer")
    known = links.join(links.groupBy(*NODE).agg(F.count("*").alias("k")), NODE)
    first, second = F.least("host", "peer"), F.greatest("host", "peer")
    # Both directions of an edge meet once, each bringing the degree of its own end.
    edge = known.groupBy("window_id", first.alias("a"), second.alias("b")).agg(
        F.max(F.when(F.col("host") == first, F.col("k"))).alias("ka"), F.max(F.when(F.col("host") == second, F.col("k"))).alias("kb")
    )
    forward = F.struct("ka", "a") < F.struct("kb", "b")
    low, high = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    out = cut(edge.groupBy("window_id", low.alias("low")).agg(F.collect_set(high).alias("near")), "neighbours")
    arcs = out.select("window_id", "low", "near", F.explode("near").alias("high"))
    both = arcs.join(out.select("window_id", F.col("low").alias("high"), F.col("near").alias("far")), ["window_id", "high"])
    common = both.select("window_id", "low", "high", F.array_intersect("near", "far").alias("third")).where(F.size("third") > 0)
    hit = lambda host, n: F.struct(host.alias("host"), n.cast("bigint").alias("n"))
    hits = F.concat(
        F.array(hit(F.col("low"), F.size("third")), hit(F.col("high"), F.size("third"))),
        F.transform("third", lambda c: hit(c, F.lit(1))),
    )
    return common.select("window_id", F.explode(hits).alias("h")).select("window_id", "h.*").groupBy(*NODE).agg(F.sum("n").alias("triangles"))


def clustering(ends: DataFrame) -> DataFrame:
    """Clustering coefficient of every host with a neighbour, by joins."""
    k = ends.where(F.col("host") != F.col("peer")).groupBy(*NODE).agg(F.count("*").alias("k"))
    found = k.join(triangles(ends), NODE, "left").na.fill(0, ["triangles"])
    return found.withColumn("clustering", clustering_of(F.col("k"), F.col("triangles")))


def structural_columns(table: DataFrame, pairs: DataFrame, ends: DataFrame, iters: int = 30, damping: float = 0.85, grouped: bool = False) -> DataFrame:
    """Structural context columns for a host-count table."""
    joined = table.join(structure(pairs, ends, iters, damping, grouped=grouped), NODE)
    return joined.withColumns(
        {
            "in_degree": F.log1p("flows_in"), "out_degree": F.log1p("flows_out"), "unique_peers": F.log1p("peers"),
            "clustering": clustering_of(F.col("k"), F.col("triangles")),
        }
    )


def structural_context(df: DataFrame, iters: int = 30, damping: float = 0.85, grouped: bool = False) -> DataFrame:
    """log degrees, log peers, PageRank times hosts, clustering."""
    pairs = cut(pair_table(df), "pairs")
    ends = cut(endpoints(pairs), "endpoints")
    out = structural_columns(host_counts(ends), pairs, ends, iters, damping, grouped)
    return out.select(*NODE, "in_degree", "out_degree", "unique_peers", "pagerank", "clustering")


def endpoint_context(df: DataFrame, node_table: DataFrame, columns: list[str]) -> DataFrame:
    """Each flow with the node columns of its source (``src__``) and destination (``dst__``)."""
    out = df
    for side, key in (("src", "src_ip"), ("dst", "dst_ip")):
        named = node_table.select("window_id", F.col("host").alias(key), *[F.col(c).alias(f"{side}__{c}") for c in columns])
        out = out.join(named, ["window_id", key])
    return out


def node_context(df: DataFrame, node_table: DataFrame, columns: list[str], number: str = "node") -> DataFrame:
    """The columns of ``endpoint_context`` for flows that carry the numbers of their nodes, ``src__node`` and ``dst__node``, in place of window and addresses."""
    out = df
    for side in ("src", "dst"):
        key = f"{side}__{number}"
        named = node_table.select(F.col(number).alias(key), *[F.col(c).alias(f"{side}__{c}") for c in columns])
        out = out.join(named, key).drop(key)
    return out


def host_degree(context: DataFrame) -> DataFrame:
    """Number of flows of a host, recovered from its log degrees."""
    return context.withColumn("degree", F.expm1("in_degree") + F.expm1("out_degree"))
