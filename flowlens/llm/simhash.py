"""SimHash near-duplicate groups found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import LOWER_ASCII, connected
from flowlens.llm.vectors import block_join
from flowlens.tables import cut

SEED = 42
#: Bytes of a text that are split into words at once.
PIECE = 1 << 22
#: Fingerprints in one tree, and rows that a task holds at once.
TREE = 50_000
HELD = 200_000
_SPACES = (32, 9, 10, 11, 12, 13)


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, repeats included, in bounded pieces."""
    carry: list[bytes] = []
    start, any_yet = 0, False
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        run = carry + text[start:end].translate(LOWER_ASCII).split()
        start = end
        if len(run) < words:
            carry = run
            continue
        joined = b" ".join(run)
        ends = np.cumsum([len(w) + 1 for w in run]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[words - 1 :].tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)], dtype=np.uint64)
        any_yet = True
        carry = run[len(run) - words + 1 :] if words > 1 else []
    if not any_yet and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], dtype=np.uint64)


def fingerprint_of(text: bytes | None, words: int) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; no word: zero. As a signed 64-bit number."""
    return fingerprint_from(shingle_hashes(text or b"", words))


def fingerprint_from(hashes) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        for piece in np.array_split(h, max(1, len(h) // 65_536)):
            ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", words: int = 5) -> DataFrame:
    """``keys`` and the fingerprint ``fp`` (bigint) of every row; null text counts as empty."""
    narrow = docs.select(*keys, F.col(text_col).cast("binary").alias("_text"))
    fields = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp bigint"

    def work(batches):
        for b in batches:
            fps = pa.array([fingerprint_of(t, words) for t in b.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], fps], names=[*[f.name for f in fields], "fp"])

    return narrow.mapInArrow(work, schema)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of ``blocks - radius`` of ``blocks`` bit blocks: fingerprints within ``radius`` bits agree on one of them entirely."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(single, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Forest:
    """BK-trees over groups of distinct fingerprints, one tree per group, as arrays.

    A child hangs below its parent under the key of their Hamming distance. All trees grow together, one depth at
    a time: of the fingerprints waiting at a node, the first of each distance becomes the child, the others wait there.
    """

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.fps = fps
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        self.first = first
        at = first[inverse]
        waiting = np.setdiff1d(np.arange(len(fps)), first, assume_unique=True)
        at = at[waiting]
        keys, nodes = [], []
        while len(waiting):
            edge = at * 65 + np.bitwise_count(fps[waiting] ^ fps[at])
            distinct, lead, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(distinct)
            nodes.append(waiting[lead])
            at = waiting[lead][inverse]
            rest = np.ones(len(waiting), bool)
            rest[lead] = False
            waiting, at = waiting[rest], at[rest]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def search(self, fps: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within ``radius``; only edges whose distance differs by at most ``radius`` are followed."""
        query, node = np.arange(len(fps)), root
        while len(query):
            d = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            query = np.repeat(query, n)
            node = self.nodes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting the classes of ``a`` and ``b``; few distinct class pairs are left to unite one by one."""
    pair = np.unique(np.stack([label[a], label[b]], 1), axis=0)
    pair = pair[pair[:, 0] != pair[:, 1]]
    if not len(pair):
        return label
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in pair.tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    old = np.array(sorted(parent), np.int64)
    new = np.array([find(x) for x in old.tolist()], np.int64)
    place = np.minimum(np.searchsorted(old, label), len(old) - 1)
    return np.where(old[place] == label, new[place], label)


def tree_edges(group: np.ndarray, fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the linked fingerprints of each group, at most one per fingerprint.

    role 1: in the tree and searching, 2: in the tree only, 0: searching only.
    """
    _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
    some = count[inverse] > 1
    index = np.flatnonzero(some)
    group, role = group[some], role[some]
    local = np.ascontiguousarray(fps[some]).view(np.uint64)  # bits of signed numbers are counted without their sign
    member = np.flatnonzero(role > 0)
    if not len(member):
        return fps[:0], fps[:0]
    forest = Forest(group[member], local[member])
    heads = group[member][forest.first]
    label = np.arange(len(local))
    search = np.flatnonzero(role < 2)
    at = np.minimum(np.searchsorted(heads, group[search]), len(heads) - 1)
    known = heads[at] == group[search]
    search, root = search[known], forest.first[at[known]]
    step = 4096
    while len(search):
        mine = search[:step]
        for q, node in forest.search(local[mine], root[:step], radius):
            q, node = mine[q], member[node]
            keep = label[q] != label[node]
            if keep.any():
                label = _joined(label, q[keep], node[keep])
        search, root = search[step:], root[step:]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[index[moved]], fps[index[label[moved]]]


def fingerprint_edges(distinct: DataFrame, radius: int = 3, blocks: int = 5, tree: int = TREE) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that join all that lie within ``radius`` bits of each other.

    Fingerprints within the radius agree on ``blocks - radius`` whole blocks, so each choice of blocks is one way of
    dealing them into shards. A shard is one BK-tree. A shard of more than ``tree`` fingerprints becomes several trees, each of
    which all fingerprints of the shard search; so no task holds more than a bounded tree, whatever a shard holds.
    """
    ways = [F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, m in enumerate(block_masks(radius, blocks))]
    dealt = distinct.select("fp", F.explode(F.array(*ways)).alias("_w")).select("fp", "_w.way", "_w.shard")
    large = dealt.groupBy("way", "shard").agg(F.count("*").alias("n")).where(F.col("n") > tree)
    large = cut(large.select("way", "shard", F.ceil(F.col("n") / tree).cast("int").alias("trees")), "large")
    dealt = dealt.join(large, ["way", "shard"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    dealt = dealt.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    dealt = dealt.select("way", "shard", "tree", (F.col("tree") == F.col("own")).cast("int").alias("role"), "fp")
    keys: list[str | Column] = ["way", "shard", "tree"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("role").desc())

    def work(batches):
        held: list[np.ndarray] = []
        n = 0

        def settle(last: bool):
            nonlocal held, n
            way, shard, part, role, fps = (np.concatenate([h[i] for h in held]) for i in range(5))
            new = np.ones(len(fps), bool)
            new[1:] = (way[1:] != way[:-1]) | (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])
            group = np.cumsum(new)
            a, b = tree_edges(group, fps, role, radius)
            held, n = [], 0
            if not last:  # the last tree goes on: it is kept, and has been searched by those before
                stay = (group == group[-1]) & (role > 0)
                held, n = [[way[stay], shard[stay], part[stay], np.full(stay.sum(), 2), fps[stay]]], int(stay.sum())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            held.append(rows)
            n += len(rows[0])
            if n >= HELD + (len(held[0][0]) if held else 0):
                yield settle(False)
        if held:
            yield settle(True)

    return dealt.mapInArrow(work, "a bigint, b bigint")


def groups(rows: DataFrame, lead: str, radius: int = 3, blocks: int = 5, tree: int = TREE) -> DataFrame:
    """(fp, lead): the smallest value of column ``lead`` in the component of every fingerprint of ``rows`` (lead, fp).

    Copies are reduced to one row per fingerprint before anything is compared.
    """
    per = cut(rows.groupBy("fp").agg(F.min(lead).alias("lead")), "fingerprints")
    roots = cut(connected(fingerprint_edges(per.select("fp"), radius, blocks, tree)), "roots")
    named = per.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.join(named.groupBy("root").agg(F.min("lead").alias("first")), "root").select("fp", F.col("first").alias("lead"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3, blocks: int = 5, tree: int = TREE,
) -> DataFrame:
    """(id, fp, component_id), one row per row of ``docs``: the smallest id reachable over links of at most ``radius`` bits.

    Null or wordless text has fingerprint zero and links like any other. Rows without an id take part; a component
    of such rows only has a null component_id. Repeated rows get the same answer. An empty table gives an empty result. A text of any length is read whole, in
    pieces of bounded size.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", words), "simhash")
    return rows.join(groups(rows, "id", radius, blocks, tree), "fp").select("id", "fp", F.col("lead").alias("component_id"))


#: Minima of a sketch, and the share of pairs at the similarity asked that may meet in no band.
SKETCH, MISSED = 128, 1e-4
#: Standard errors by which the sketches of a pair may agree less than asked before the pair is compared by its shingles.
SLACK = 4
#: Shingles of the texts that a task holds while others are compared with them.
HELD_SHINGLES = 4_000_000


def band_of(similarity: float) -> int:
    """Minima of a band: as many as leave no more than MISSED of the pairs at this similarity without a common band."""
    fits = [b for b in range(1, SKETCH + 1) if (1 - similarity**b) ** (SKETCH // b) <= MISSED]
    if not fits:
        raise ValueError(f"sketches of {SKETCH} minima do not find pairs at a similarity of {similarity}")
    return max(fits)


def sketch_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The least value of every one of SKETCH hash functions over the shingles; no shingle: the largest value."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    odd = np.random.default_rng(SKETCH).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for h in hashes:
        for piece in np.array_split(h, max(1, len(h) // 4096)):
            mixed = piece ^ (piece >> np.uint64(31))
            for i in range(SKETCH):
                low[i] = min(low[i], int(((mixed * odd[i]) >> np.uint64(32)).min()))
    return low


def shingle_set(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after uniting the classes of ``a`` and ``b``, and which of the pairs were needed for it."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    used = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used[k] = True
    return _joined(label, a[used], b[used]), used


def apart_pairs(group: np.ndarray, role: np.ndarray, label: np.ndarray, alike, spanning: bool, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group for which ``alike`` holds and whose labels differ.

    Groups are runs of rows, tree rows first: role 2 has met the tree, 1 has not, 0 meets the tree only. With ``spanning`` a pair
    gives its rows one label, so no more pairs come than unite the rows.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [len(group)])))
    few = np.repeat(size <= small, size)

    def met(i, j):
        nonlocal label
        keep = (label[i] != label[j]) & (role[i] > 0) & ((role[i] < 2) | (role[j] < 2))
        i, j = i[keep], j[keep]
        keep = np.concatenate([alike(i[k : k + 65_536], j[k : k + 65_536]) for k in range(0, len(i), 65_536)] or [np.zeros(0, bool)])
        i, j = i[keep], j[keep]
        if spanning and len(i):
            label, used = _united(label, i, j)
            i, j = i[used], j[used]
        return i, j

    for k in range(1, min(small, int(size.max()))):
        i = np.flatnonzero(few[k:] & (group[k:] == group[:-k]))
        yield met(i, i + k)
    for s, n in zip(first[size > small].tolist(), size[size > small].tolist()):
        e, at, step = s + n, s, 1
        while at < e and role[at] > 0:
            end = min(at + step, e)
            i, j = np.nonzero(label[at:end, None] != label[None, at:e])
            i, j = i[j > i] + at, j[j > i] + at
            yield met(i, j)
            at, step = end, min(2 * step, 16)


class Undecided:
    """Texts of a shard whose sketches leave open whether they belong together: exact Jaccard over an inverted index of their shingles.

    ``labels`` are the groups known so far. A pair of one group is not compared, and a link that is found unites two groups, so
    that no more links come out of a shard than it has groups.
    """

    def __init__(self, batch: pa.RecordBatch, similarity: float, least: float):
        self.similarity, self.least, self.links = similarity, least, []
        self.label, self.sketch, self.flat, self.at = self.columns(batch)
        self.group = self.label.copy()
        owner = np.repeat(np.arange(len(self.label)), np.diff(self.at))
        order = np.argsort(self.flat, kind="stable")
        self.keys, self.owner = self.flat[order], owner[order]
        for i in range(len(self.label)):
            self.compare(self.label[i], self.sketch[i], self.flat[self.at[i] : self.at[i + 1]], i + 1)

    @staticmethod
    def columns(batch: pa.RecordBatch):
        lists = batch.column("shingles")
        at = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64))))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
        return batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64), sketch, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at

    def of(self, label: int) -> int:
        """The group that a label belongs to by now: that of its members, if it has any here."""
        place = np.flatnonzero(self.label == label)
        return int(self.group[place[0]]) if len(place) else int(label)

    def compare(self, label: int, sketch: np.ndarray, shingles: np.ndarray, first: int = 0) -> None:
        group = self.of(label)
        open_ = np.flatnonzero(self.group[first:] != group) + first
        open_ = open_[(self.sketch[open_] == sketch).mean(1) >= self.least]
        if not len(open_):
            return
        low, high = np.searchsorted(self.keys, shingles), np.searchsorted(self.keys, shingles, "right")
        n = high - low
        both = np.bincount(self.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)], minlength=len(self.label))[open_]
        size = np.diff(self.at)[open_] + len(shingles)
        hit = open_[both >= self.similarity * (size - both)]
        groups, one = np.unique(self.group[hit], return_index=True)
        self.links += [(int(label), int(self.label[i])) for i in hit[one]]
        if len(groups):
            self.group[np.isin(self.group, groups)] = group

    def meet(self, batch: pa.RecordBatch) -> None:
        label, sketch, flat, at = self.columns(batch)
        for i in range(len(label)):
            self.compare(label[i], sketch[i], flat[at[i] : at[i + 1]])

    def found(self) -> pa.RecordBatch:
        links = np.array(self.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links.min(1)), pa.array(links.max(1))], names=["a", "b"])


def similar_groups(
    docs: DataFrame, lead_col: str, text_col: str = "text", words: int = 5, similarity: float = 0.8, tree: int = TREE
) -> DataFrame:
    """(lead, first): for every row of ``docs`` the smallest ``lead_col`` of its group of similar texts.

    Texts are linked if their shingle sets have a Jaccard similarity of ``similarity`` or more, which is computed for every link. Texts of one
    shingle set are one row from the start. What is compared: shards are dealt by bands of least shingle hashes, as many minima a band as
    leave at most MISSED of the pairs that are just similar enough without a common shard; in a shard all rows meet, and those whose sketches agree
    in ``similarity`` of their minima, less SLACK standard errors, are compared by their shingles. So a pair at exactly ``similarity`` is missed with a
    probability of at most MISSED and that of SLACK standard errors together, about 1.3e-4 at 0.8, and a more similar one with less; it still
    ends up in one group if other links lead there.

    First come the pairs that unite the rows of a shard whose sketches agree in full ``similarity``. Where groups that these have proved leave
    rows undecided, a shard gets the shingle sets of its undecided rows, one row each, compares them in the task, and sends only the links
    that unite groups. So rows grow with the members of a group, never with its pairs. A shard larger than ``tree`` rows, or whose undecided
    rows have more than HELD_SHINGLES shingles, is worked in several parts.

    Null and wordless texts are similar to each other only. A very long text is read in pieces, but its shingle set is held whole by the task that
    compares it. Rows that repeat a ``lead_col`` are rows of their own. An empty table gives an empty result.
    """
    least = similarity - SLACK * (similarity * (1 - similarity) / SKETCH) ** 0.5
    band = band_of(similarity)
    ways = SKETCH // band
    narrow = docs.select(F.col(lead_col).alias("lead"), F.col(text_col).cast("binary").alias("_text"))
    lead_type = narrow.schema["lead"].dataType.simpleString()

    def work(batches):
        for b in batches:
            nodes, sketches = [], []
            for t in b.column("_text").to_pylist():
                hashes = list(shingle_hashes(t or b"", words))
                nodes.append(xxhash.xxh64_intdigest(shingle_set(hashes).tobytes(), SEED))
                sketches.append(sketch_of(hashes).tobytes())
            nodes = pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("lead"), nodes, pa.array(sketches, pa.binary())], names=["lead", "node", "sketch"])

    def sets(batches):
        for b in batches:
            held = [shingle_set(list(shingle_hashes(t or b"", words))).view(np.int64) for t in b.column("_text").to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in held], pa.uint64()).to_numpy().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(held, pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = cut(narrow.mapInArrow(work, f"lead {lead_type}, node bigint, sketch binary"), "sketches")
    per = cut(rows.groupBy("node").agg(F.min("lead").alias("lead"), F.first("sketch").alias("sketch")), "texts")
    bands = [F.struct(F.lit(i).alias("way"), F.xxhash64(F.substring("sketch", 4 * band * i + 1, 4 * band)).alias("shard")) for i in range(ways)]
    dealt = per.select("node", F.explode(F.array(*bands)).alias("_w")).select("node", "_w.way", "_w.shard")
    shards = dealt.groupBy("way", "shard").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shards = cut(shards.select("way", "shard", F.ceil(F.col("n") / tree).cast("int").alias("trees")), "shards")
    dealt = cut(dealt.join(shards, ["way", "shard"]), "dealt")
    meeting = per.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "lead", "sketch")
    wanted = meeting.select(F.col("lead").alias("_lead")).distinct()
    texts = narrow.join(wanted, F.col("lead").eqNullSafe(F.col("_lead")), "left_semi").select("_text")
    shingles = cut(texts.mapInArrow(sets, "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "shingles")
    keys: list[str | Column] = ["way", "shard", "tree"]

    def in_shards(labels: DataFrame, schema: str, spanning: bool) -> DataFrame:
        """What rows of a shard whose labels differ have in common; ``labels`` (node, label, sketch).

        With ``spanning`` pairs (a, b) of rows to compare that unite all alike rows of a shard, else the rows (way, shard, node) that have a
        partner to be compared with and no earlier shard in common with it.
        """
        all_of = dealt.join(labels, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
        all_of = all_of.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        all_of = all_of.select("way", "shard", "tree", (F.col("tree") == F.col("own")).cast("int").alias("role"), "node", "label", "sketch")
        bound = similarity if spanning else least

        def link(batches):
            held, n = [], 0

            def settle(last: bool):
                nonlocal held, n
                way, shard, part, role, node, label, sketch = (np.concatenate([h[i] for h in held]) for i in range(7))
                new = np.ones(len(node), bool)
                new[1:] = (way[1:] != way[:-1]) | (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])
                group = np.cumsum(new)
                undecided = np.zeros(len(node), bool)

                def alike(i, j):
                    same = sketch[i] == sketch[j]
                    keep = same.mean(1) >= bound
                    if not spanning:  # the first shard in which a pair meets names it
                        keep[keep] = same[keep][:, : ways * band].reshape(-1, ways, band).all(2).argmax(1) == way[i[keep]]
                    return keep

                for i, j in apart_pairs(group, role, label, alike, spanning):
                    if spanning and len(i):
                        a, b = node[i], node[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                    undecided[i] = undecided[j] = True
                if not spanning:
                    at = np.flatnonzero(undecided)
                    yield pa.RecordBatch.from_arrays([pa.array(way[at].astype(np.int32)), pa.array(shard[at]), pa.array(node[at])], names=["way", "shard", "node"])
                held, n = [], 0
                if not last:  # the last shard goes on: its rows are kept, and have met each other
                    stay = (group == group[-1]) & (role > 0)
                    held, n = [[way[stay], shard[stay], part[stay], np.full(stay.sum(), 2), node[stay], label[stay], sketch[stay]]], int(stay.sum())

            for batch in batches:
                ints = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
                held.append([*ints, np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint32).reshape(-1, SKETCH)])
                n += batch.num_rows
                if n >= HELD // 2 + len(held[0][0]):
                    yield from settle(False)
            if held:
                yield from settle(True)

        ordered = all_of.repartition(*keys).sortWithinPartitions(*keys, F.col("role").desc(), "node")
        return cut(ordered.mapInArrow(link, schema).distinct(), "met")

    def proved(pairs: DataFrame) -> DataFrame:
        side = lambda c, x: shingles.select(F.col("node").alias(c), F.col("shingles").alias(x))
        both = F.size(F.array_intersect("x", "y"))
        met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        sizes = met.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        return cut(sizes.where(F.col("both") >= F.lit(similarity) * (F.col("sum") - F.col("both"))).select("a", "b"), "links")

    def uniting(labels: DataFrame) -> DataFrame:
        """Links (a, b) of labels, proved in the shards that have undecided rows."""
        members = in_shards(labels, "way int, shard bigint, node bigint", False).join(labels, "node").join(shingles, "node")
        members = cut(members.select("way", "shard", "node", "label", "sketch", "shingles", F.size("shingles").alias("size")), "undecided")
        sizes = members.groupBy("way", "shard").agg(F.sum("size").alias("size"))
        sizes = sizes.select("way", "shard", F.ceil((F.col("size") + 1) / HELD_SHINGLES).cast("int").alias("parts"))
        split = members.join(cut(sizes, "parts"), ["way", "shard"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        split = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = split.select("way", "shard", "part", (F.col("part") == F.col("own")).cast("int").alias("role"), "label", "sketch", "shingles")

        def visit(block: Undecided, batch: pa.RecordBatch):
            block.meet(batch)
            return iter(())

        return block_join(split, ["way", "shard", "part"], "a bigint, b bigint", lambda b: Undecided(b, similarity, least), visit, lambda block: iter([block.found()]))

    known = proved(in_shards(meeting.select("node", F.col("node").alias("label"), "sketch"), "a bigint, b bigint", True))
    groups = cut(connected(known), "proved")
    labels = cut(meeting.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "sketch"), "labels")
    over = cut(connected(uniting(labels)), "roots")  # groups of groups
    named = per.select("node", "lead").join(groups, "node", "left").select("lead", "node", F.coalesce("root", "node").alias("label"))
    named = named.join(over.select(F.col("node").alias("label"), F.col("root").alias("over")), "label", "left").withColumn("root", F.coalesce("over", "label"))
    named = cut(named.join(named.groupBy("root").agg(F.min("lead").alias("first")), "root").select("node", "first"), "groups")
    return rows.select("lead", "node").join(named, "node").select("lead", "first")
