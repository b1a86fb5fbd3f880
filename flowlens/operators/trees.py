"""Decision trees grown from counts: one pass over the rows for the trees of all features.

The training rows are reduced to a histogram (feature, bin, class). Bins hold equal shares of the rows, cut where values are equal, so that
a histogram is as small for a trillion rows as for a thousand. The trees of all single features grow from it level by level, in window functions
over its cells. A tree over several features needs the counts of its nodes, one more aggregation per level.

Trees are class-balanced: every class weighs the same in all, whatever its number of rows. A split minimises the Gini impurity; of equally
good ones the first feature and the lowest bin win; a node that no split improves is a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.functions.ordering import running
from flowlens.tables import cut

#: Bins of a feature, and decimals to which the quality of splits is compared, so that the order of sums does not decide.
BINS, DECIMALS = 256, 9


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row (keep, feature, value) per row and column; NaN and null count as 0, infinities as the largest values."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), S.clip_extreme(F.col(f"`{c}`").cast("double")).alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.feature", "_c.value")


def value_counts(train: DataFrame, columns: Sequence[str], label: str = "target") -> DataFrame:
    """(feature, value, label, n): what is left of the training rows."""
    return cut(long_values(train, columns, [label]).groupBy("feature", "value", label).agg(F.count("*").alias("n")), "values")


def value_bins(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, value, bin): the share of smaller rows in ``bins`` parts, so that equal values share a bin."""
    per = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    ordered = running(per, ["feature"], "value", ["n"]).join(total, "feature")
    return ordered.select("feature", "value", F.floor((F.col("cum_n") - F.col("n")) * bins / F.col("total")).cast("int").alias("bin"))


def histogram(counts: DataFrame, binned: DataFrame, n_classes: int, label: str = "target") -> DataFrame:
    """(feature, bin, lo, hi, c0, c1, ...): smallest and largest value and the rows of each class."""
    joined = counts.join(binned, ["feature", "value"])
    return joined.groupBy("feature", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *_sums(n_classes, label))


def _sums(n_classes: int, label: str) -> list[Column]:
    return [F.sum(F.when(F.col(label) == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n_classes)]


def class_weights(counts: DataFrame, label: str = "target") -> dict[int, float]:
    """The weight of a row by class: every class that occurs weighs the same, all together one."""
    first = counts.agg(F.min("feature")).first()[0]
    rows = counts.where(F.col("feature") == first).groupBy(label).agg(F.sum("n").alias("n")).collect()
    return {r[label]: 1.0 / (len(rows) * r.n) for r in rows}


def _quality(parts: list[Column]) -> Column:
    """What the Gini impurity of a side takes away from its weight: the larger, the purer."""
    whole = sum(parts[1:], parts[0])
    squares = [p * p for p in parts]
    return F.when(whole > 0, sum(squares[1:], squares[0]) / whole).otherwise(F.lit(0.0))


def best_splits(cells: DataFrame, by: Sequence[str], weights: dict[int, float]) -> DataFrame:
    """``cells`` (by, feature, bin, c0, c1, ...) with the struct ``best`` (gain, feature, bin) of their node ``by``: null where nothing is gained."""
    node = [*by, "feature"]
    upto = Window.partitionBy(*node).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole, every = Window.partitionBy(*node), Window.partitionBy(*by)
    classes = sorted(weights)
    df = cells.withColumns({f"_l{k}": F.sum(F.col(f"c{k}") * F.lit(weights[k])).over(upto) for k in classes})
    df = df.withColumns({f"_t{k}": F.sum(F.col(f"c{k}") * F.lit(weights[k])).over(whole) for k in classes} | {"_last": F.max("bin").over(whole)})
    left, right = [F.col(f"_l{k}") for k in classes], [F.col(f"_t{k}") - F.col(f"_l{k}") for k in classes]
    gain = F.round(_quality(left) + _quality(right) - _quality([F.col(f"_t{k}") for k in classes]), DECIMALS)
    usable = (F.col("bin") < F.col("_last")) & (gain > 0)
    # The least of (-gain, feature, bin) is the best split.
    key = F.when(usable, F.struct((-gain).alias("loss"), "feature", "bin"))
    return df.withColumn("best", F.min(key).over(every)).drop("_last", *[f"_{s}{k}" for s in "lt" for k in classes])


def single_feature_trees(hist: DataFrame, weights: dict[int, float], depth: int = 6) -> DataFrame:
    """(feature, node, label, lo, hi): the leaves of one tree per feature; ``lo`` and ``hi`` are the values at their ends.

    A feature has at most as many cells as bins, so a window holds no more. Nodes count like a heap: the root is 1, children are 2n and 2n + 1.
    """
    df = hist.withColumn("node", F.lit(1))
    for _ in range(depth):
        df = best_splits(df, ["feature", "node"], weights)
        df = df.withColumn("node", F.when(F.col("best").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.col("bin") > F.col("best.bin")).cast("int"))).drop("best")
    sums = {k: F.round(F.sum(F.col(f"c{k}") * F.lit(w)), 12) for k, w in weights.items()}
    label = F.array_max(F.array(*[F.struct(s.alias("w"), F.lit(-k).alias("k")) for k, s in sorted(sums.items())]))
    return df.groupBy("feature", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (-label["k"]).alias("label"))


def thresholds(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``above``: a value belongs to the leaf if it lies above this and not above that of the next leaf; null for the first."""
    before = F.lag("hi").over(Window.partitionBy("feature").orderBy("lo"))
    return leaves.withColumn("above", (before + F.col("lo")) / 2)


def single_feature_outcomes(df: DataFrame, columns: Sequence[str], leaves: DataFrame, label: str = "target") -> DataFrame:
    """(model, seed, y_true, y_pred, n): how the tree of each feature, under its name, answers the rows of ``df``. One pass for all.

    The leaves, at most 2^depth per feature, go into the expressions.
    """
    found: dict[str, list] = {c: [] for c in columns}
    for r in thresholds(leaves).collect():
        found[r.feature].append((r.above, r.label))

    def answer(name: str) -> Column:
        ends = sorted(found[name], key=lambda x: (x[0] is not None, x[0]))
        value = S.clip_extreme(F.col(f"`{name}`").cast("double"))
        bounds = F.array(*[F.lit(float(a)) for a, _ in ends[1:]]).cast("array<double>")
        return F.element_at(F.array(*[F.lit(int(k)) for _, k in ends]), F.size(F.filter(bounds, lambda b: b < value)) + 1)

    rows = F.array(*[F.struct(F.lit(c).alias("model"), answer(c).alias("y_pred")) for c in columns])
    out = df.select(F.col(label).alias("y_true"), F.explode(rows).alias("_r")).select("_r.model", F.lit(0).alias("seed"), "y_true", "_r.y_pred")
    return out.groupBy("model", "seed", "y_true", "y_pred").agg(F.count("*").alias("n"))


def _reached(values: Sequence[Column], splits: dict[int, tuple[int, float]]) -> Column:
    """The node that ``splits`` (the number of a value and its bound, by node) lead a row to. A row looks its node up in a table of splits,
    level by level, so the expression has one step however many splits there are."""
    if not splits:
        return F.lit(1)
    ends = range(1, max(splits) + 1)
    feature = F.lit([splits[n][0] + 1 if n in splits else 0 for n in ends])
    bound = F.lit([splits[n][1] if n in splits else 0 * splits[ends[-1]][1] for n in ends])

    def down(held: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            at = F.when(node <= len(ends), F.element_at(feature, node)).otherwise(0)
            return F.when(at == 0, node).otherwise(2 * node + (F.element_at(held, at) > F.element_at(bound, node)).cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length())), F.lit(1), step)

    # As the one entry of an array, the values are worked out once for all levels.
    return F.element_at(F.transform(F.array(F.array(*values)), down), 1)


class JointTree:
    """A tree over several features: its splits by node, and the class of every node."""

    def __init__(self, splits: dict[int, tuple[str, float]], labels: dict):
        self.splits, self.labels = splits, labels

    def predict(self) -> Column:
        """The class of a row as an expression over the features."""
        names = sorted({name for name, _ in self.splits.values()})
        values = [S.clip_extreme(F.col(f"`{c}`").cast("double")) for c in names]
        node = _reached(values, {n: (names.index(c), float(bound)) for n, (c, bound) in self.splits.items()})
        return F.element_at(F.array(*[F.lit(self.labels.get(n)) for n in range(1, max(self.labels) + 1)]), node)


class _Binned:
    """Training rows with the bins of their features (``b0``, ``b1``, ...), and the splits made so far. The bins' ends are at the driver."""

    def __init__(self, train: DataFrame, columns: Sequence[str], label: str, bins: int):
        self.columns, self.splits = list(columns), {}
        counts = cut(long_values(train, columns, []).groupBy("feature", "value").agg(F.count("*").alias("n")), "values")
        edges = value_bins(counts, bins).groupBy("feature", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        self.places: dict[str, list] = {c: [] for c in columns}
        for r in edges.collect():
            self.places[r.feature].append((r.lo, r.bin, r.hi))
        for held in self.places.values():
            held.sort()
        self.empty = not any(self.places.values())
        self.rows = None if self.empty else cut(self._binned(train, label), "binned")

    def _binned(self, train: DataFrame, label: str) -> DataFrame:
        """A value's bin is the last one that does not begin above it, found by halving: training values fall where they were counted."""
        # Adding zero makes -0.0 the same as 0.0, which a search over doubles would tell apart.
        values = [(S.clip_extreme(F.col(f"`{c}`").cast("double")) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(self.columns)]
        df, out = train.select(F.col(label).alias("label"), *values), [F.col("label")]
        for i, c in enumerate(self.columns):
            held = self.places[c]
            if len(held) == 1:
                out.append(F.lit(int(held[0][1])).alias(f"b{i}"))
                continue
            splits = [-math.inf, *[float(lo) + 0.0 for lo, _, _ in held[1:]], math.inf]
            df = Bucketizer(splits=splits, inputCol=f"v{i}", outputCol=f"p{i}", handleInvalid="error").transform(df)
            out.append(F.element_at(F.array(*[F.lit(int(b)) for _, b, _ in held]), F.col(f"p{i}").cast("int") + 1).alias(f"b{i}"))
        return df.select(*out)

    def node(self) -> Column:
        """The node that the splits so far lead a row to."""
        return _reached([F.col(f"b{i}") for i in range(len(self.columns))], self.splits)

    def counted(self, level: int) -> DataFrame:
        """(node, label, feature, bin, n) of the rows whose node lies on ``level``."""
        # Feature and bin are one number until they are counted.
        cells = F.array(*[F.lit(i << 32).cast("bigint") + F.col(f"b{i}") for i in range(len(self.columns))])
        rows = self.rows.withColumn("node", self.node())
        if any(n not in self.splits for n in range(1, 2**level)):
            rows = rows.where(F.col("node") >= 2**level)
        counts = rows.select("node", "label", F.explode(cells).alias("_c")).groupBy("node", "label", "_c").agg(F.count("*").alias("n"))
        place = [F.shiftright("_c", 32).cast("int").alias("feature"), F.col("_c").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("bin")]
        return counts.select("node", "label", *place, "n")

    def tree(self, labels: dict) -> JointTree:
        def bound(i: int, b: int) -> float:
            values = self.places[self.columns[i]]
            at = [x[1] for x in values].index(b)
            return (values[at][2] + values[at + 1][0]) / 2

        return JointTree({node: (self.columns[i], bound(i, b)) for node, (i, b) in self.splits.items()}, labels)


def joint_tree(train: DataFrame, columns: Sequence[str], n_classes: int, depth: int = 6, bins: int = BINS, label: str = "target") -> JointTree | None:
    """One class-balanced tree over all ``columns``; None without rows. One aggregation (node, feature, bin, class) per level.

    A row carries its features' bins and finds its node by the splits so far, which are at most 2^depth. The driver gets the best
    split and the class of each node.
    """
    held = _Binned(train, columns, label, bins)
    if held.empty:
        return None
    found = held.rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    weights = {r.label: 1.0 / (len(found) * r.n) for r in found}
    labels: dict[int, int] = {}
    for level in range(depth + 1):
        table = held.counted(level).groupBy("node", "feature", "bin").agg(*_sums(n_classes, "label"))
        sums = [F.sum(F.when(F.col("feature") == 0, F.col(f"c{k}") * F.lit(w))).alias(f"w{k}") for k, w in sorted(weights.items())]
        nodes = best_splits(table, ["node"], weights).groupBy("node").agg(F.first("best").alias("best"), *sums).collect()
        for r in nodes:
            labels[r.node] = max(weights, key=lambda k: (round(r[f"w{k}"], 12), -k))
            if r.best is not None and level < depth:
                held.splits[r.node] = (r.best.feature, r.best.bin)
        if not any(r.best is not None for r in nodes):
            break
    return held.tree(labels)


def many_class_tree(train: DataFrame, columns: Sequence[str], label: str, depth: int = 10, bins: int = BINS) -> JointTree | None:
    """One tree over all ``columns`` that names the value of ``label``, of which there may be any number; rows count alike.

    No class has a number or a column. The sums of squares in the Gini impurity change from bin to bin only by the classes that have rows in
    the bin: of a class with l rows before and n in it, by 2ln + n^2 on the left and n^2 - 2rn on the right. So counts of what occurs are enough.
    A leaf names its most frequent label, the least of equally frequent ones.
    """
    held = _Binned(train, columns, label, bins)
    if held.empty:
        return None
    total = held.rows.count()
    for level in range(depth):
        each = Window.partitionBy("node", "feature", "label")
        cells = held.counted(level).withColumn("n", F.col("n").cast("double"))
        cells = cells.withColumn("_l", F.sum("n").over(each.orderBy("bin")) - F.col("n")).withColumn("_r", F.sum("n").over(each) - F.col("_l"))
        n = F.col("n")
        table = cells.groupBy("node", "feature", "bin").agg(F.sum(n).alias("c"), F.sum(2 * F.col("_l") * n + n * n).alias("dl"), F.sum(n * n - 2 * F.col("_r") * n).alias("dr"))
        upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("node", "feature")
        table = table.select(
            "node", "feature", "bin", F.sum("c").over(upto).alias("l"), F.sum("dl").over(upto).alias("l2"), F.sum("dr").over(upto).alias("r2"),
            F.sum("c").over(whole).alias("t"), F.sum("dl").over(whole).alias("t2"), F.max("bin").over(whole).alias("last"),
        )
        right = F.col("t") - F.col("l")
        gain = F.round((F.col("l2") / F.col("l") + F.when(right > 0, (F.col("t2") + F.col("r2")) / right).otherwise(0.0) - F.col("t2") / F.col("t")) / total, DECIMALS)
        best = F.min(F.when((F.col("bin") < F.col("last")) & (gain > 0), F.struct((-gain).alias("loss"), "feature", "bin")))
        found = [r for r in table.groupBy("node").agg(best.alias("best")).collect() if r.best is not None]
        held.splits |= {r.node: (r.best.feature, r.best.bin) for r in found}
        if not found:
            break
    named = held.rows.groupBy(held.node().alias("node"), "label").agg(F.count("*").alias("n"))
    return held.tree({r.node: r.m.label for r in named.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).collect()})
