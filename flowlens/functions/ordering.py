"""Exact global order without a single-partition sort.

Three situations come back all over the library:

* dense positions of integer keys (windows in time order),
* the k-th key of a random (hash) order, per class, to cut samples and splits,
* running sums and exact percentiles along a numeric column.

Each is a two-level job: totals per order-preserving bucket, offsets from a small prefix table, and
row-level order only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.tables import cut

CHUNK = 4096


def positions(df: DataFrame, key: str = "window_id", out: str = "pos", total: str = "n_total") -> DataFrame:
    """Distinct integer keys with their 0-based position in ascending order and their number.

    The only window without a partition runs over the chunk table: one row per 4096 consecutive ids.
    """
    keys = df.select(key).distinct().withColumn("_chunk", F.floor(F.col(key) / CHUNK))
    sizes = keys.groupBy("_chunk").agg(F.count("*").alias("_size"))
    every = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_chunk",
        (F.sum("_size").over(Window.orderBy("_chunk")) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(every).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(key)) - 1
    return keys.join(offsets, "_chunk").select(key, (inside + F.col("_offset")).cast("bigint").alias(out), total)


#: Hex digits by which a bucket of keys is divided at once, rows that are sorted together at most, and hex digits of a key.
DIGITS, BUCKET, LENGTH = 3, 250_000, 32


def cut_keys(df: DataFrame, by: Sequence[str], key: str, wanted: DataFrame, digits: int = DIGITS, bucket: int = BUCKET, length: int = LENGTH) -> DataFrame:
    """For every group and named cut, the hash key below or at which exactly ``k`` rows lie.

    ``df`` has the columns ``by`` and a hex digest ``key``; ``wanted`` has ``by``, ``cut``, ``k``. Counts per leading digits find the bucket
    that holds the k-th key. While one of these has more than ``bucket`` rows, it is divided by its next digits, in a pass that
    counts the rows of these buckets only. What is left is sorted. A group of any size is never sorted or moved as a whole.
    """
    by = list(by)
    rows = df.select(*by, F.col(key).alias("_key"))
    edge = cut(wanted.where(F.col("k") > 0).select(*by, "cut", F.lit("").alias("_prefix"), F.col("k").alias("_rank")), "edges")
    depth = 0
    while depth < length:
        depth += digits
        inside = rows if depth == digits else rows.withColumn("_prefix", F.substring("_key", 1, depth - digits)).join(
            edge.select(*by, "_prefix").distinct(), [*by, "_prefix"], "left_semi"
        )
        sizes = inside.groupBy(*by, F.substring("_key", 1, depth).alias("_bucket")).agg(F.count("*").alias("_size"))
        sizes = sizes.withColumn("_prefix", F.substring("_bucket", 1, depth - digits))
        upto = F.sum("_size").over(Window.partitionBy(*by, "_prefix").orderBy("_bucket"))
        held = sizes.withColumn("_upto", upto).join(edge.drop("_size"), [*by, "_prefix"])
        held = held.where((F.col("_upto") - F.col("_size") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
        edge = cut(held.select(*by, "cut", F.col("_bucket").alias("_prefix"), (F.col("_rank") - F.col("_upto") + F.col("_size")).alias("_rank"), "_size"), "edges")
        if (edge.agg(F.max("_size")).first()[0] or 0) <= bucket:
            break
    inside = Window.partitionBy(*by, "cut").orderBy("_key")
    found = (
        rows.withColumn("_prefix", F.substring("_key", 1, depth))
        .join(edge.drop("_size"), [*by, "_prefix"])
        .withColumn("_place", F.row_number().over(inside))
        .where(F.col("_place") == F.col("_rank"))
        .select(*by, "cut", F.col("_key").alias("upto_key"))
    )
    # Cuts of zero rows have no edge; the empty text lies below every digest.
    return wanted.select(*by, "cut").join(found, [*by, "cut"], "left").select(
        *by, "cut", F.coalesce("upto_key", F.lit("")).alias("upto_key")
    )


def hash_positions(df: DataFrame, key: Column, out: str, digits: int = DIGITS, bucket: int = BUCKET, length: int = LENGTH) -> DataFrame:
    """``df`` with the 1-based position of each row in the order of a uniform hex digest.

    Buckets of leading digits with more than ``bucket`` rows are divided by their next digits, level by level. The tree of their counts gives
    the rows before each bucket: inside a parent by a running sum over its children, down from the root; so no level is ordered in one
    task but the first, of 16^``digits`` counts.
    """
    keyed = df.withColumn("_key", key)
    level = keyed.groupBy(F.substring("_key", 1, digits).alias("_bucket")).agg(F.count("*").alias("_size"))
    level = cut(level.withColumn("_before", F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")), "level")
    depth, leaves, depths = digits, None, [digits]
    while True:
        small = level.where(F.col("_size") <= bucket) if depth < length else level
        leaves = small if leaves is None else leaves.unionByName(small)
        full = level.where(F.col("_size") > bucket).select(F.col("_bucket").alias("_parent"), F.col("_before").alias("_outer"))
        if depth >= length or full.isEmpty():
            break
        depth += digits
        depths.append(depth)
        deeper = keyed.select("_key", F.substring("_key", 1, depth - digits).alias("_parent")).join(full, "_parent")
        sizes = deeper.groupBy("_parent", "_outer", F.substring("_key", 1, depth).alias("_bucket")).agg(F.count("*").alias("_size"))
        along = F.sum("_size").over(Window.partitionBy("_parent").orderBy("_bucket"))
        level = cut(sizes.select("_bucket", "_size", (F.col("_outer") + along - F.col("_size")).alias("_before")), "level")
    leaves = cut(leaves, "leaves")
    if len(depths) == 1:
        ranked = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    else:
        names = leaves.select("_bucket")
        parts = [keyed.withColumn("_bucket", F.substring("_key", 1, d)).join(names.where(F.length("_bucket") == min(d, length)), "_bucket") for d in depths]
        ranked = parts[0]
        for p in parts[1:]:
            ranked = ranked.unionByName(p)
    # The rows move with the bytes of their digest, half as long as its digits, and meet the rows before their bucket afterwards.
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.unhex("_key")))
    ranked = ranked.withColumn(out, place).drop("_key")
    return ranked.join(leaves.select("_bucket", "_before"), "_bucket").withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before")


def ranged(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """``df`` written in range partitions of ``keys``, each row with the number ``_part`` of its range.

    Ranges ascend with ``_part`` and are balanced by sampling, so a group of any size spreads over many.
    Writing fixes the ranges: everything computed from ``_part`` later sees the same ones.
    """
    return cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def running(values: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` along ``order`` within ``by``; one row per (by, order) expected.

    Rows are ordered inside range partitions only and shifted by the totals of the ranges before, a table
    with one row per group and range.
    """
    by = list(by)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    parts = ranged(values, [*by, direction])
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = _within(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*by, "_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(cut(offsets), [*by, "_part"])
    return joined.withColumns({f"cum_{s}": F.sum(s).over(inside) + F.col(f"_o_{s}") for s in sums}).drop(
        "_part", *[f"_o_{s}" for s in sums]
    )


def places(df: DataFrame, by: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """0-based place of each row in the order of ``keys`` within its group, however large the group."""
    by = list(by)
    parts = ranged(df, [*by, *keys])
    totals = parts.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    before = _within(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_part").orderBy(*keys)
    joined = parts.join(cut(offsets), [*by, "_part"])
    return joined.withColumn(out, F.row_number().over(inside) - 1 + F.col("_offset")).drop("_part", "_offset")


def _within(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles: one row per group, one column per entry of ``probs``.

    The built-in exact percentile keeps every distinct value of a group in one task; this one keeps none.
    """
    by = list(by)
    values = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    ordered = cut(running(values, by, "_v", ["n"]))
    sizes = ordered.groupBy(*by).agg(F.max("cum_n").alias("_total"))
    sized = ordered.join(cut(sizes), by) if by else ordered.withColumn("_total", sizes.select("_total").scalar())
    picks = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            F.min(F.when(F.col("cum_n") > F.floor(place), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > F.ceil(place), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_f_{name}"),
        ]
    picked = sized.groupBy(*by).agg(*picks)
    return picked.select(
        *by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs]
    )


def average_ranks(values: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Distinct values of ``col`` per group with their average rank (ties share the mean rank).

    ``values`` holds one row per (by, col) and the number of rows ``n`` that share the value.
    """
    ordered = running(values, by, col, ["n"])
    return ordered.select(*by, col, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(out))
