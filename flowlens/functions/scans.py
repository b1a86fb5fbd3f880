"""Prefix scans of affine maps: linear recurrences over any number of rows, without a task that holds a whole sequence.

A stretch of a recurrence ``s -> a * s + b`` is itself such a map, and two stretches that follow each other combine to one. So a long
sequence is cut into stretches, every stretch becomes one map, and what enters a stretch is found from the maps before it:
inside groups of neighbouring stretches first, then over the groups, level by level, like a tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.tables import cut

#: Maps that are combined in one group.
FAN = 256


def _after(s: Column, a: Column, b: Column) -> Column:
    return F.zip_with(F.zip_with(s, a, lambda x, y: x * y), b, lambda x, y: x + y)


def affine_prefix(maps: DataFrame, by: Sequence[str], low: int, high: int, fan: int = FAN) -> DataFrame:
    """(by, pos, before): what the maps before each position make of zero.

    ``maps`` has the columns ``by``, ``pos`` (bigint between ``low`` and ``high``, unique within ``by``) and the arrays ``a`` and ``b``, one
    entry per recurrence. Positions may have gaps. A group holds ``fan`` maps at most, however long a sequence is.
    """
    by = list(by)
    grouped = maps.groupBy(*by, F.floor((F.col("pos") - low) / fan).alias("_group")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("_maps")
    )
    kind = "array<struct<pos:bigint,a:array<double>,b:array<double>>>"
    start = F.struct(
        F.transform(F.col("_maps")[0]["a"], lambda x: F.lit(1.0)).alias("a"), F.transform(F.col("_maps")[0]["a"], lambda x: F.lit(0.0)).alias("b"),
        F.array().cast(kind).alias("out"),
    )

    def step(acc: Column, m: Column) -> Column:
        before = F.struct(m["pos"].alias("pos"), acc["a"].alias("a"), acc["b"].alias("b"))
        return F.struct(
            F.zip_with(acc["a"], m["a"], lambda x, y: x * y).alias("a"), _after(acc["b"], m["a"], m["b"]).alias("b"), F.concat(acc["out"], F.array(before)).alias("out")
        )

    folded = grouped.select(*by, "_group", F.aggregate("_maps", start, step).alias("_f"))
    groups = (high - low) // fan + 1
    if groups == 1:
        return folded.select(*by, F.explode("_f.out").alias("_m")).select(*by, "_m.pos", F.col("_m.b").alias("before"))
    folded = cut(folded, "maps")
    outer = affine_prefix(folded.select(*by, F.col("_group").alias("pos"), F.col("_f.a").alias("a"), F.col("_f.b").alias("b")), by, 0, groups - 1, fan)
    outer = outer.select(*by, F.col("pos").alias("_group"), F.col("before").alias("_outer"))
    inner = folded.select(*by, "_group", F.explode("_f.out").alias("_m")).join(outer, [*by, "_group"])
    return inner.select(*by, "_m.pos", _after(F.col("_outer"), F.col("_m.a"), F.col("_m.b")).alias("before"))
