"""Mixing sources to target weights with exact token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.tables import cut

#: Hex digits of the random key that each narrowing step adds: a range of keys is 1/4096 of the one before.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and the five ASCII control spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, size: Column, seed: str) -> Column:
    """A uniform hex digest that a rerun repeats. A row without an id is keyed by its size alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), size.cast("string")).cast("binary"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(id, source, size, key) of every row, narrow: all that the sums and the order need."""
    size = word_count(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn(
        "key", random_key(F.col("id"), F.col("size"), seed)
    )


def budgets(rows: DataFrame, weights: list[int], most: int) -> DataFrame:
    """(source, source_size, target, budget, epochs, rest): one row per source.

    Weights repeat along the sources in code point order, null last. All sources together get the sum of all sizes; no
    target exceeds ``most`` times its source, and what a capped source leaves goes to the others by weight. That
    sharing has one fixed point: target = min(cap, level * weight). Ordered by cap / weight, the capped sources
    come first, so the level follows from running sums over this one-row-per-source table.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), place % len(weights) + 1).cast("bigint"))
    per = per.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy(F.lit(0))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(every) - before) / onward)
    per = per.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("w"))
    per = per.withColumn("target", target).withColumn("budget", F.floor(F.col("target") + 0.5).cast("bigint"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("bigint")
    per = per.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    return per.select("source", "source_size", "target", "budget", "epochs", "rest")


def cuts(rows: DataFrame, shares: DataFrame, steps: int = 2) -> DataFrame:
    """Per source the key at which its running sum of sizes, in key order, reaches ``rest``: (source, cut_key, left, tied).

    The sum runs over ranges of keys first (4096 per source and step, pre-aggregated before the shuffle), then over
    the one range in which the budget ends, and only that range is sorted. ``left`` words of the ``tied`` words
    standing at the cut key still fit.
    """
    open_ = shares.where(F.col("rest") > 0).select("source", F.col("rest").alias("left"), F.lit("").alias("prefix"))
    for step in range(1, steps + 1):
        width = step * DIGITS
        inside = _within(rows, open_).groupBy("source", "left", F.substring("key", 1, width).alias("range")).agg(F.sum("size").alias("n"))
        open_ = cut(_reached(inside, "range").select("source", F.col("rest").alias("left"), F.col("range").alias("prefix")), "cuts")
    keys = _within(rows, open_).groupBy("source", "left", "key").agg(F.sum("size").alias("n"))
    return cut(_reached(keys, "key").select("source", F.col("key").alias("cut_key"), F.col("rest").alias("left"), F.col("n").alias("tied")), "cuts")


def _within(rows: DataFrame, open_: DataFrame) -> DataFrame:
    o = open_.select(F.col("source").alias("_s"), "left", "prefix")
    return rows.join(o, F.col("source").eqNullSafe(F.col("_s")) & F.col("key").startswith(F.col("prefix")))


def _reached(sums: DataFrame, order: str) -> DataFrame:
    """The row of each source whose running sum first reaches ``left``, and what of it is left there (``rest``)."""
    upto = F.sum("n").over(Window.partitionBy("source").orderBy(order))
    sums = sums.withColumn("upto", upto).withColumn("rest", F.col("left") - F.col("upto") + F.col("n"))
    return sums.where((F.col("rest") > 0) & (F.col("left") <= F.col("upto")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: list[int] | None = None, most: int = 3, seed: str = "mix",
) -> DataFrame:
    """How many words of each row the mix takes: (id, source, size, source_size, target, taken), one row per row.

    A source whose budget is e whole epochs and a rest takes every document e times and, in the order of a hash-random
    key, documents until the rest is full; the document at the cut gives exactly the words that still fit. The
    texts are read once; all sums and the order work on narrow rows in a written table.

    Null text or text without a word: size 0, taken 0. Null source: a source of its own. Rows that tie on the key (the
    same id and size, or no id and the same size) share what is left at the cut in proportion to their sizes. An
    empty table gives an empty result; a source of size 0 has target 0.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, seed), "sizes")
    return with_taken(rows, cut_table(rows, weights, most))


def cut_table(rows: DataFrame, weights: list[int] | None = None, most: int = 3) -> DataFrame:
    """One row per source: its size, target, whole epochs, and where in the order of keys its rest ends. ``rows`` has source, size, key."""
    shares = cut(budgets(rows.select("source", "size"), weights or [1, 2, 3], most), "shares")
    found = cuts(rows.select("source", "size", "key"), shares)
    s = shares.select(F.col("source").alias("_s"), "source_size", "target", "epochs")
    c = found.select(F.col("source").alias("_c"), "cut_key", F.col("left").alias("_left"), F.col("tied").alias("_tied"))
    # Written, so that its size is known and rows are joined to it where they are.
    return cut(s.join(c, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c"), "mix")


def with_taken(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with source, size and key, and the words that a mix takes of each; further columns stay."""
    more = F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0)).when(
        F.col("key") < F.col("cut_key"), F.col("size")
    ).otherwise(F.expr("(_left * size) div _tied"))
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("bigint")).drop("_s", "epochs", "cut_key", "_left", "_tied")
