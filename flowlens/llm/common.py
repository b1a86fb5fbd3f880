"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.tables import cut

#: A-Z to a-z, every other byte as it is: safe on UTF-8, where bytes above 0x7F never stand for ASCII.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows in them; null is read as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def packed(df: DataFrame, text_col: str, new: tuple[str, ...] = (), **more) -> DataFrame:
    """Every row as one column ``_row``, its text (null: empty) as ``_text``, and more columns: no name in the rows can clash with a name at work.

    Columns named like ``new`` ones are left out of the row.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in new}]
    row = F.struct(*keep) if keep else F.struct(F.lit(None).cast("string").alias("_none"))
    return df.select(row.alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame, *new: str) -> DataFrame:
    """The columns of ``_row`` and the new ones behind them."""
    return df.select("_row.*", *[F.col(f"`{n}`") for n in new])


def fold(column, modulus: int):
    """crc32 of a number written as text, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b; of one ordered type) reaches.

    Alternating large and small stars: every step replaces the neighbours of a node by its smallest neighbour, so
    that the number of steps grows with the logarithm of a component and the number of edges never grows. Each
    step is written to the shared folder; only two totals per step reach the driver.
    """
    state = None
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
        edges = cut(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
