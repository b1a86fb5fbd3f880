"""Input frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import columns as C
from flowlens.operators import splits as T
from flowlens.operators import windows as W
from flowlens.sources import views as V
from flowlens.tables import cut

DAY = 86_400.0
N_CLASSES = 7

# Prepared tables of this application: each is written once and read, column-pruned, by every query on it.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def prepared(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(build(), name)
    return _WRITTEN[key]


def forget() -> None:
    """Drop the prepared tables, so that the next query builds its own."""
    _WRITTEN.clear()


def windowed(spark: SparkSession, sf: str) -> DataFrame:
    """All flows with their window, straight from the tables."""
    return W.assign_windows(V.flows_lineitem(spark, sf), DAY)


def window_splits(df: DataFrame) -> DataFrame:
    """Kept windows with position and chronological split, as a written lookup table."""
    # Positions read the windows three times, the flows are counted once.
    windows = cut(W.window_table(df), "windows")
    return cut(T.split_chronological(W.window_ordinal(windows)).select("window_id", "pos", "n_windows", "split"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Kept flows with class number, window position and chronological split."""

    def build() -> DataFrame:
        # The join runs once; facts and rows then come from its written lines.
        lines = cut(V.joined_lineitem(spark, sf), "lines").withColumns({"start_ms": V.start_ms_of_line(), "attack": V.attack_of_line()})
        # One pruned pass finds the classes and the earliest start; the origin is then a literal.
        per_class = cut(lines.groupBy("attack").agg(F.min("start_ms").alias("first_ms")), "classes")
        df = W.assign_windows(lines, DAY, per_class.agg(F.min("first_ms")).first()[0])
        windows, classes = window_splits(df), C.written_classes(per_class)
        # Clustered by time, so that window and split filters skip row groups. The salt spreads a busy window over sixteen
        # files. What moves are lines; their windows, classes and long digests come to them where they are written.
        spread = [F.floor(F.col("window_id") / 16), F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_linenumber"), F.lit(16))]
        laid = df.drop("attack", "start_ms").repartition(*spread).withColumn("attack", V.attack_of_line())
        laid = laid.join(windows, "window_id").join(classes, "attack").drop("attack").sortWithinPartitions("window_id")
        return V.flows_of_lines(laid, "window_id", "pos", "n_windows", "split", "target")

    return prepared(spark, sf, "labelled", build)


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Kept flows: the clean flow table that graphs and context start from."""
    return labelled(spark, sf).drop("target", "pos", "n_windows", "split")


def predictions(spark: SparkSession, sf: str, split: int = 2) -> DataFrame:
    """Scores of every model and seed on the test (2) or validation (1) flows."""

    def build() -> DataFrame:
        flows = labelled(spark, sf).where(F.col("split") == split).select("flow_id", "window_id", "pos", "src_ip", "dst_ip", "target")
        return V.scored(flows, N_CLASSES).withColumnRenamed("target", "y_true")

    return prepared(spark, sf, f"predictions{split}", build)
