"""Scans and sinks: raw CSV, clean flow tables, graphs, predictions, run records, timelines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import scalars as S


def read_flows(spark: SparkSession, path: str, columns: Sequence[str] | None = None, nrows: int | None = None) -> DataFrame:
    """CSV with a header; every column is text so that malformed cells survive until they are parsed.

    Header names are trimmed. Large files need no chunking: Spark splits the file by bytes.
    """
    raw = spark.read.option("header", True).csv(path)
    df = raw.toDF(*[c.strip() for c in raw.columns])
    if columns is not None:
        df = df.select(*columns)
    return df if nrows is None else df.limit(nrows)


#: Rows of one hour that one file of the day layout holds, about.
FILE_ROWS = 1_000_000
HOUR_MS = 3_600_000


def write_flows(df: DataFrame, path: str, mode: str = "errorifexists", days: bool = True, file_rows: int = FILE_ROWS) -> None:
    """Clean flow table as Parquet. By default in one folder per UTC day, of which ``load_flows`` reads those that a time range touches.

    Rows are counted by hour first, and an hour with more than ``file_rows`` rows is dealt over several files, so that a busy hour is no
    single task. The counts, with the first and last time of every hour, stay beside the table as ``<path>.hours``.
    """
    if not days:
        df.write.mode(mode).parquet(path)
        return
    hour = F.floor(F.col("start_ms") / HOUR_MS)
    dated = df.withColumn("flow_day", S.to_day(F.col("start_ms"))).withColumn("_hour", hour)
    hours = dated.groupBy("flow_day", "_hour").agg(F.count("*").alias("flows"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    beside = hours_path(path)
    hours.write.mode(mode).parquet(beside)
    # An hour, or the rows without a time, that need several files: a list as long as the table has such hours, written, so of a known size.
    full = df.sparkSession.read.parquet(beside).where(F.col("flows") > file_rows).select(F.col("_hour").alias("_full"), F.ceil(F.col("flows") / file_rows).cast("int").alias("_files"))
    dealt = dated.join(full, F.col("_hour").eqNullSafe(F.col("_full")), "left").withColumn("_file", F.floor(F.rand(5) * F.coalesce("_files", F.lit(1))))
    dealt = dealt.repartition("flow_day", "_hour", "_file").drop("_hour", "_full", "_files", "_file")
    dealt.sortWithinPartitions("flow_day", "start_ms").write.mode(mode).partitionBy("flow_day").parquet(path)


def hours_path(path: str) -> str:
    return f"{path.rstrip('/')}.hours"


def load_flows(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, between: tuple[float, float] | None = None,
) -> DataFrame:
    """The flow table; with ``between`` the flows that start at or after the first and before the second epoch millisecond.

    In the day layout only the folders of the days in the range are read.
    """
    df = spark.read.parquet(path)
    if between is not None:
        low, high = between
        df = df.where((F.col("start_ms") >= F.lit(float(low))) & (F.col("start_ms") < F.lit(float(high))))
        if "flow_day" in df.columns:
            day = lambda ms: F.lit(datetime.fromtimestamp(ms / 1000.0, timezone.utc).date())
            df = df.where(F.col("flow_day").between(day(low), day(high - 1e-3)))
    if "flow_day" in df.columns:
        df = df.drop("flow_day")
    return df if columns is None else df.select(*columns)


def write_graphs(edges: DataFrame, nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edge and node tables keyed by window; sorted by window inside files for row-group pruning."""
    for name, df in (("edges", edges), ("nodes", nodes)):
        df.sortWithinPartitions("window_id").write.mode(mode).parquet(f"{path}/{name}")


def load_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scores of several models: one folder per model and seed, ordered by flow id inside files."""
    df.sortWithinPartitions("model", "seed", "flow_id").write.mode(mode).partitionBy("model", "seed").parquet(path)


def load_predictions(spark: SparkSession, path: str, model: str | None = None, seeds: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if model is not None:
        df = df.where(F.col("model") == model)
    if seeds is not None:
        df = df.where(F.col("seed").isin(list(seeds)))
    return df


RUN_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("per_class", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    ]
)


def write_runs(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON line per run record."""
    runs.write.mode(mode).json(path)


def load_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run records of many result files, with the file each came from."""
    df = spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).json(path)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def write_timeline(timeline: DataFrame, path: str, mode: str = "errorifexists") -> None:
    timeline.write.mode(mode).option("header", True).csv(path)
