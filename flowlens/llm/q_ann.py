"""Query of the nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read
from flowlens.llm.kmeans_tree import nearest


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op10_ann": op10_ann}
ORACLES: dict[str, str] = {}
